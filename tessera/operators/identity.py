"""Same-as links as a structure of components, kept up to date link by link.

Equal names are never multiplied in the data: each gets the least name of its component, facts are held
under that, and the other names come back only on export or for the names that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import terms as T


def components(links: DataFrame) -> DataFrame:
    """(id, canonical) for the ends of links (a, b): minimum labels with jumps, checkpointed each round.

    Labels and edges meet in sort-merge joins, whose hot vertices adaptive execution splits.
    """
    from tessera.operators.reason import cut

    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("canonical")))
    while True:
        best = both.join(labels.select(F.col("id").alias("b"), "canonical").hint("merge"), "b").groupBy("a").agg(F.min("canonical").alias("c"))
        moved = labels.join(best.withColumnRenamed("a", "id"), "id").select("id", F.col("canonical").alias("was"), F.least("canonical", "c").alias("canonical"))
        jump = labels.select(F.col("id").alias("canonical"), F.col("canonical").alias("far"))
        new = cut(moved.join(jump.hint("merge"), "canonical").select("id", "was", F.least("canonical", "far").alias("canonical")))
        done = new.where("was <> canonical").isEmpty()
        labels = new.select("id", "canonical")
        if done:
            return labels


def renamed(df: DataFrame, column: str, canonical: DataFrame, names=None) -> DataFrame:
    """df with a column's names replaced by their representatives (where names holds, if given)."""
    c = canonical.select(F.col("id").alias("_id"), F.col("canonical").alias("_to"))
    on = F.col(column) == F.col("_id")
    joined = df.join(c, on if names is None else on & names, "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def merge(canonical: DataFrame | None, links: DataFrame) -> DataFrame:
    """canonical after more links: only representatives that the links join are searched again.

    The representative of a component is its least name, so that of a merged one is the least of theirs.
    """
    from tessera.operators.reason import cut

    if canonical is None:
        return components(links)
    ends = renamed(renamed(links.select("a", "b"), "a", canonical), "b", canonical).where("a <> b").distinct()
    moved = components(ends)
    old = renamed(canonical.select("id", "canonical"), "canonical", moved)
    return cut(old.unionByName(moved.join(canonical, "id", "left_anti")))


def canonicalise(triples: DataFrame, canonical: DataFrame, predicates: bool = False) -> DataFrame:
    """Subjects and objects (and predicates, if asked for) replaced by their representatives."""
    out = renamed(renamed(triples, "s", canonical), "o", canonical, F.col("o_kind") != "literal")
    if predicates:
        out = renamed(out, "p", canonical)
    return out.select(*T.TRIPLE).distinct()


def expand(triples: DataFrame, canonical: DataFrame, predicates: bool = False) -> DataFrame:
    """Every fact under every name of its terms, and each name the same as its representative.

    Links between all pairs of names are left out: they grow with the square of a component.
    """
    names = canonical.select(F.col("canonical").alias("_c"), F.col("id").alias("_name"))

    def under(df: DataFrame, column: str, literal: bool) -> DataFrame:
        on = F.col(column) == F.col("_c")
        joined = df.join(names, on & (F.col("o_kind") != "literal") if literal else on, "left")
        return joined.withColumn(column, F.coalesce("_name", column)).drop("_c", "_name")

    out = under(under(triples, "s", False), "o", True)
    if predicates:
        out = under(out, "p", False)
    away = canonical.where("id <> canonical")
    same = lambda a, b: away.select(F.col(a).alias("s"), F.lit(T.SAME_AS).alias("p"), F.col(b).alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    return out.select(*T.TRIPLE).unionByName(same("id", "canonical")).unionByName(same("canonical", "id")).distinct()


def about(triples: DataFrame, canonical: DataFrame, names: DataFrame) -> DataFrame:
    """The canonical facts of the names asked for (name), each under the name that was asked for."""
    asked = names.select("name").distinct().withColumn("s", F.col("name"))
    found = renamed(asked, "s", canonical)
    return triples.join(found, "s").select(F.col("name").alias("s"), *T.TRIPLE[1:]).distinct()
