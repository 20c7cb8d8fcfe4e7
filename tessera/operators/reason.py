"""Schema and identity inference over triples.

Class, property and role hierarchies are graphs closed by a semi-naive loop that joins only what the
last round found; same-as links become component representatives instead of copied facts.
"""

from __future__ import annotations

import functools
import tempfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sizes
from tessera import terms as T
from tessera.operators import identity
from tessera.operators.identity import canonicalise, components

__all__ = ["Closed", "canonicalise", "close", "closure", "components", "cut", "edges_of", "extend", "infer", "lifted_schema", "list_members", "over_maximum", "reach", "same_as_components", "schema_closure", "turned", "violations"]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; one machine may do without a setting."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def closure(edges: DataFrame, reflexive: DataFrame | None = None) -> DataFrame:
    """(a, b, depth): what is reachable along edges (a, b), with the least number of steps.

    reflexive: nodes (id) that also reach themselves in no step. Cycles end the loop as any other.
    Each round writes only what is new; the rounds are put together at the end.
    """
    edges = cut(edges.select("a", "b").distinct())
    rounds = [edges.withColumn("depth", F.lit(1))]
    if reflexive is not None:
        own = reflexive.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
        rounds = [cut(own.withColumn("depth", F.lit(0))), edges.where("a <> b").join(own, ["a", "b"], "left_anti").unionByName(edges.where("a = b").join(own, ["a", "b"], "left_anti")).withColumn("depth", F.lit(1))]
    known = functools.reduce(DataFrame.unionByName, rounds)
    front, depth = rounds[-1], 1
    while True:
        depth += 1
        step = front.select("a", F.col("b").alias("m")).join(edges.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
        front = cut(step.join(known, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(a, b, depth): what the seeds (id) reach along edges (a, b), themselves in no step included.

    Semi-naive from the seeds: what no seed reaches is never joined. A few edges and seeds are walked on
    the driver, so that a long chain takes no job for each of its links.
    """
    found = _reach_by_hand(edges, seeds)
    if found is not None:
        return found
    edges = cut(edges.select("a", "b").distinct())
    front = known = cut(seeds.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        step = front.select("a", F.col("b").alias("m")).join(edges.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
        front = cut(step.join(known, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def _reach_by_hand(edges: DataFrame, seeds: DataFrame) -> DataFrame | None:
    few = [df.limit(BROADCAST_ROWS + 1) for df in (edges.select("a", "b"), seeds.select("id"))]
    if any(df.count() > BROADCAST_ROWS for df in few):
        return None
    next_: dict = {}
    for a, b in few[0].collect():
        next_.setdefault(a, set()).add(b)
    rows: list = []
    for a in {r.id for r in few[1].collect()}:
        depth, seen, front = 0, {a}, [a]
        while front and len(rows) <= LOCAL_PAIRS:
            rows += [(a, b, depth) for b in front]
            depth, front = depth + 1, [b for x in front for b in next_.get(x, ()) if b not in seen and not seen.add(b)]
    if len(rows) > LOCAL_PAIRS:
        return None
    a, b, depth = zip(*rows, strict=True) if rows else ((), (), ())
    return edges.sparkSession.createDataFrame(pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "depth": pa.array(depth, pa.int32())}))


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


#: Most rows of a schema's table that are broadcast or closed on the driver; a larger one is joined by a
#: shuffle and closed by Spark. And most pairs of a closure that the driver makes.
BROADCAST_ROWS, LOCAL_PAIRS = 100_000, 1_000_000


def local(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    """Rows of strings as a relation that is planned with, not scanned."""
    return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], pa.string()) for k, n in enumerate(names)}))


def held(schema: DataFrame) -> DataFrame:
    """A schema of few triples as a local relation; a larger one as it is."""
    few = schema.select(*T.TRIPLE).limit(BROADCAST_ROWS + 1).collect()
    return local(schema.sparkSession, few, T.TRIPLE) if len(few) <= BROADCAST_ROWS else schema


def closed_pairs(edges) -> set | None:
    """The closure of a few edges on the driver; None if it has more than LOCAL_PAIRS pairs."""
    next_: dict = {}
    for a, b in edges:
        next_.setdefault(a, set()).add(b)
    pairs: set = set()
    for a in next_:
        seen: set = set()
        front = [a]
        while front and len(pairs) + len(seen) <= LOCAL_PAIRS:
            front = [b for x in front for b in next_.get(x, ()) if b not in seen and not seen.add(b)]
        pairs.update((a, b) for b in seen)
    return pairs if len(pairs) <= LOCAL_PAIRS else None


def schema_closure(edges: DataFrame) -> DataFrame:
    """(a, b) of the closure of a schema's edges: without a Spark job for each round if they are few."""
    few = edges.select("a", "b").limit(BROADCAST_ROWS + 1).collect()
    pairs = closed_pairs(few) if len(few) <= BROADCAST_ROWS else None
    return closure(edges).select("a", "b") if pairs is None else local(edges.sparkSession, sorted(pairs), ["a", "b"])


def edges_of(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where((F.col("p") == predicate) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))


def list_members(triples: DataFrame) -> DataFrame:
    """(head, member) of every rdf:List."""
    rest = edges_of(triples, T.RDF + "rest").where(F.col("b") != T.RDF + "nil")
    first = edges_of(triples, T.RDF + "first")
    own = first.select("a", F.col("a").alias("b"))
    walk = schema_closure(rest).union(own)
    return walk.select(F.col("a").alias("head"), F.col("b").alias("cell")).join(first.select(F.col("a").alias("cell"), F.col("b").alias("member")), "cell").select("head", "member").distinct()


def _small(table: DataFrame) -> DataFrame:
    """Broadcast, if its rows are few by count."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def implied_properties(schema: DataFrame) -> DataFrame:
    """(p, _q, _turned): the properties that a triple of p holds for, p among them; '' or 'turned' round.

    The closure of sub-properties and inverses together: a node is a property with a sign.
    """
    sub, inverse = edges_of(schema, T.SUB_PROPERTY), edges_of(schema, T.INVERSE)
    signed = lambda df, x, y: df.select(F.concat(F.lit(x), "a").alias("a"), F.concat(F.lit(y), "b").alias("b"))
    back = inverse.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = signed(sub, "+", "+").union(signed(sub, "-", "-"))
    for way in (inverse, back):
        edges = edges.union(signed(way, "+", "-")).union(signed(way, "-", "+"))
    pairs = schema_closure(edges).where("a LIKE '+%'")
    name = lambda c: F.substr(F.col(c), F.lit(2))
    found = pairs.select(name("a").alias("p"), name("b").alias("_q"), F.when(F.startswith("b", F.lit("-")), "turned").otherwise("").alias("_turned"))
    return found.union(found.select("p", F.col("p").alias("_q"), F.lit(""))).distinct()


@dataclass(frozen=True)
class Rules:
    """A closed schema: implied (p, _q, _turned), says (p, _place, _class) and above (_k, _super) as
    tables to join facts with, and the transitive properties. Empty _place and _super stand for the fact
    itself, _turned is '' or 'turned'."""

    implied: DataFrame
    says: DataFrame
    above: DataFrame
    transitive: list[str]


def rules_of(schema: DataFrame) -> Rules:
    """The rules of a schema: closed on the driver and broadcast if it is small, else by Spark."""
    rows = schema.select("s", "p", "o", "o_kind").limit(BROADCAST_ROWS + 1).collect()
    return (_rules_by_hand(schema.sparkSession, rows) if len(rows) <= BROADCAST_ROWS else None) or _rules_by_spark(schema)


def _rules_by_hand(spark: SparkSession, rows: list) -> Rules | None:
    links: dict = {}
    for r in rows:
        if r.o_kind != "literal":
            links.setdefault(r.p, []).append((r.s, r.o))
    of = lambda p: links.get(p, [])
    signed = [((x, a), (x, b)) for a, b in of(T.SUB_PROPERTY) for x in ("", "turned")]
    for a, b in of(T.INVERSE):
        signed += [((x, c), (y, d)) for c, d in ((a, b), (b, a)) for x, y in (("", "turned"), ("turned", ""))]
    cells, first = dict(of(T.RDF + "rest")), {}
    for cell, member in of(T.RDF + "first"):
        first.setdefault(cell, []).append(member)
    unions = []
    for c, cell in of(T.OWL + "unionOf"):
        walked: set = set()
        while cell is not None and cell not in walked:
            walked.add(cell)
            unions += [(m, c) for m in first.get(cell, ())]
            cell = cells.get(cell)
    properties, classes = closed_pairs(signed), closed_pairs([*of(T.SUB_CLASS), *unions])
    if properties is None or classes is None:
        return None
    implied = {(p, q, turned) for (x, p), (turned, q) in properties if not x}
    implied |= {(p, p, "") for p, _, _ in implied}
    supers: dict = {}
    for a, b in classes:
        supers.setdefault(a, [""]).append(b)
    says = {(r.s, place, c) for place, p in (("s", T.DOMAIN), ("o", T.RANGE)) for r in rows if r.p == p and r.o_kind == "uri" for c in (r.o, *supers.get(r.o, ())) if c}
    says |= {(p, "", "") for p, _, _ in says}
    table = lambda found, *names: F.broadcast(local(spark, sorted(found), list(names)))
    transitive = sorted({r.s for r in rows if r.p == T.TYPE and r.o == T.TRANSITIVE})
    return Rules(table(implied, "p", "_q", "_turned"), table(says, "p", "_place", "_class"), table({(a, b) for a, bs in supers.items() for b in bs}, "_k", "_super"), transitive)


def _rules_by_spark(schema: DataFrame) -> Rules:
    implied = implied_properties(schema)
    unions = edges_of(schema, T.OWL + "unionOf").withColumnRenamed("b", "head").join(list_members(schema), "head").select(F.col("member").alias("a"), F.col("a").alias("b"))
    sub_c = schema_closure(edges_of(schema, T.SUB_CLASS).union(unions))

    def of(p, place):
        direct = schema.where((F.col("p") == p) & (F.col("o_kind") == "uri")).select(F.col("s").alias("p"), F.col("o").alias("class"))
        return direct.union(direct.join(sub_c.withColumnRenamed("a", "class"), "class").select("p", F.col("b").alias("class"))).select("p", F.lit(place).alias("_place"), F.col("class").alias("_class"))

    says = of(T.DOMAIN, "s").union(of(T.RANGE, "o")).distinct()
    above = sub_c.select(F.col("a").alias("_k"), F.col("b").alias("_super"))
    transitive = [r.s for r in schema.where((F.col("p") == T.TYPE) & (F.col("o") == T.TRANSITIVE)).select("s").distinct().collect()]
    return Rules(_small(implied), _small(says.union(says.select("p", F.lit(""), F.lit("")).distinct())), _small(above.union(above.select("_k", F.lit("")).distinct()).distinct()), transitive)


@dataclass(frozen=True)
class Closed:
    """Facts under canonical names with all that follows, and the names' components (None: no two equal)."""

    triples: DataFrame
    canonical: DataFrame | None = None
    schema: DataFrame | None = None  # under canonical names

    def export(self) -> DataFrame:
        """Every fact under every name."""
        return self.triples if self.canonical is None else identity.expand(self.triples, self.canonical, predicates=True)

    def about(self, names: DataFrame) -> DataFrame:
        """The facts of some names (name), whichever of their equals they were stated of."""
        if self.canonical is None:
            return self.triples.join(names.select(F.col("name").alias("s")).distinct(), "s", "left_semi").select(*T.TRIPLE)
        return identity.about(self.triples, self.canonical, names)


def infer(data: DataFrame, schema: DataFrame, include_thing: bool = False) -> DataFrame:
    """data and all that follows, every fact under every name: close() exported."""
    return close(data, schema, include_thing).export()


def _spread(x: DataFrame, rules: Rules) -> DataFrame:
    """Each triple once for every property that it holds for; no literal becomes a subject."""
    met = x.select(*T.TRIPLE).join(rules.implied, "p", "left").where("coalesce(_turned, '') = '' OR o_kind <> 'literal'")
    turn = lambda a, b: F.when(F.col("_turned") == "turned", b).otherwise(F.col(a)).alias(a)
    return met.select(turn("s", F.col("o")), F.coalesce("_q", "p").alias("p"), turn("o", F.col("s")), turn("o_kind", F.lit("uri")), turn("o_dt", F.lit("")), turn("o_lang", F.lit("")))


def _typed(out: DataFrame, rules: Rules, include_thing: bool) -> DataFrame:
    """Triples with the classes that they give their ends, and those above the classes they state."""
    place, super_ = F.coalesce("_place", F.lit("")), F.coalesce("_super", F.lit(""))
    met = out.join(rules.says, "p", "left").where("coalesce(_place, '') <> 'o' OR o_kind <> 'literal'")
    met = met.withColumn("_k", F.when((place == "") & (F.col("p") == T.TYPE), F.col("o"))).join(rules.above, "_k", "left")
    kind = F.when(super_ != "", super_).when(place != "", F.col("_class"))  # the class of a triple that is made
    keep = lambda c, new: F.when(kind.isNotNull(), F.lit(new)).otherwise(F.col(c)).alias(c)
    made = met.select(F.when(place == "o", F.col("o")).otherwise(F.col("s")).alias("s"), keep("p", T.TYPE), F.coalesce(kind, "o").alias("o"), keep("o_kind", "uri"), keep("o_dt", ""), keep("o_lang", ""))
    if include_thing:
        made = made.unionByName(_pairs(out.select(F.col("s").alias("a"), F.lit(T.THING).alias("b")), T.TYPE))
    return sizes.distinct(made, "s", "o")


def _pairs(pairs: DataFrame, p: str) -> DataFrame:
    """Triples of a property from (a, b)."""
    return pairs.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


def _ruled(schema: DataFrame, facts: DataFrame, canonical: DataFrame) -> bool:
    """Is a name that was replaced one of a class or property?"""
    named = canonical.where("id <> canonical").select("id")
    used = schema.select(F.explode(F.array("s", "p", "o")).alias("id")).union(facts.select(F.col("p").alias("id"))).distinct()
    return not used.join(named, "id", "left_semi").isEmpty()


def close(data: DataFrame, schema: DataFrame, include_thing: bool = False) -> Closed:
    """data and all that follows: sub-properties, inverses, transitive properties, domains and ranges,
    super-classes, members of a named union of classes, and what holds of one name of a thing holds of
    all (same-as, stated or implied). Triples with literal subjects never arise.

    The schema is closed first; then each triple is expanded in place, so data is read once. Same-as
    links merge components: facts move to the representative, and only facts that a merge or a transitive
    property makes go through the rules again.
    """
    schema = held(schema)
    canonical = None
    stated = edges_of(schema, T.SAME_AS).where("a <> b")
    if not stated.isEmpty():
        canonical = identity.merge(None, stated)
        schema = held(cut(identity.canonicalise(schema, canonical, predicates=True)))
        data = identity.canonicalise(data, canonical, predicates=True)
    rules = rules_of(schema)
    out = _spread(data, rules)
    # what takes rounds is written first; data without any such fact goes straight on
    rounds = not out.where(F.col("p").isin(T.SAME_AS, *rules.transitive)).isEmpty()
    out = cut(out) if rounds else out
    while rounds:
        links = edges_of(out, T.SAME_AS).where("a <> b")
        if not links.isEmpty():
            canonical = identity.merge(canonical, links)
            # equal classes or properties are those of the schema, too, and their facts have to be met anew
            anew = _ruled(schema, out, canonical)
            out = identity.canonicalise(out, canonical, predicates=anew)
            if anew:
                schema = held(cut(identity.canonicalise(schema, canonical, predicates=True)))
                rules = rules_of(schema)
                out = _spread(out, rules)
            out = cut(out.where((F.col("p") != T.SAME_AS) | (F.col("s") != F.col("o"))))
            continue
        edges = {p: edges_of(out, p) for p in rules.transitive}
        far = [_pairs(closure(e), p) for p, e in edges.items() if not e.isEmpty()]
        if not far:
            break
        new = cut(functools.reduce(DataFrame.unionByName, far).join(out, ["s", "p", "o"], "left_anti").select(*T.TRIPLE))
        if new.isEmpty():
            break
        out = out.unionByName(cut(_spread(new, rules)))
    return Closed(_typed(out, rules, include_thing), canonical, schema)


def _without(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.select(*T.TRIPLE).distinct().join(known, T.TRIPLE, "left_anti").select(*T.TRIPLE)


def extend(closed: Closed, more: DataFrame, schema: DataFrame, include_thing: bool = False) -> Closed:
    """The closure of what was closed with more facts, from the new facts alone.

    Rules meet only what is new; a transitive property joins new links with known ones; a same-as link
    moves the facts of the names that it merges. If a merged name is one of a class or property, all is
    closed again.
    """
    whole = lambda: close(closed.export().unionByName(more.select(*T.TRIPLE)), schema, include_thing)
    canonical, base, rules = closed.canonical, closed.triples, rules_of(closed.schema)
    fresh = more if canonical is None else identity.canonicalise(more, canonical, predicates=True)
    delta = cut(_without(_spread(fresh, rules), base))
    while True:
        links = edges_of(delta, T.SAME_AS).where("a <> b")
        if not links.isEmpty():
            moved = identity.merge(None, links)  # of representatives
            if _ruled(closed.schema, base.unionByName(delta), moved):
                return whole()
            canonical = identity.merge(canonical, links)
            names = moved.where("id <> canonical").select("id")
            of = lambda c: F.col(c) == F.col("id")
            touched = cut(base.join(names, of("s"), "left_semi").unionByName(base.join(names, of("o") & (F.col("o_kind") != "literal"), "left_semi")).distinct())
            base = cut(_without(base, touched))
            renamed = identity.canonicalise(delta.unionByName(touched), moved)
            delta = cut(_without(renamed.where((F.col("p") != T.SAME_AS) | (F.col("s") != F.col("o"))), base))
            continue
        found = []
        for p in rules.transitive:
            new, old = edges_of(delta, p), edges_of(base, p)
            if new.isEmpty():
                continue
            known = old.union(new)
            step = lambda x, y: x.select("a", F.col("b").alias("m")).join(y.withColumnRenamed("a", "m"), "m").select("a", "b")
            found.append(_pairs(step(new, known).union(step(known, new)).distinct().join(known, ["a", "b"], "left_anti"), p))
        if not found:
            break
        far = cut(_without(_without(_spread(functools.reduce(DataFrame.unionByName, found), rules), base), delta))
        if far.isEmpty():
            break
        delta = cut(delta.unionByName(far))
    return Closed(base.unionByName(_without(_typed(delta, rules, include_thing), base)), canonical, closed.schema)


def same_as_components(triples: DataFrame) -> DataFrame:
    """(id, canonical): the smallest name of each same-as component."""
    return components(edges_of(triples, T.SAME_AS).where("a <> b"))


def violations(closed: DataFrame | Closed, schema: DataFrame) -> DataFrame:
    """(rule, s, detail) of broken axioms, over things rather than names.

    disjoint: things of two classes that disjointWith or AllDisjointClasses sets apart, under their
    representative; different: names of one thing, through any chain of same-as links, of which
    differentFrom or AllDifferent says that they differ. closed: triples, or the result of close().
    """
    schema = held(schema)
    facts = closed.triples if isinstance(closed, Closed) else closed
    canonical = closed.canonical if isinstance(closed, Closed) else None
    links = edges_of(facts, T.SAME_AS).union(edges_of(schema, T.SAME_AS)).where("a <> b")
    if not links.isEmpty():
        canonical = identity.merge(canonical, links)
    lists = list_members(schema)

    def apart(kind: str, *links: str) -> DataFrame:
        """Pairs of the members of each list of an axiom of a kind, lesser name first."""
        axioms = edges_of(schema, T.TYPE).where(F.col("b") == T.OWL + kind).select(F.col("a").alias("axiom"))
        heads = functools.reduce(DataFrame.union, (edges_of(schema, T.OWL + x) for x in links)).select(F.col("a").alias("axiom"), F.col("b").alias("head"))
        members = axioms.join(heads, "axiom").join(lists, "head").select("axiom", "member")
        return members.withColumnRenamed("member", "class").join(members.withColumnRenamed("member", "other"), "axiom").where("class < other").select("class", "other")

    typed = facts.where(F.col("p") == T.TYPE).select("s", F.col("o").alias("class")).distinct()
    pairs = edges_of(schema, T.DISJOINT).toDF("class", "other").union(apart("AllDisjointClasses", "members")).distinct()
    if canonical is not None:
        typed = identity.renamed(identity.renamed(typed, "s", canonical), "class", canonical).distinct()
        pairs = identity.renamed(identity.renamed(pairs, "class", canonical), "other", canonical).distinct()
    pairs = _small(pairs)
    # what is in no disjoint class is left out before the self-join
    set_apart = pairs.select(F.explode(F.array("class", "other")).alias("class")).distinct()
    typed = typed.join(_small(set_apart), "class", "left_semi")
    both = typed.join(pairs, "class").join(typed.withColumnRenamed("class", "other"), ["s", "other"])
    found = both.select(F.lit("disjoint").alias("rule"), "s", F.concat_ws(" ", "class", "other").alias("detail"))
    differ = edges_of(schema, T.OWL + "differentFrom").union(edges_of(facts, T.OWL + "differentFrom")).toDF("class", "other").union(apart("AllDifferent", "members", "distinctMembers"))
    differ = differ.select(F.least("class", "other").alias("s"), F.greatest("class", "other").alias("other")).distinct()
    one, two = differ.withColumn("_a", F.col("s")).withColumn("_b", F.col("other")), ("_a", "_b")
    if canonical is not None:
        for c in two:
            one = identity.renamed(one, c, canonical)
    return found.union(one.where("_a = _b").select(F.lit("different").alias("rule"), "s", F.col("other").alias("detail"))).distinct()


def lifted_schema(schema: DataFrame) -> DataFrame:
    """The schema with domains and ranges of super-classes, and those of super-properties."""
    schema = held(schema)
    up_c, up_p = schema_closure(edges_of(schema, T.SUB_CLASS)), schema_closure(edges_of(schema, T.SUB_PROPERTY))
    out = schema.select(*T.TRIPLE)
    for p in (T.DOMAIN, T.RANGE):
        own = edges_of(schema, p).select(F.col("a").alias("prop"), F.col("b").alias("class"))
        both = own.union(up_p.join(own.withColumnRenamed("prop", "b"), "b").select(F.col("a").alias("prop"), "class")).distinct()
        full = both.union(both.join(up_c.withColumnRenamed("a", "class"), "class").select("prop", F.col("b").alias("class"))).distinct()
        out = out.unionByName(full.select(F.col("prop").alias("s"), F.lit(p).alias("p"), F.col("class").alias("o"), F.when(F.startswith("class", F.lit("_:")), "bnode").otherwise("uri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")))
    return out.distinct()


def over_maximum(closed: DataFrame, schema: DataFrame) -> DataFrame:
    """(rule, s, detail): members of a class with more values of a property than its maximum cardinality.

    Reported, not repaired: two values are never made the same.
    """
    schema = held(schema)
    of = lambda p: schema.where(F.col("p") == T.OWL + p).select("s", F.col("o").alias(p))
    limits = of("onProperty").join(of("maxCardinality"), "s").select(F.col("s").alias("b"), F.col("onProperty").alias("p"), F.expr("try_cast(maxCardinality AS int)").alias("most"))
    rules = edges_of(schema, T.SUB_CLASS).join(limits, "b").select(F.col("a").alias("class"), "p", "most").distinct()
    members = closed.where(F.col("p") == T.TYPE).select("s", F.col("o").alias("class")).distinct()
    numbers = closed.join(_small(rules.select("p").distinct()), "p", "left_semi").groupBy("s", "p").agg(F.count_distinct("o", "o_kind", "o_dt", "o_lang").alias("n"))
    return numbers.join(_small(rules), "p").where("n > most").join(members, ["s", "class"]).select(F.lit("maximum").alias("rule"), "s", F.col("p").alias("detail")).distinct()
