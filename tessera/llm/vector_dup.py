"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors of a label are grouped first. Centroids are fitted on a bounded sample (``SAMPLE``
vectors); every vector goes to its nearest cell and to those nearly as near (``PROBE``), so that
close pairs meet though a border lies between them. Within a label and cell, vectors are dealt into
blocks of about ``BLOCK``, and each pair of blocks is one task's matrix product, so no cell has to
fit in a task. A pair is counted in the first cell that both are in. One vector of each group of
linked vectors, the smallest id, is kept.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and those without a
label, link with nothing; vectors of different lengths don't link; rows of one id share its links;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, written
from tessera.llm.graph import components, lookup

COSINE = 0.93
#: Vectors per cell aimed at, most vectors that centroids are fitted on, and rounds of fitting.
PER_CELL, SAMPLE, FITS = 16384, 20_000, 12
#: A vector is also put in cells whose cosine is so little below its nearest one's.
PROBE = 0.18
BLOCK = 1024


def centroids(x: np.ndarray, k: int, rounds: int = FITS, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit rows."""
    g = np.random.default_rng(seed)
    c = x[g.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-9
        sums[empty] = x[g.choice(len(x), int(empty.sum()))] if empty.any() else sums[empty]
        norm[empty] = 1.0
        c = sums / norm[:, None]
    return c


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the edges (a, b) connect, at most one for each vertex."""
    parent: dict[int, int] = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        p, q = find(u), find(v)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def links(reps: DataFrame, cells: np.ndarray, total: int) -> DataFrame:
    """(a, b, n): partial link counts n of a (b null), and edges that connect what is linked."""
    spark = reps.sparkSession
    held = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            if len(v) != held.value.shape[1] or not len(held.value):
                out.append([0])
                continue
            s = held.value @ (np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)))
            out.append(np.flatnonzero(s >= s.max() - PROBE).astype(np.int32))
        return pd.Series(out)

    placed = written(reps.withColumn("cells", near("embedding")).withColumn("dim", F.size("embedding")))
    dealt = placed.withColumn("cell", F.explode("cells")).withColumn("g", F.concat_ws(":", "label", "dim", "cell"))
    sizes = written(dealt.groupBy("g").agg(F.count("*").alias("n_g")))
    rows = sizes.agg(F.coalesce(F.sum("n_g"), F.lit(0))).first()[0]
    sized = lookup(dealt, sizes, "g", "n_g", rows)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_g") / BLOCK)).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # a vector is sent to each pair of blocks that has its own
    paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("g", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "vec_id", "embedding", "n", "cells", "cell")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, cell = pdf.lo.iloc[0], pdf.hi.iloc[0], pdf.cell.iloc[0]
        pdf = pdf.sort_values("vec_id")
        left, right = pdf[pdf.mine == lo], pdf[pdf.mine == hi]
        x, y = unit(left.embedding), unit(right.embedding)
        ids_x, ids_y = left.vec_id.to_numpy(), right.vec_id.to_numpy()
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        i, j = np.nonzero(x @ y.T >= COSINE)
        if lo == hi:
            i, j = i[i < j], j[i < j]
        # of several cells that both are in, the first counts the pair
        cx, cy = left.cells.to_numpy(), right.cells.to_numpy()
        one_x, one_y = np.array([len(c) == 1 for c in cx]), np.array([len(c) == 1 for c in cy])
        mine = one_x[i] | one_y[j]
        for k in np.flatnonzero(~mine):
            mine[k] = np.intersect1d(cx[i[k]], cy[j[k]])[0] == cell
        i, j = i[mine], j[mine]
        n_x, n_y = left.n.to_numpy(), right.n.to_numpy()
        a = np.concatenate([ids_x[i], ids_y[j]])
        counts = pd.Series(np.concatenate([n_y[j], n_x[i]])).groupby(a).sum()
        edges = _forest(ids_x[i], ids_y[j])
        return pd.DataFrame({"a": [*counts.index, *(e[0] for e in edges)], "b": pd.array([None] * len(counts) + [e[1] for e in edges], "Int64"), "n": [*counts, *[0] * len(edges)]})

    return paired.groupBy("g", "lo", "hi").applyInPandas(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding")
    number = F.transform(e, lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(number, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding"), F.col("label"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = written(rows.withColumn("key", F.when(F.col("fine"), F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string"))))))
    good = rows.where("fine")
    total = good.count()
    groups = written(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("label").alias("label"), F.min("embedding").alias("embedding")))
    reps = groups.select(F.col("rep").alias("vec_id"), "label", "embedding", F.col("copies").alias("n"))
    n_reps = reps.count()
    size = groups.agg(F.mode(F.size("embedding"))).first()[0] or 1
    picked = reps.where(F.size("embedding") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    cells = centroids(unit([r.embedding for r in picked]), 1 + -(-n_reps // PER_CELL)) if picked else np.zeros((1, size))
    found = written(links(reps, cells, total))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    done = groups.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    done = written(done.select("key", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = lookup(good.select("vec_id", "key"), done, "key", "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same rows by comparing all pairs of a label, in DuckDB's SQL.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, r) AS (SELECT a, a FROM links UNION SELECT id, b FROM reach JOIN links ON r = a),
least_of AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
many AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN many ON many.id = vec_id LEFT JOIN least_of ON least_of.id = vec_id
"""
