"""Near-duplicate documents by ProbMinHash.

Shingles of five words, weighted by how often they occur, arrive as Poisson processes with rates in
proportion to their weights; each arrival goes to one of ``REGISTERS`` registers, which keeps the
shingle of its earliest. Arrivals are generated only as long as they can still be the earliest of
some register. Two registers agree with the probability Jaccard similarity of the documents.

Registers are banded; documents that agree in a band share a bucket. Buckets are not expanded into
pairs: each bucket's members are compared with one leader, first the most central one (which shares
the largest buckets), then another of those outside the largest component, and links merge
components. Only buckets that still hold two components go on. What is open after ``LEADERS`` rounds
is settled in full: each member outside its bucket's largest component meets all other members, as
blocks of bounded size. A comparison first counts equal registers, then takes the exact similarity
from the shingles. Documents that repeat a shingle have a second signature of unit weights, with
bands of its own, for plain Jaccard. A link has probability Jaccard (of weights) or plain Jaccard
(of sets) of at least ``SIMILARITY``.

Copies of one text are grouped beforehand, so large groups of copies cost one comparison.

Edge cases: fewer than five words make one shingle; texts without words are alike only if they are
equal; null texts are like nothing; rows that share an id share a class; null ids have no class.
Words are as in decontamination (A-Z lower-cased; letters, digits, non-ASCII).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, fresh, shared_dir, utf8, written
from tessera.llm.decontaminate import words
from tessera.llm.graph import components, lookup

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4: at similarity 0.8 a pair shares no bucket in 3 of 100,000 cases.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Pairs with fewer equal registers are not compared exactly: 4.5 standard deviations at 0.8.
LEAST_EQUAL = 48
#: Rounds of leaders before the members left outside are settled in full; it changes no result.
LEADERS = 2
#: Members of a block.
BLOCK = 128
#: Distinct texts whose signatures a worker keeps for copies; it bounds memory, not results.
KEPT = 2000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWERS = np.array([pow(0x5851F42D4C957F2D, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word hashes, kept for words seen before; emptied when large."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
#: Signatures by text hash, of texts seen lately.
_signed: dict = {}


def _forget() -> None:
    _hashes.clear()
    _signed.clear()


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, their counts)."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.zeros(SHINGLE - len(h), np.uint64)])
    n = len(h) - SHINGLE + 1
    s = h[:n] * _POWERS[0]
    for k in range(1, SHINGLE):
        s = s + h[k : k + n] * _POWERS[k]
    s = mix(s)
    s.sort()
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return s[first], np.diff(np.append(first, len(s)))


def signature(elements: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """For each register the (lower half of the) element that arrives first."""
    best, held = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, live, rate, step = np.zeros(len(elements)), elements, weights.astype(float), 0
    while len(live):
        k = max(1, 2 * m // len(live))  # arrivals of each element in this round
        seed = mix(live[:, None] + _M[1] * np.arange(step + 1, step + k + 1, dtype=np.uint64))
        step += k
        gap = -np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        time = at[:, None] + np.cumsum(gap, 1)
        register = (mix(seed ^ _M[2]) % np.uint64(m)).astype(np.int64)
        limit = best.max()
        e, r = np.nonzero(time < limit)
        t, to = time[e, r], register[e, r]
        order = np.argsort(-t, kind="stable")  # the earliest is assigned last and stays
        t, to, e = t[order], to[order], e[order]
        wins = t < best[to]
        t, to, e = t[wins], to[wins], e[wins]
        best[to], held[to] = t, live[e]
        at = time[:, -1]
        go = at < best.max()
        live, at, rate = live[go], at[go], rate[go]
    return held.astype(np.uint32)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The larger of probability Jaccard (weights) and Jaccard (sets) of two sorted shingle arrays."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    i = np.flatnonzero(b[at] == a)
    j = at[i]
    plain = len(i) / (len(a) + len(b) - len(i))
    if plain >= SIMILARITY or not len(i) or (len(x) == x.sum() and len(y) == y.sum()):
        return plain
    x, y = x.astype(float), y.astype(float)
    xi, yi = x[i], y[j]
    order = np.argsort(xi / yi, kind="stable")
    ratio, xs, ys = (xi / yi)[order], xi[order], yi[order]
    only_x, only_y = x.sum() - xi.sum(), y.sum() - yi.sum()
    lo = np.searchsorted(ratio, ratio, "left")
    above = np.append(np.cumsum(xs[::-1])[::-1], 0)[lo] + only_x
    below = np.append(0, np.cumsum(ys))[lo] + only_y
    return max(plain, float((1 / (above / xs + below / ys)).sum()))


def signatures(docs: DataFrame) -> DataFrame:
    """id, text_hash, sig, unit for each row with an id and a text.

    unit is the signature of unit weights, null where it is the same as sig.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.md5("text"))

    def over(batch):
        sig, unit = [], []
        for t, h in zip(utf8(batch), batch.column("text_hash").to_pylist()):
            if h not in _signed:
                if len(_signed) >= KEPT:
                    _signed.clear()
                e, w = shingles(t)
                _signed[h] = (signature(e, w).astype(np.int32) if len(e) else None, signature(e, np.ones_like(w)).astype(np.int32) if w.sum() > len(w) else None)
            sig.append(_signed[h][0])
            unit.append(_signed[h][1])
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(sig, pa.list_(pa.int32())), pa.array(unit, pa.list_(pa.int32()))], names=["id", "text_hash", "sig", "unit"])

    return arrow_map(rows, over, "id long, text_hash string, sig array<int>, unit array<int>", done=_forget)


def _shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, sh, w (binary arrays) of the documents whose ids are in ids.

    sh holds the upper halves of the hashes, in order; w is empty where each shingle occurs once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text IS NOT NULL").join(ids, "id", "left_semi")

    def over(batch):
        done = [shingles(t) for t in utf8(batch)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s, _ in done], pa.binary()), pa.array([b"" if len(w) == w.sum() else w.astype(np.uint32).tobytes() for _, w in done], pa.binary())], names=["id", "sh", "w"])

    return arrow_map(rows, over, "id long, sh binary, w binary", done=_forget)


def _verify(pairs: DataFrame, sketch: DataFrame, shingle_table: DataFrame) -> DataFrame:
    """The pairs (a, ca, b, cb) whose documents a and b are similar enough.

    Pairs meet their documents one after the other; leaders that many pairs share are broadcast
    (``lookup``), a bounded number of them.
    """

    def of(table, columns, side):
        return table.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))

    def met(pairs, table, columns, hot):
        uses = pairs.groupBy("b").agg(F.count("*").alias("uses"))
        with_a = pairs.join(of(table, columns, "a").hint("merge"), "a")
        return lookup(with_a, of(table, columns, "b").join(uses, "b"), "b", "uses", pairs.count(), hot).drop("uses")

    def equal(p, q):
        return F.size(F.filter(F.zip_with(p, q, lambda p, q: p == q), lambda e: e))

    plain = equal(F.coalesce("unit_a", "sig_a"), F.coalesce("unit_b", "sig_b"))
    near = written(met(pairs, sketch, ["sig", "unit"], 1 / 1000).where((equal("sig_a", "sig_b") >= LEAST_EQUAL) | (plain >= LEAST_EQUAL)).select("a", "ca", "b", "cb"))

    def over(batch):
        cols = [batch.column(c).to_pylist() for c in ("sh_a", "w_a", "sh_b", "w_b")]
        ints = lambda x: np.frombuffer(x, np.uint32)
        weights = lambda w, s: ints(w) if w else np.ones(len(s) // 4, np.uint32)
        keep = [similarity(ints(a), weights(x, a), ints(b), weights(y, b)) >= SIMILARITY for a, x, b, y in zip(*cols)]
        return batch.select(["a", "ca", "b", "cb"]).filter(pa.array(keep, pa.bool_()))

    full = met(near, shingle_table, ["sh", "w"], 1 / 100)
    return arrow_map(full.select("a", "ca", "b", "cb", "sh_a", "w_a", "sh_b", "w_b"), over, "a long, ca long, b long, cb long")


def _within(table: pa.Table) -> pa.Table:
    """Links that join the components of a block of outsiders and a block of members: a forest.

    A pair that shares several buckets is compared in the one with the least key.
    """
    key, comps = table["key"][0].as_py(), table["c"].to_numpy()
    ids, outer, inner = table["id"].to_numpy(), table["outer"].to_numpy(zero_copy_only=False), table["inner"].to_numpy(zero_copy_only=False)
    sigs = table["sig"].to_pylist()
    sig, unit = np.array(sigs, np.int32), np.array([u or s for u, s in zip(table["unit"].to_pylist(), sigs)], np.int32)
    plain_too = (sig != unit).any()
    keys = [set(k) for k in table["keys"].to_pylist()]
    sh = [np.frombuffer(x, np.uint32) for x in table["sh"].to_pylist()]
    weights = [np.frombuffer(x, np.uint32) if x else np.ones(len(s), np.uint32) for x, s in zip(table["w"].to_pylist(), sh)]
    cols = np.flatnonzero(inner)
    across, across_unit, roots, found = sig[cols], unit[cols], comps.copy(), []
    for r in np.flatnonzero(outer):
        near = (across == sig[r]).sum(1) >= LEAST_EQUAL
        if plain_too:
            near |= (across_unit == unit[r]).sum(1) >= LEAST_EQUAL
        for k in cols[near & (roots[cols] != roots[r])]:
            if roots[k] != roots[r] and min(keys[r] & keys[k]) == key and similarity(sh[r], weights[r], sh[k], weights[k]) >= SIMILARITY:
                found.append((comps[r], comps[k]))
                roots[roots == roots[k]] = roots[r]
    return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("ca", "cb"))})


def _settle(now: DataFrame, open_: DataFrame, total: int, sketch: DataFrame, shingle_table: DataFrame) -> DataFrame:
    """Links (ca, cb) that join the components in open buckets (key, n, largest, inside, members).

    A member outside its bucket's largest component meets every member of the bucket in the group of
    their blocks, in Python; no rows of pairs are made and no task holds a bucket. Of buckets with
    the same members the one with the least key is taken.
    """
    taken = open_.groupBy("n", "members").agg(F.min("key").alias("key"), F.max("largest").alias("largest"), F.max("inside").alias("inside"))
    blocks, outs = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int")
    placed = lookup(now.select("key", "id", "c"), taken.drop("members"), "key", "n", total).select("key", "id", "c", (F.col("c") != F.col("largest")).alias("out"), blocks.alias("blocks"), outs.alias("outs"))
    hashed = F.xxhash64("id")
    sides = F.array(F.struct(F.lit(True).alias("outer"), F.col("blocks").alias("times")), F.struct(F.lit(False).alias("outer"), F.col("outs").alias("times")))
    both = placed.withColumn("side", F.explode(F.filter(sides, lambda x: F.col("out") | ~x["outer"])))
    met = both.select("key", "id", "c", "side.outer", (~F.col("side.outer")).alias("inner"), F.pmod(hashed, F.when(F.col("side.outer"), F.col("outs")).otherwise(F.col("blocks"))).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), F.col("side.times") - 1)).alias("other"))
    met = met.select("key", "id", "c", "outer", "inner", F.when(F.col("outer"), F.col("at")).otherwise(F.col("other")).alias("i"), F.when(F.col("outer"), F.col("other")).otherwise(F.col("at")).alias("j"))
    full = met.join(sketch.join(shingle_table.hint("merge"), "id").hint("merge"), "id")
    return full.groupBy("key", "i", "j").applyInArrow(_within, "ca long, cb long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of (smallest id with the same text), class_id (smallest id of the class), kept.

    One row per row of docs.
    """
    spark = docs.sparkSession
    paths: dict[int, str] = {}

    def keep(df):
        path = shared_dir(spark)
        out = written(df, path)
        paths[id(out)] = path
        return out

    def drop(*dfs):
        discard(spark, *(paths[id(d)] for d in dfs))

    signed = keep(signatures(docs))
    total = signed.count()
    groups = keep(signed.groupBy("text_hash").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("sig").alias("sig"), F.min("unit").alias("unit")))
    bands = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice(c, i * ROWS + 1, ROWS)))
    band = F.when(F.col("unit").isNull(), bands("sig")).otherwise(F.array_union(bands("sig"), bands("unit")))
    reps = groups.where("sig IS NOT NULL").groupBy(F.col("rep").alias("id")).agg(F.min(F.struct("sig", "unit")).alias("s")).select("id", "s.sig", "s.unit").withColumn("keys", band)
    banded = reps.select("id", F.explode("keys").alias("key"))
    shared = keep(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = keep(lookup(banded, shared, "key", "n", 2 * total * BANDS).select("key", "id", "n"))
    labels = None
    if buckets.limit(1).count():
        # documents that share large buckets are in the middle of their group: good leaders
        middle = keep(buckets.groupBy("id").agg(F.sum("n").alias("weight")))
        now = keep(buckets.select("key", "id").join(middle.hint("merge"), "id").withColumn("c", F.col("id")))
        sketch = keep(reps.join(middle.hint("merge"), "id", "left_semi"))
        shingle_table = keep(_shingle_table(docs, middle.select("id")).dropDuplicates(["id"]))
        drop(shared, buckets)
        for t in range(LEADERS + 1):
            # a component's share of a bucket, and its most central member
            per = now.groupBy("key", "c").agg(F.count("*").alias("m"), F.max(F.struct("weight", F.xxhash64("id"), F.col("id").alias("b"))).alias("top"), F.bit_xor(F.xxhash64("id")).alias("members"))
            ranked = per.groupBy("key").agg(
                F.sum("m").alias("n"), F.count("*").alias("cs"), F.bit_xor("members").alias("members"), F.max(F.struct("m", "c")).alias("large"),
                F.max(F.struct("top.weight", "top.b", "c")).alias("first"), F.max_by(F.struct("top.b", "c"), F.struct(F.lit(0) - F.col("m"), "top.weight", "top.b")).alias("other"),
            ).where("cs > 1")
            leader = F.col("other") if t else F.col("first")
            open_ = keep(ranked.select("key", "n", "members", F.col("large.c").alias("largest"), F.col("large.m").alias("inside"), leader["b"].alias("b"), leader["c"].alias("cb")))
            n_open = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if not n_open:
                break
            if t:  # closed buckets are left behind
                left = keep(lookup(now, open_.select("key", "n"), "key", "n", n_open).drop("n"))
                drop(now)
                now = left
            if t == LEADERS:
                new = keep(_settle(now, open_, n_open, sketch, shingle_table))
            else:
                rest = now.select(F.col("id").alias("a"), F.col("c").alias("ca"), "key")
                pairs = keep(lookup(rest, open_.select("key", "n", "b", "cb"), "key", "n", n_open).where("ca <> cb").select("a", "ca", "b", "cb").distinct())
                new = keep(_verify(pairs, sketch, shingle_table))
                drop(pairs)
            merged = components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
            drop(new, open_)
            if merged.limit(1).count():
                step = merged.withColumnRenamed("id", "c")
                if labels is None:
                    labels = merged
                else:
                    moved = labels.withColumnRenamed("component", "c").join(step, "c", "left").select("id", F.coalesce("component", "c").alias("component"))
                    # an id that had no label has itself as component
                    labels = keep(moved.unionByName(merged.join(labels.select("id"), "id", "left_anti")))
                if t < LEADERS:
                    relabelled = keep(now.join(step.hint("merge"), "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component"))
                    drop(now)
                    now = relabelled
        drop(now, middle, sketch, shingle_table)
    best = groups.select("text_hash", "n", "rep")
    if labels is not None:
        best = best.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("text_hash", "n", "rep", F.coalesce("component", "rep").alias("class_id"))
    else:
        best = best.withColumn("class_id", F.col("rep"))
    best = keep(best)
    out = signed.select(F.col("id").alias("doc_id"), "text_hash")
    found = lookup(out, best, "text_hash", "n", total).select("doc_id", F.col("rep").alias("copy_of"), "class_id")
    bare = docs.where("text IS NULL OR doc_id IS NULL").select(*(F.col("doc_id").cast("long").alias(c) for c in ("doc_id", "copy_of", "class_id")))
    return found.unionByName(bare).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the rows whose id is the smallest of the class.

    Rows that repeat an id stay or go together; rows without an id stay.
    """
    gone = fresh("gone", docs.columns)
    dropped = classes(docs).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == F.col(gone), "left_anti")
