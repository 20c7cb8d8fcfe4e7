"""Exact substring removal by a sparse suffix array over all documents.

Every byte that a 200-byte string covers goes, if that string starts anywhere else too. Equal strings
have equal insides, so each 200-byte string is filed under its anchor: the place of its least hashed
GRAM (64 bytes), leftmost of equals. Only suffixes at anchors are sorted (about 1.7 % of all places); strings with
one anchor are neighbours and make one stretch of text.

1. Suffixes at anchors, as key words (leading bytes, hash of the gram, hash of the stretch), are range
   partitioned by sampled splitters, ties dealt by text and place, so that no key is too hot for a
   bucket. Each bucket sorts its own by multikey quicksort and compares neighbours; what stands at the
   borders of buckets is compared across them. Stretches that occur twice are repeated whole.
2. Where one gram stands in different stretches, strings may agree in part of them. One member of each
   such stretch is fetched from its text, and all 200-byte suffixes of the stretches of a gram are
   sorted, again by multikey quicksort, on their bytes. A gram of very many stretches (Sizes.wide, or at
   a border) sends its suffixes as rows of their own through the range partitioning of step 1 instead.
3. Spans are joined to the texts by two 64-bit hashes of the text.

No group of equal suffixes is ever expanded into pairs, and each step is linear in its rows.

Edge cases: a null text is empty and loses nothing, nor does any text under 200 bytes; copies of one
text (rows of one id, too) are occurrences of their own and go whole; ids may be null or repeat, as
texts are told apart by hashes. Texts are taken in pieces of a million places, whatever their length. An
empty table gives none. Other columns of the table stay in remove(), which drops what is left of a
character cut in two. A stretch or a text is taken for another's equal by hashes of 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, fresh, release, shared_dir, ship, utf8, written

#: Bytes of a repeated string, and of the grams whose least hash is its anchor.
LENGTH, GRAM = 200, 64

#: Bytes of texts that are looked at together, and rows of a bucket on average.
BUFFER, BUCKET = 1 << 21, 1 << 20


@dataclass(frozen=True)
class Sizes:
    """What bounds a task's memory; results are the same for any values.

    piece: places of a text that are looked at together; wide: stretches of one gram above which its
    suffixes are dealt to many tasks; block: stretches sorted at a time.
    """

    piece: int = 1 << 20
    wide: int = 2000
    block: int = 10_000


SIZES = Sizes()

_U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20_011))
#: Numbers that stand for bytes, and odd multipliers, of two hashes.
_TABLES = _SEED.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]

WORDS, KEY = ["lead", "gram", "whole"], ["k1", "k2"]
ROW = "lead long, gram long, whole long, k1 long, k2 long, at long"

#: Kinds of rows that a bucket gives.
COVERED, FEW, MANY, BORDER = range(4)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


class _Rolling:
    """Hashes of any stretch of a buffer, by prefix sums modulo 2^64."""

    powers: dict = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        if len(self.powers.get(which, ((), ()))[0]) < n:
            self.powers[which] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, BUFFER), b, _U)])) for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64))]
        power, self.back = (p[:n] for p in self.powers[which])
        self.sums = np.zeros(n, _U)
        np.cumsum(_TABLES[which][data] * power[:-1], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return _spread((self.sums[stop] - self.sums[start]) * self.back[start])


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a signed number of the same order."""
    out = np.zeros(len(at), _U)
    for k in range(8):
        out = (out << _U(8)) | data[at + k]
    return (out ^ _U(1 << 63)).view(np.int64)


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """For the pieces [start, end) of a buffer: piece, first and last place of the strings of one
    anchor, and its place; then leading bytes, hash of the gram, and hash of the stretch."""
    width = LENGTH - GRAM + 1  # grams of a string
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 7
    rolling = _Rolling(data, 0)
    grams = _spread((rolling.sums[GRAM:] - rolling.sums[:-GRAM]) * rolling.back[: len(data) - GRAM + 1])
    least = (grams & ~_U((1 << 24) - 1)) | np.arange(len(grams), dtype=_U)  # the place settles ties
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n], least[width - size : width - size + n])
    anchor = (least & _U((1 << 24) - 1)).astype(np.int64)
    ok = np.zeros(n + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(ok[:n]) > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 7
    own = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    low, high = at[first], at[np.append(first[1:], len(at)) - 1]
    own = own[first]
    whole = _Rolling(data, 1).of(low, high + LENGTH) ^ _spread(((own - low).astype(_U) << _U(8)) | (high - low).astype(_U))
    return np.searchsorted(starts, low, "right") - 1, low, high, own, _words(data, own), grams[own].view(np.int64), whole.view(np.int64)


def multikey(n: int, levels: int, word) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of n keys: (order, same), where same marks keys equal to the one before.

    word(k, which) gives the k-th words of some keys. All are sorted by their first words, and only
    groups that tie in a word go on to the next.
    """
    order, same = np.arange(n), np.zeros(n, bool)
    open_, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(levels):
        if not len(open_):
            break
        w = word(k, order[open_])
        p = np.lexsort((w, group)) if k else np.argsort(w)
        w, order[open_] = w[p], order[open_][p]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (group[1:] != group[:-1])])
        same[open_] = ~new
        ids = np.cumsum(new) - 1
        tied = np.bincount(ids)[ids] > 1
        open_, group = open_[tied], ids[tied]
    return order, same


def pack(low, anchor, high):
    return (low << 16) | ((anchor - low) << 8) | (high - low)


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"), t.alias("text"))


def _pieces(texts: list[bytes], piece: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, first byte, bytes) of pieces that have each 200-byte string of a text once."""
    for k, t in enumerate(texts):
        for at in range(0, len(t) - LENGTH + 1, piece):
            yield k, at, t[at : at + piece + LENGTH - 1]


def suffixes(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """ROW for each anchor of each text (k1, k2, text)."""

    def over(batches):
        for batch in batches:
            texts, k1, k2 = utf8(batch), *(batch.column(c).to_numpy() for c in KEY)
            held: list = []

            def flush(held=held, k1=k1, k2=k2):
                ends = np.cumsum([len(p[2]) for p in held])
                starts = ends - [len(p[2]) for p in held]
                piece, low, high, own, lead, gram, whole = stretches(np.frombuffer(b"".join(p[2] for p in held), np.uint8), starts, ends)
                of, shift = np.array([p[0] for p in held])[piece], np.array([p[1] for p in held])[piece] - starts[piece]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (lead, gram, whole, k1[of], k2[of], pack(low + shift, own + shift, high + shift))], [*WORDS, *KEY, "at"])

            size = 0
            for p in _pieces(texts, sizes.piece):
                held.append(p)
                size += len(p[2])
                if size >= BUFFER // 2:
                    yield flush()
                    size = 0
            if held:
                yield flush()
        release()

    ship(docs.sparkSession)
    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(over, ROW)


def _bucket(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Sort a bucket; give its repeated stretches, members of grams with several, and its borders."""
    held = list(batches)
    if sum(b.num_rows for b in held):
        lead, gram, whole, k1, k2, at = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in [*WORDS, *KEY, "at"])
        del held
        order, same = multikey(len(at), 3, lambda k, which: (lead, gram, whole)[k][which])
        first = np.flatnonzero(~same)  # of each class of equal stretches
        n = np.diff(np.append(first, len(at)))
        a, g = lead[order[first]], gram[order[first]]
        start = np.concatenate([[True], (a[1:] != a[:-1]) | (g[1:] != g[:-1])])
        of_gram = np.cumsum(start) - 1
        classes = np.bincount(of_gram)[of_gram]
        twice = order[np.repeat(n, n) > 1]
        rows = np.unique(np.stack([k1[twice], k2[twice], at[twice]], 1), axis=0) if len(twice) else np.zeros((0, 3), np.int64)
        zero = np.zeros(len(rows), np.int64)
        parts = [(np.full(len(rows), COVERED), zero, zero, zero, *rows.T, zero, zero)]
        rim = (of_gram == 0) | (of_gram == of_gram[-1])
        for kind, which in ((FEW, ~rim & (classes > 1) & (classes <= wide)), (MANY, (classes > 1) & (rim | (classes > wide))), (BORDER, np.isin(np.arange(len(first)), (0, len(first) - 1)))):
            x = order[first[which]]
            parts.append((np.full(len(x), kind), lead[x], gram[x], whole[x], k1[x], k2[x], at[x], n[which], classes[which]))
        names = ["kind", *WORDS, *KEY, "at", "n", "classes"]
        full = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
        for s in range(0, len(full[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000]) for c in full], names)
    release()


def compared(rows: DataFrame, buckets: int, path: str, sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame]:
    """(repeated stretches: k1, k2, at; members of grams with several stretches: kind, gram, k1, k2, at).

    rows are range partitioned by all their columns. A class that is single in its bucket, but stands at
    its border, may go on in the next: borders (two rows a bucket) are compared by their words.
    """
    ship(rows.sparkSession)
    found = written(rows.repartitionByRange(buckets, *WORDS, *KEY, "at").mapInArrow(partial(_bucket, wide=sizes.wide), f"kind long, {ROW}, n long, classes long"), path)
    border = found.where(F.col("kind") == BORDER)
    total = border.groupBy(*WORDS).agg(F.sum("n").alias("total"))
    several = border.groupBy("lead", "gram").agg((F.min("whole") < F.max("whole")).alias("several"))
    settled = border.join(total, WORDS).join(several, ["lead", "gram"])
    covered = found.where(F.col("kind") == COVERED).select(*KEY, "at").unionByName(settled.where("n = 1 AND total > 1").select(*KEY, "at"))
    members = found.where(F.col("kind").isin(FEW, MANY)).select("kind", "gram", *KEY, "at")
    return covered, members.unionByName(settled.where("several AND classes = 1").select(F.lit(MANY).cast("long").alias("kind"), "gram", *KEY, "at"))


def _fetched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of texts with their members (kind, gram, at): bytes of stretches, or all suffixes of them."""
    texts, k1, k2, wanted = utf8(batch), *(batch.column(c).to_numpy() for c in KEY), batch.column("members").to_pylist()
    cut = [(k, m["at"] >> 16, m["at"] & 255, m) for k, ms in enumerate(wanted) for m in ms]
    few = [(k, low, t[low : low + wide + LENGTH], m) for k, low, wide, m in cut if m["kind"] == FEW for t in (texts[k],)]
    schema = pa.schema([("kind", pa.int64()), *((c, pa.int64()) for c in [*WORDS, *KEY, "at"]), ("piece", pa.binary())])
    if few:
        of, zero = np.array([x[0] for x in few]), np.zeros(len(few), np.int64)
        grams = np.array([x[3]["gram"] for x in few])
        yield pa.RecordBatch.from_arrays([*map(pa.array, (zero + FEW, zero, grams, zero, k1[of], k2[of], np.array([x[3]["at"] for x in few]))), pa.array([x[2] for x in few], pa.binary())], schema=schema)
    many = [(k, low, wide) for k, low, wide, m in cut if m["kind"] == MANY]
    for s in range(0, len(many), 1000):
        part = many[s : s + 1000]
        data = np.frombuffer(b"".join(texts[k][low : low + wide + LENGTH] for k, low, wide in part), np.uint8)
        size = np.array([wide + LENGTH for *_, wide in part])
        base = np.cumsum(size) - size
        count = size - LENGTH + 1
        row = np.repeat(np.arange(len(part)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = base[row] + step
        of, low = np.array([p[0] for p in part])[row], np.array([p[1] for p in part])[row] + step
        hashes = [_Rolling(data, w).of(at, at + LENGTH).view(np.int64) for w in (0, 1)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(row), MANY), _words(data, at), *hashes, k1[of], k2[of], low << 16)), pa.nulls(len(row), pa.binary())], schema=schema)


def repeated(data: np.ndarray, base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For the 200-byte suffixes at base[k], base[k]+1, ... (count[k] of them) of each stretch k, in
    order: is there another with the same bytes?"""
    at = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())
    order, same = multikey(len(at), LENGTH // 8, lambda k, which: _words(data, at[which] + 8 * k))
    out = np.zeros(len(at), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def _sorted_stretches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, k1, k2, at, piece), those of a gram together: their repeated suffixes as k1, k2, at."""

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, low, pieces = *(rows.column(c).to_numpy() for c in KEY), rows.column("at").to_numpy() >> 16, rows.column("piece").to_pylist()
        size = np.array([len(p) for p in pieces])
        count = size - LENGTH + 1
        hit = repeated(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, count)
        row = np.repeat(np.arange(len(size)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (row[1:] != row[:-1])]))
        end = np.flatnonzero(hit & np.concatenate([~hit[1:] | (row[1:] != row[:-1]), [True]]))
        r = row[begin]
        return pa.RecordBatch.from_arrays(list(map(pa.array, (k1[r], k2[r], ((low[r] + step[begin]) << 16) | (end - begin)))), [*KEY, "at"])

    held = None
    for b in batches:
        held = b if held is None else pa.concat_batches([held, b])
        if held.num_rows >= block:
            grams = held.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))  # rows are sorted by gram
            if cut:
                yield of(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield of(held)
    release()


def spans(docs: DataFrame, text: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """(k1, k2, ats): for each text with repeated strings the packed stretches of their first bytes."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text)
    paths = [shared_dir(spark) for _ in range(3)]
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    covered, members = compared(suffixes(keyed, sizes), max(least, size // 60 // BUCKET), paths[0], sizes)
    wanted = members.groupBy(*KEY).agg(F.collect_set(F.struct("kind", "gram", "at")).alias("members"))
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text"))  # one of all copies
    fetched = arrow_map(texts.join(wanted.hint("merge"), KEY), _fetched_all, f"kind long, {ROW}, piece binary")
    fetched = written(fetched, paths[1])
    few = fetched.where(F.col("kind") == FEW).select("gram", *KEY, "at", "piece").repartition("gram").sortWithinPartitions("gram")
    partly = few.mapInArrow(partial(_sorted_stretches, block=sizes.block), "k1 long, k2 long, at long")
    wide, _ = compared(fetched.where(F.col("kind") == MANY).select(*WORDS, *KEY, "at"), least, paths[2], sizes)
    every = covered.unionByName(partly).unionByName(wide)
    out = written(every.groupBy(*KEY).agg(F.collect_set("at").alias("ats")))
    discard(spark, *paths)
    return out


def _fetched_all(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    parts = list(_fetched(batch))
    return pa.concat_batches(parts) if parts else None


def _gone(n: int, ats: list[int] | None) -> list[tuple[int, int]]:
    """The maximal removed runs [start, end) of a text of n bytes."""
    out: list[tuple[int, int]] = []
    for at in sorted(ats or ()):
        low, high = at >> 16, (at >> 16) + (at & 255) + LENGTH
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _left(t: bytes, gone: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for g in gone for x in g), len(t)]
    return b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _joined(docs: DataFrame, text: str, sizes: Sizes) -> tuple[DataFrame, list[str]]:
    """docs with the stretches of their texts, in a column of a new name, and the names of its keys."""
    found, names = spans(docs, text, sizes), [fresh(c, docs.columns) for c in (*KEY, "ats")]
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({names[0]: F.xxhash64(t), names[1]: F.xxhash64(F.lit(7), t)})
    return keyed.join(found.toDF(*names).hint("merge"), names[:2], "left"), names


def remove(docs: DataFrame, text: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """docs without the bytes of repeated strings; a null text stays null."""
    full, names = _joined(docs, text, sizes)
    columns, ats_name = docs.columns, names[2]
    full = full.select(*columns, ats_name)
    at = columns.index(text)

    def over(batch):
        out = []
        for t, ats in zip(batch.column(at).to_pylist(), batch.column(ats_name).to_pylist(), strict=True):
            out.append(_left(t.encode(), _gone(len(t.encode()), ats)).decode(errors="ignore") if ats else t)
        return batch.select(columns).set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return arrow_map(full, over, docs.schema)


def digest(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    docs = docs.select("doc_id", "text")
    full, names = _joined(docs, "text", sizes)

    def over(batch):
        rows = []
        for t, ats in zip(utf8(batch), batch.column("ats").to_pylist(), strict=True):
            gone = _gone(len(t), ats)
            left = _left(t, gone)
            rows.append((len(t), len(t) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(full.select("doc_id", "text", F.col(names[2]).alias("ats")), over, f"doc_id {docs.schema[0].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
