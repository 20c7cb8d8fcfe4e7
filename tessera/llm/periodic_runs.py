"""Periodic runs of words in whole texts, found on a harmonic grid of period and place.

A run of period q and at least three periods holds two grid points k*q and (k+1)*q for some k. For all
(period, grid point) pairs of a text at once, prefix hashes of word numbers in NumPy tell by binary
search how far the words q apart agree to the right and to the left; what is long enough is a run.
There are n/1 + n/2 + ... = O(n log n) pairs of n words. Hashes only ever overrate an agreement, so no
run is lost; each distinct run is verified word by word, and pairs behind one that fails are measured
word by word instead. A stretch found for several periods keeps the least.

Edge cases: a null or empty text has no words and no run; long texts are gone through in blocks of
periods (MOST_PAIRS pairs at a time, the same result for any block size); equal exponents are settled
by start, then period, in exact integers. Rows are independent: repeated rows, null ids (hashed as
the empty string), empty tables and other columns need no care.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, utf8

LEAST_WORDS, LEAST_PERIODS = 24, 3

#: Pairs of period and grid point that are held at once.
MOST_PAIRS = 1 << 20

#: Odd multiplier of the prefix hashes, and the seed of the numbers that stand for words.
BASE, SEED = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 0 on."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(SEED)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Prefix hashes modulo 2^64: are two stretches of one text alike?"""

    def __init__(self, ids: np.ndarray, base: int = BASE):
        self.power = np.full(len(ids) + 1, base, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(_mixed(ids) * self.power[:-1], out=self.sums[1:])

    def alike(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """[i, i+length) against the same stretch q further on."""
        here, there = self.sums[i + length] - self.sums[i], self.sums[i + q + length] - self.sums[i + q]
        return here * self.power[q] == there


def _longest(most: np.ndarray, alike) -> np.ndarray:
    """For each pair the greatest length up to most for which alike(pairs, length) holds; 0 always does."""
    low, high = np.zeros_like(most), most.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_] + 1) >> 1
        ok = alike(open_, mid)
        low[open_[ok]] = mid[ok]
        high[open_[~ok]] = mid[~ok] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def _plain(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """Start and end of the stretch of period q around i and i+q, word by word."""
    right = np.flatnonzero(ids[i : len(ids) - q] != ids[i + q :])
    left = np.flatnonzero(ids[:i] != ids[q : q + i])
    return int(left[-1]) + 1 if len(left) else 0, (i + int(right[0]) if len(right) else len(ids) - q) + q


def find(ids: np.ndarray, base: int = BASE, most_pairs: int = MOST_PAIRS) -> np.ndarray:
    """Rows (start, length, period) of every run, by start, then period."""
    n, none = len(ids), np.zeros((0, 3), np.int64)
    if n < LEAST_WORDS:
        return none
    hashes, runs = Hashes(ids, base), {}
    top, low = n // LEAST_PERIODS, 1
    counts = (n - 1) // np.arange(1, top + 1)  # grid points k*q with k*q + q < n
    ends = np.cumsum(counts)
    while low <= top:
        done = ends[low - 2] if low > 1 else 0
        high = max(low, int(np.searchsorted(ends, done + most_pairs, "right")))
        many = counts[low - 1 : high]
        q = np.repeat(np.arange(low, high + 1), many)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)) * q
        low = high + 1
        meet = ids[i] == ids[i + q]  # both lie in the run
        q, i = q[meet], i[meet]
        right = _longest(n - i - q, lambda k, m, i=i, q=q: hashes.alike(i[k], q[k], m))
        # the stretch that ends before i and has to reach back to a length of LEAST_* at least
        near = right + i + q >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        q, i, right = q[near], i[near], right[near]
        left = _longest(i, lambda k, m, i=i, q=q: hashes.alike(i[k] - m, q[k], m))
        long = left + right + q >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        q, i, left, right = q[long], i[long], left[long], right[long]
        rows, where = np.unique(np.stack([i - left, i + q + right, q], 1), axis=0, return_inverse=True)
        where = where.reshape(-1)
        for k, (start, end, period) in enumerate(rows.tolist()):
            if period % runs.get((start, end), period + 1) == 0:
                continue  # a multiple of the stretch's own period
            if np.array_equal(ids[start : end - period], ids[start + period : end]):
                found = [(start, end)]
            else:
                found = {_plain(ids, int(at), period) for at in i[where == k]}
            for x in found:
                if x[1] - x[0] >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    runs[x] = min(period, runs.get(x, period))
    return np.array(sorted((s, e - s, p) for (s, e), p in runs.items()), np.int64).reshape(-1, 3)


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties by start, then period. Exact in integers."""
    if not len(runs):
        return None
    rate = runs[:, 1] / runs[:, 2]
    best = None
    for start, length, period in runs[rate >= rate.max() * (1 - 1e-9)].tolist():
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def planted(n: int, doc_id) -> np.ndarray | None:
    """Places of the words that stand in for a document's words, where the contract plants a run."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def runs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, period): every run of every document, as it stands."""

    def over(batch):
        ids, at, rows = batch.column(0), [], []
        for k, t in enumerate(utf8(batch)):
            got = find(numbered(t.split()))
            at += [k] * len(got)
            rows.append(got)
        rows = np.concatenate([*rows, np.zeros((0, 3), np.int64)])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(rows[:, j]) for j in range(3))], ["doc_id", "start", "length", "period"])

    few = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return arrow_map(few, over, f"doc_id {few.schema[0].dataType.simpleString()}, start long, length long, period long")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each run cut to its first period; words of a changed text are joined by one space.

    Texts without a run, null among them, stay as they are.
    """
    at = docs.columns.index(text)

    def over(batch):
        out = []
        for t in batch.column(at).to_pylist():
            words = (t or "").encode().split()
            runs = find(numbered(words))
            out.append(b" ".join(w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k).decode() if len(runs) else t)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.column(at).type))

    return arrow_map(docs, over, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and hashes of all runs and of the collapsed text.

    Documents are taken with the contract's planted runs (see planted()).
    """

    def over(batch):
        out: list[list] = [[] for _ in range(7)]
        for doc_id, t in zip(batch.column(0).to_pylist(), utf8(batch), strict=True):
            words = t.split()  # of bytes: at the six ASCII white spaces
            ids, places = numbered(words), planted(len(words), doc_id)
            if places is not None:
                ids, words = ids[places], [words[k] for k in places.tolist()]
            runs = find(ids)
            best = strongest(runs)
            if len(runs):
                words = [w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k]
            row = [len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]]
            row.append(hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs.tolist()).encode()).hexdigest())
            row.append(hashlib.sha256(b" ".join(words)).hexdigest())
            for column, v in zip(out, row, strict=True):
                column.append(v)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names)

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, over, f"doc_id {docs.schema[0].dataType.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
