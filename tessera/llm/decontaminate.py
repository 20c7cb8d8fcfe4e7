"""Benchmark decontamination with training suffix arrays.

Training text is cut into shards (batches of whole documents on the executors). Each shard gets a
suffix array over its words; every suffix of the test items is binary-searched in it, which gives
its longest verbatim match and the range of training positions that share its first words. The
test side is sent in blocks of bounded size, so it may grow without one broadcast growing with it.

Definitions: A-Z is lower-cased; words are maximal runs of ASCII letters, digits and non-ASCII
characters. A window is ``window`` consecutive words of an item; an item with fewer words (but not
none) is one window. Document words inside any occurrence of any window are hit.

Edge cases: null and word-less texts have no words and no hits; an empty benchmark hits nothing;
null item_ids are reported as the text "null"; repeated items count once per row of the benchmark.
Documents of one id are judged row by row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, utf8

WINDOW = 10
#: Bytes of test text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Bytes of training text in one shard, unless a single document is longer.
SHARD_BYTES = 4 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _LOWER)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class Tests:
    """One block of test items: its vocabulary, windows, and its suffixes coded by word number.

    Words are numbered from 1 over the block's own vocabulary; every training word outside it is 0
    and ends a match, as does an item's end.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded, self.ids = [], []
        for item, text in items:
            if w := words(text):
                coded.append([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])
                self.ids.append(item)
        self.longest = max(map(len, coded), default=0)
        #: every test suffix: item number, its words
        self.item = np.concatenate([np.full(len(c), i) for i, c in enumerate(coded)] or [np.zeros(0, np.int64)])
        lengths = [n for c in coded for n in range(len(c), 0, -1)]
        self.length = np.array(lengths, np.int64)
        flat = np.array([x for c in coded for x in c] + [0] * (self.longest + 1), np.int64)
        self.flat, self.at = flat, np.arange(len(lengths))
        #: words that a suffix must match for a window to occur at its start; 0: none starts there
        first = np.array([n == len(c) for c in coded for n in range(len(c), 0, -1)], bool)
        self.need = np.where(self.length >= window, window, np.where(first, self.length, 0))


def suffix_array(codes: np.ndarray, depth: int, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of non-zero codes, sorted by their next ``depth`` codes (all beyond compare equal).

    Returns the sorted positions and their packed leading key. Keys of several words sort at once;
    only runs of equal keys are sorted again by the words that follow.
    """
    pos = np.flatnonzero(codes)
    bits = int(vocab).bit_length()
    step = max(1, min(62 // bits, depth))
    padded = np.concatenate([codes, np.zeros(step, np.int64)])
    key = np.zeros(len(codes), np.int64)
    going = np.ones(len(codes), bool)
    for k in range(step):  # a zero ends the suffix: nothing after it counts
        nxt = padded[k : k + len(codes)]
        going &= nxt > 0
        key = (key << bits) | np.where(going, nxt, 0)
    order = np.argsort(key[pos], kind="stable")
    sa, lead = pos[order], key[pos[order]]
    rank = lead
    low = (1 << bits) - 1
    done = step
    full = (lead & low) > 0  # a suffix that ended within its key has no words left
    while done < depth:
        same = np.concatenate([[False], (rank[1:] == rank[:-1]) & full[1:]])
        starts = np.flatnonzero(~same)
        sizes = np.diff(np.append(starts, len(sa)))
        group = np.repeat(starts, sizes)
        tied = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if not len(tied):
            break
        at = sa[tied] + done
        nxt = np.where(at < len(codes), key[np.minimum(at, len(codes) - 1)], 0)
        new = np.lexsort((nxt, group[tied]))
        sa[tied], nxt = sa[tied][new], nxt[new]
        # a new rank: the group's start, moved on where the following key changes
        changed = np.concatenate([[True], (group[tied][1:] != group[tied][:-1]) | (nxt[1:] != nxt[:-1])])
        rank = np.arange(len(sa))
        rank[:] = group
        rank[tied] = tied[np.flatnonzero(changed)][np.cumsum(changed) - 1]
        full = np.zeros(len(sa), bool)
        full[tied] = (nxt & low) > 0
        done += step
    return sa, lead


def matches(codes: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary-search every test suffix in the suffix array of one shard.

    Returns, per test suffix: the longest verbatim match in words, and the first and last-plus-one
    place in the (bounded-depth) suffix array of the positions that match ``need`` words, followed
    by the array itself as the fourth part of the tuple.
    """
    sa, lead = suffix_array(codes, tests.longest, len(tests.vocab))
    n = len(sa)
    padded = np.concatenate([codes, np.zeros(tests.longest + 1, np.int64)])

    def below(test: np.ndarray, words_: np.ndarray, after: bool) -> np.ndarray:
        """Number of suffixes that sort before each test's first words_ words (after: or match them)."""
        lo, hi = np.zeros(len(test), np.int64), np.full(len(test), n)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            p, t, w = sa[mid], tests.at[test[live]], words_[live]
            sign = np.zeros(len(live), np.int64)
            open_ = np.ones(len(live), bool)
            for k in range(int(w.max(initial=0))):
                cmp = np.flatnonzero(open_ & (k < w))
                if not len(cmp):
                    break
                d = padded[p[cmp] + k] - tests.flat[t[cmp] + k]
                sign[cmp] = np.sign(d)
                # a zero in training ends the suffix, so it sorts first
                open_[cmp[d != 0]] = False
            less = (sign < 0) | ((sign == 0) & after)
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        return lo

    every = np.arange(len(tests.at))
    place = below(every, tests.length, False)
    longest = np.zeros(len(every), np.int64)
    for side in (place - 1, place):
        ok = np.flatnonzero((side >= 0) & (side < n))
        run, k = ok, 0
        while run.size:
            run = run[k < tests.length[run]]
            run = run[padded[sa[side[run]] + k] == tests.flat[tests.at[run] + k]] if run.size else run
            k += 1
            longest[run] = np.maximum(longest[run], k)
    found = np.flatnonzero((tests.need > 0) & (longest >= tests.need))
    first, last = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    first[found] = below(found, tests.need[found], False)
    last[found] = below(found, tests.need[found], True)
    return longest, first, last, sa


def occurrences(codes: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training position, words, test item) of each window's occurrences in one shard."""
    longest, first, last, sa = matches(codes, tests)
    found = np.flatnonzero(last > first)
    count = (last - first)[found]
    test = np.repeat(found, count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return sa[first[test] + inner], tests.need[test], tests.item[test]


def _shards(docs: list[bytes], limit: int = SHARD_BYTES):
    """Runs of documents of bounded size in all; a longer document is a shard of its own."""
    start, size = 0, 0
    for i, d in enumerate(docs):
        if i > start and size + len(d) > limit:
            yield start, i
            start, size = i, 0
        size += len(d)
    if docs:
        yield start, len(docs)


def judge_shard(docs: list[bytes], tests: Tests):
    """Per document: its words, hit flags (one per word) and the items found in it."""
    get = tests.vocab.get
    found, sizes = [], []
    for d in docs:
        w = words(d)
        sizes.append(len(w))
        found.extend(map(get, w))
        found.append(None)  # documents don't run into each other
    codes = np.array([x or 0 for x in found], np.int64)
    sizes = np.array(sizes, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    marks = np.zeros(len(codes) + 1, np.int64)
    items = [set() for _ in docs]
    if len(tests.at) and len(codes):
        pos, length, item = occurrences(codes, tests)
        np.add.at(marks, pos, 1)
        np.add.at(marks, pos + length, -1)
        owner = np.searchsorted(starts, pos, "right") - 1
        for o, i in set(zip(owner.tolist(), item.tolist())):
            items[o].add(i)
    hit = np.cumsum(marks)[:-1] > 0
    return [(int(n), hit[s : s + n], it) for n, s, it in zip(sizes, starts, items)]


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The test items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator()
    for item, text in rows:
        text = (text or "").encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append(("null" if item is None else item, text))
        size += len(text)
    yield block


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nothing is shuffled: a shard is searched for the blocks one after another, and each document's
    hit words and items are joined where the document is.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in blocks_of(benchmark, block_bytes)]
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        import tessera.llm.decontaminate as here

        text = utf8(batch)
        n_words, n_hit, n_items, sha = [], [], [], []
        for a, b in _shards(text):
            n, hits, names = None, None, None
            for k, block in enumerate(blocks):
                tests = here.prepared(block, window)
                got = judge_shard(text[a:b], tests)
                if n is None:
                    n, hits, names = [g[0] for g in got], [g[1] for g in got], [[] for _ in got]
                for i, g in enumerate(got):
                    if k:
                        hits[i] = hits[i] | g[1]
                    names[i].extend(tests.ids[x] for x in g[2])
            n_words += n
            n_hit += [int(h.sum()) for h in hits]
            n_items += map(len, names)
            sha += [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), over, schema, rows=2000)


_prepared: dict = {}


def prepared(block, window: int) -> Tests:
    """The Tests of a broadcast block; a worker keeps only the last few, and no copy of the block."""
    key, items = block.value
    if (key, window) not in _prepared:
        while len(_prepared) >= 2:
            _prepared.pop(next(iter(_prepared)))
        _prepared[key, window] = Tests(items, window)
    return _prepared[key, window]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs.

    The verdict is made beside the row, so rows with equal or null ids keep their own.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in blocks_of(benchmark)]

    def over(batch: pa.RecordBatch):
        import tessera.llm.decontaminate as here

        text = utf8(batch)
        keep = np.ones(len(text), bool)
        for a, b in _shards(text):
            for block in blocks:
                keep[a:b] &= [not h.any() for _, h, _ in judge_shard(text[a:b], here.prepared(block, window))]
        return batch.filter(pa.array(keep))

    return arrow_map(docs, over, docs.schema, rows=2000)


#: The rows of judge() by a join of windows, in DuckDB's SQL.
ORACLE = r"""
WITH tidy AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tidy, sizes WHERE len(w) >= n)),
hits AS (SELECT id, p.n, i, item_id FROM places p JOIN windows q ON p.n = q.n AND p.s = q.s),
covered AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT id, n, i FROM hits)) GROUP BY id),
told AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT id, item_id FROM hits) GROUP BY id)
SELECT tidy.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tidy LEFT JOIN covered ON covered.id = tidy.id LEFT JOIN told ON told.id = tidy.id
"""
