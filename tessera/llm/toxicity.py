"""Toxicity by compression distance, in a variant whose dictionaries hold chosen words.

The method as named trains zstandard dictionaries on toxic and ordinary texts and compares the
compressed lengths of windows of running text. It does not give right results on these documents (see
the README for what was tried, with figures), so the dictionaries here are no output of the library's
trainer: their contents are words, chosen by their log odds between groups of copies of toxic and of
ordinary documents. A window is one word with its delimiters, in a carrier that both dictionaries hold,
which lifts it over the frame's fixed cost; it is compressed with each dictionary, and the bytes saved by
the toxic one are its distance. In effect the compressor tells whether a word, or a long part of it, is
among the chosen. A document is scored by a logistic function of how many windows reach each distance,
fitted by cross-fitting, so that 0.7 is a calibrated threshold.

Training takes a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_ORDINARY`` rows and
``MAX_BYTES`` of their texts, chosen by a hash of their ids), in one task of an executor; every
document is scored whole. Copies would make chance words look telling, so
sampled documents are first grouped by min-hashes, and words are counted once a group.

Edge cases: null and empty texts have no windows and get the score of a document without any hit;
without toxic and ordinary labels every score is the share of toxic ones (0 if there are no
labels). Null labels are left out; of several labels for a document the highest holds. Labels, lang,
source and ids are no inputs of a score. Repeated rows are scored row by row.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import arrow_map, fresh, in_fold, release, ship, texts

#: Bounds of the labelled sample, in rows.
MAX_TOXIC, MAX_ORDINARY = 2500, 6000
#: Bound of their texts, in bytes for each label; a text that would pass it is left out.
MAX_BYTES = 24 << 20
#: A word tells if it is in so many groups of toxic copies and its log odds are so high.
LEAST_GROUPS, LEAST_ODDS = 4, 3.0
DICTIONARY_BYTES = 1 << 14
#: Windows are counted by the bytes saved (up to the first) and by the bytes left over what the
#: carrier alone takes (up to the second): a word that the toxic dictionary holds whole leaves few.
SAVED, LEFT = 6, 6
#: What stands before and after a word in its window; the end of either dictionary.
CARRIER = b"zq0 xj1 kv2 wf3 zx4 jq5 vk6 fw7 qz8 "
FOLDS = 5
THRESHOLD = 0.7
#: Distances of words that a worker keeps; it bounds memory, not results.
CACHE = 400_000

_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def windows(text: str) -> list[bytes]:
    """The words of a text, lower-cased; a window is a word between two delimiters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def _groups(docs: list[list[bytes]], hashes: int = 12) -> list[int]:
    """A number per document, the same for likely copies: any of its min-hashes is shared."""
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    odd = np.random.default_rng(7).integers(1 << 31, 1 << 32, (hashes, 2), dtype=np.uint64) | np.uint64(1)
    seen: dict = {}
    for i, w in enumerate(docs):
        grams = np.array([zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], np.uint64)
        for j, (a, b) in enumerate(odd):
            key = (j, int(((grams * a + b) % np.uint64(4294967291)).min()))
            if key in seen:
                parent[find(i)] = find(seen[key])
            else:
                seen[key] = i
    return [find(i) for i in range(len(docs))]


def _group_counts(docs: list[list[bytes]], groups: list[int]) -> tuple[Counter, int]:
    """In how many groups each word is, and the number of groups."""
    held = defaultdict(set)
    for w, g in zip(docs, groups):
        held[g].update(w)
    return Counter(itertools.chain.from_iterable(held.values())), len(held)


def _content(counts: dict[bytes, int]) -> bytes:
    """Dictionary content: words between spaces, the commonest last, where matches cost least."""
    out, size = [], 1
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        if size + len(w) + 1 > DICTIONARY_BYTES:
            break
        out.append(w)
        size += len(w) + 1
    return b" " + b" ".join(reversed(out)) + b" "


def train_dictionaries(toxic: list, toxic_groups: list, plain: list, plain_groups: list) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents."""
    t, nt = _group_counts(toxic, toxic_groups)
    p, np_ = _group_counts(plain, plain_groups)
    telling = {w: c for w, c in t.items() if c >= LEAST_GROUPS and math.log(c / nt) - math.log((p[w] + 0.5) / np_) > LEAST_ODDS}
    return _content(p), _content(telling)


class Distance:
    """Saved bytes per window, by the two dictionaries."""

    def __init__(self, plain: bytes, toxic: bytes):
        shape = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTULTRA2, compression_level=19, min_match=3, window_log=18, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)

        def using(content):
            d = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=shape)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=shape).compress

        self.plain, self.toxic, self.cache = using(plain), using(toxic), {}

        self.base = len(self.toxic(CARRIER + CARRIER))

    def of(self, word: bytes) -> int:
        """The cell of a word: 0 if nothing is saved, else saved bytes by left bytes."""
        window = CARRIER + word + b" " + CARRIER
        now = len(self.toxic(window))
        saved = min(len(self.plain(window)) - now, SAVED)
        left = min(max(now - self.base, 1), LEFT)
        return (left - 1) * SAVED + saved if saved > 0 else 0

    def features(self, words: list[bytes]) -> np.ndarray:
        """The (log) numbers of windows with at least so many saved and at most so many left."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        got = list(map(self.cache.get, words))
        if None in got:
            for w in {w for w, g in zip(words, got) if g is None}:
                self.cache[w] = self.of(w)
            got = list(map(self.cache.get, words))
        held = np.bincount(np.array(got, np.int64), minlength=SAVED * LEFT + 1)[1:].reshape(LEFT, SAVED)
        return np.log1p(held[:, ::-1].cumsum(1)[:, ::-1].cumsum(0)).ravel()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights (the last: intercept) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), x.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs: dictionary contents and weights; or only a constant."""

    def __init__(self, plain: bytes = b"", toxic: bytes = b"", weights: np.ndarray | None = None, constant: float = 0.0):
        self.plain, self.toxic, self.weights, self.constant = plain, toxic, weights, constant
        self.distance: Distance | None = None

    def __getstate__(self):
        return self.__dict__ | {"distance": None}

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.constant
        if self.distance is None:
            self.distance = Distance(self.plain, self.toxic)
        z = self.distance.features(windows(text)) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def train(sample: Iterable[tuple[str, int]]) -> Model:
    """Fit on (text, label) pairs; equal words are held once."""
    held: dict = {}
    split: list = [[], []]
    for t, y in sample:
        split[y].append([held.setdefault(w, w) for w in windows(t)])
    n = len(split[0]) + len(split[1])
    if not split[0] or not split[1]:
        return Model(constant=float(bool(split[1])))
    groups = [_groups(s) for s in split]
    # each fold is measured by dictionaries of the others, whole groups apart
    xs, ys = [], []
    for fold in range(FOLDS):
        part = [[(w, g) for w, g in zip(s, gs) if g % FOLDS != fold] for s, gs in zip(split, groups)]
        held = [[w for w, g in zip(s, gs) if g % FOLDS == fold] for s, gs in zip(split, groups)]
        if not all(part):
            continue
        (plain, toxic) = part
        d = Distance(*train_dictionaries([w for w, _ in toxic], [g for _, g in toxic], [w for w, _ in plain], [g for _, g in plain]))
        for y, docs in enumerate(held):
            xs += [d.features(w) for w in docs]
            ys += [y] * len(docs)
    if not xs:
        return Model(constant=len(split[1]) / n)
    plain, toxic = train_dictionaries(split[1], groups[1], split[0], groups[0])
    return Model(plain, toxic, _logistic(np.array(xs), np.array(ys, float)))


def labelled_sample(docs: DataFrame, labels: DataFrame, fold=None) -> DataFrame | None:
    """A bounded sample of labelled documents, picked by hash: doc_id, text, toxic; None if there are none."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold is not None:
        marks = marks.where(~fold)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [r for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)) for r in marks.where(F.col("toxic") == y).orderBy(*order).limit(most).collect()]
    if not ids:
        return None
    picked = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, fold=None) -> Model:
    """Train on the labelled rows outside fold (a Column over doc_id; default: on all)."""
    rows = labelled_sample(docs, labels, fold)
    if rows is None:
        return Model()
    ship(docs.sparkSession)

    def over(batches):
        left = [MAX_BYTES, MAX_BYTES]

        def sample():
            for b in batches:
                for t, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                    text = t.as_py()
                    left[y] -= (size := len(text.encode("utf-8", "surrogatepass")))
                    if left[y] >= 0:
                        yield text, y
                    else:
                        left[y] += size

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sample()))], pa.binary())], names=["model"])
        release()

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    made = one.mapInArrow(over, "model binary").first()  # none where no labelled row has a document
    return pickle.loads(made[0]) if made else Model()


def score(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """docs with all columns and one more, name double; docs has no such column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def over(batch):
        m = held.value
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.score(t) for t in texts(batch)], pa.float64())], names=[*batch.schema.names, name])

    def done():
        held.value.distance = None

    return arrow_map(docs, over, StructType([*docs.schema.fields, StructField(name, DoubleType())]), done=done)


def held_out():
    """Column: rows from which no label is learnt."""
    return in_fold(3, 1)


def reject(docs: DataFrame, labels: DataFrame, fold=None) -> DataFrame:
    """docs, with their columns, without the rows that score THRESHOLD or more."""
    name = fresh("toxic_score", docs.columns)
    return score(docs, fit(docs, labels, fold), name).where(F.col(name) < THRESHOLD).drop(name)
