"""Language-model scores: a gated recurrent network over word classes, in numpy.

Counts of all training words come from the whole corpus by a distributed sum. The ``WORDS`` most
frequent words have outputs of their own, in classes (a softmax over classes, then one within the
class); every other word belongs to a bucket by its last two characters, is predicted as that bucket
and shares it by its count, an unseen word by one more place of weight ``FLOOR``. So the outputs are
a distribution. Scores are natural sums over whole documents: windows of steps are computed at a
time, and the state is carried from one window to the next until the document ends.

Weights start at the counts' distribution. Tasks go on from there by truncated backpropagation, each
over the training documents it reads, and their weights are averaged by the tokens they saw; first
over a part of the documents (by a hash of the id), then from that average over all the others. So
every training document is learnt from once, in as many tasks as the table has. How rows are dealt to
tasks is part of the fit: another number of files or splits gives slightly other weights, and scores.

Words that few documents use are not sent to every worker: a worker knows the ``KNOWN`` most
frequent ones, others are counted for a document by a join.

Edge cases: null and empty texts are one end token; without training documents every count is 0
and the score is that of the uniform start; rows that share an id are scored row by row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_fold, ship, written

FLOOR = 0.1
CLASSES, PER_CLASS, BUCKETS = 32, 32, 64
WORDS = CLASSES * PER_CLASS
KNOWN = 50_000
#: Texts that are split together.
TEXTS = 1000
STATE, STEPS = 32, 32
#: Lanes of documents that are scored, or learnt from, side by side.
LANES, LEARNING = 256, 256
#: Documents longer than LONG go first among those of HELD tokens, so that few lanes are left alone.
LONG, HELD = 2000, 8_000_000
#: Bound of a logit, so that its exponential is finite.
HIGHEST = np.float32(60)
#: One document of so many is learnt from in the first averaged round, the others in the second.
FIRST = 16
RATES = (0.04, 0.02)
#: Streams in which tasks' weights are summed before the driver takes one sum of each.
SUMS = 64
#: The end of a text; no word is empty.
END = b""
OUTPUTS = CLASSES + BUCKETS
START = WORDS + BUCKETS
#: The class of each output.
CLASS_OF = np.append(np.repeat(np.arange(CLASSES), PER_CLASS), np.arange(CLASSES, OUTPUTS)).astype(np.int8)
#: Rows whose softmax over classes stays in a core's cache.
ROWS = 1024
#: Runs of fewer rows are summed side by side.
SIDE = 24


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in their order and END, the number of each token's word, ends of the texts) of lower-cased (A-Z) texts.

    Words stand between white space (ASCII); each text has one more token, its end; null is empty.
    """
    own = texts.take(pa.array(np.arange(len(texts))))  # lower-casing is wrong for a part of a larger array
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own.cast(pa.large_string()), "")))
    begins, flat = lists.offsets.to_numpy(), lists.values
    filled = pc.binary_length(flat).to_numpy() > 0
    before = np.append(0, np.cumsum(filled))[begins]
    flat = flat.filter(pa.array(filled)).slice(before[0], before[-1] - before[0])
    words = pa.concat_arrays([flat, pa.array([END.decode()], flat.type)])
    ends = np.cumsum(np.diff(before) + 1)
    out = np.full(ends[-1] if len(ends) else 0, len(flat), np.int32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = np.arange(len(flat), dtype=np.int32)
    return words, out, ends


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same with distinct words, as bytes; END is the last."""
    words, at, ends = tokens(texts)
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy()[at], ends


def slices(batches) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield b.slice(at, TEXTS)


def bucket(word: bytes) -> int:
    """A word's bucket, by its last two characters."""
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all rows of docs; '' is the end."""

    def over(batches):
        held: list = []

        def summed():
            coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in held]), len(coded.dictionary))
            return coded.dictionary, n.astype(np.int64)

        def out(words, n):
            return pa.RecordBatch.from_arrays([words.cast(pa.large_string()).cast(pa.string()), pa.array(n)], names=["word", "n"])

        rows = 0
        for b in slices(batches):
            words, at, _ = split(b.column("text"))
            held.append((words, np.bincount(at, minlength=len(words))))
            rows += len(words)
            if rows > 1_000_000:
                held, rows = [summed()], 0
                if len(held[0][0]) > 1_000_000:
                    yield out(*held.pop())
        if held:
            yield out(*summed())

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(over, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


class Statistics:
    """What workers know of the counts: totals, the most frequent words, buckets."""

    def __init__(self, n: int, v: int, known: dict[bytes, int], bucket_n: np.ndarray, bucket_v: np.ndarray):
        self.n, self.v, self.known, self.bucket_n, self.bucket_v = n, v, known, bucket_n, bucket_v
        self.ids = {w: k for k, w in enumerate(itertools.islice(known, WORDS))}
        self.floor = math.log10(FLOOR)

    @property
    def base_total(self) -> float:
        return math.log10(self.n + FLOOR * (self.v + 1))

    def bucket_total(self, b: int) -> float:
        return math.log10(self.bucket_n[b] + FLOOR * (self.bucket_v[b] + 1))


def statistics(counts: DataFrame) -> Statistics:
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # words are known down to a count that fewer than KNOWN reach; steps of counts are fine and few
    step = F.floor(F.log2("n") * 64).cast("int")
    reach, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        reach += r.words
        if reach > KNOWN:
            break
        least = r.step
    top = sorted(counts.where(step >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []
    own = [r.word for r in top[:WORDS]]
    b = (F.crc32(F.right("word", F.lit(2)).cast("binary")) % BUCKETS).alias("b")
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in own], "word string")), "word", "left_anti")
    bn, bv = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rest.groupBy(b).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        bn[r.b], bv[r.b] = r.n, r.v
    return Statistics(n, v, {r.word.encode(): r.n for r in top}, bn, bv)


def _windows(docs: Iterable[tuple[object, np.ndarray]], lanes: int):
    """Windows of STEPS steps over documents (key, output ids), dealt to lanes as lanes get free.

    Yields (lanes of the last window that go on, inputs, targets, first flags, number of the piece of
    each place, keys of the pieces, keys of the documents that end); step by lane, targets -1 where a
    lane has none.
    """
    docs = iter(docs)
    held: list = [[*d, 0] for d in itertools.islice(docs, lanes)]
    stay = None
    while held:
        x, y = np.full((len(held), STEPS), START, np.int32), np.full((len(held), STEPS), -1, np.int32)
        first, piece = np.zeros((len(held), STEPS), bool), np.zeros((len(held), STEPS), np.int32)
        keys: list = []
        ended: list = []
        for k, lane in enumerate(held):
            at = 0
            while lane and at < STEPS:
                key, codes, i = lane
                n = min(STEPS - at, len(codes) - i)
                y[k, at : at + n], piece[k, at : at + n] = codes[i : i + n], len(keys)
                keys.append(key)
                if i:
                    x[k, at : at + n] = codes[i - 1 : i + n - 1]
                else:
                    x[k, at + 1 : at + n], first[k, at] = codes[: n - 1], True
                at += n
                if i + n < len(codes):
                    lane[2] = i + n
                else:
                    ended.append(key)
                    new = next(docs, None)
                    lane = [*new, 0] if new else None
            held[k] = lane
        yield stay, *(np.ascontiguousarray(a.T) for a in (x, y, first, piece)), keys, ended
        on = [k for k, lane in enumerate(held) if lane]
        stay = None if len(on) == len(held) else on
        held = [held[k] for k in on]


def long_first(docs: Iterable[tuple[object, np.ndarray]]) -> Iterable[tuple[object, np.ndarray]]:
    """The same documents, long ones earlier."""
    held: list = []
    size = 0
    for d in docs:
        held.append(d)
        size += len(d[1])
        if size > HELD:
            yield from sorted(held, key=lambda d: -max(LONG, len(d[1])))
            held, size = [], 0
    yield from sorted(held, key=lambda d: -max(LONG, len(d[1])))


def run_sums(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The sum of each run of rows, by where they begin: long runs one at a time, the others side by side."""
    n = np.diff(np.append(begins, len(rows)))
    by = np.argsort(-n, kind="stable")
    n, begins = n[by], begins[by]
    sums, ones, long = rows[begins], np.ones(n[0], rows.dtype), int((n >= SIDE).sum())
    for k, (at, size) in enumerate(zip(begins[:long].tolist(), n[:long].tolist())):
        np.matmul(ones[:size], rows[at : at + size], out=sums[k])
    for j in range(1, SIDE):
        left = int(np.searchsorted(-n, -j))
        if left <= long:
            break
        sums[long:left] += rows[begins[long:left] + j]
    out = np.empty_like(sums)
    out[by] = sums
    return out


class Network:
    """A GRU with class-factored softmax; float32 weights in a dictionary.

    table: what an input adds to the gates; u: what the state adds; wc: the softmax over classes; ww:
    those within a class. The last row of either softmax is its bias; states have a last column of ones.
    """

    NAMES = ("table", "u", "wc", "ww")

    def __init__(self, stats: Statistics, seed: int = 0):
        g = np.random.default_rng(seed)
        f = np.float32
        own = np.array([stats.known[w] for w in stats.ids], float) + FLOOR
        own = np.append(own, np.full(WORDS - len(own), FLOOR)).reshape(CLASSES, PER_CLASS)
        mass = np.concatenate([own.sum(1), stats.bucket_n + FLOOR])
        self.p = {
            "table": g.normal(0, 0.3, (START + 1, 3 * STATE)).astype(f), "u": g.normal(0, STATE**-0.5, (STATE, 3 * STATE)).astype(f),
            "wc": np.zeros((STATE + 1, OUTPUTS), f), "ww": np.zeros((CLASSES, STATE + 1, PER_CLASS), f),
        }
        self.p["wc"][-1], self.p["ww"][:, -1] = np.log(mass / mass.sum()), np.log(own / own.sum(1, keepdims=True))
        self.start_learning()

    def start_learning(self) -> None:
        self.step, self.m, self.v = 0, {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}

    def gates(self, name: str) -> np.ndarray:
        """The weights of table or u by gate: gate, input, state."""
        return np.ascontiguousarray(self.p[name].reshape(-1, 3, STATE).transpose(1, 0, 2), np.float32)

    def window(self, x: np.ndarray, first: np.ndarray, h: np.ndarray, saved: list | None = None):
        """(states, last state): the state after each step's input, which predicts its target.

        Gates are the first axis, so that each is one block of memory. saved gets, by step, the states
        before, what a state keeps of the one before, and what each change of a state changes in the
        gates: as the last state enters them (by gate first), and in the new state's own input.
        """
        table, u, s, half = self.gates("table"), self.gates("u"), STATE, np.float32(0.5)
        table[:2] *= half  # a logistic gate is half a tanh of half its input
        u[:2] *= half
        states = np.ones((*x.shape, s + 1), np.float32)
        starts = first.any(1)
        g, gh = np.empty((3, *h.shape), np.float32), np.empty((3, *h.shape), np.float32)
        (z, r, n), zr = g, g[:2]
        if saved is not None:
            saved += np.empty((2, *x.shape, s), np.float32), np.empty((3, *x.shape, s), np.float32), np.empty((*x.shape, s), np.float32)
        for t in range(len(x)):
            if starts[t]:
                h = h * ~first[t][:, None]
            table.take(x[t], 1, out=g, mode="clip")
            np.matmul(h, u, out=gh)
            zr += gh[:2]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= half
            q = gh[2] * r
            n += q
            np.tanh(n, out=n)
            kept = h - n
            kept *= z
            if saved is not None:
                (before, keep), into, own = saved
                before[t], keep[t] = h, z
                a, b, c, o = into[0, t], into[1, t], into[2, t], own[t]
                np.subtract(1, z, out=q)
                np.multiply(kept, q, out=a)
                np.multiply(n, n, out=o)
                np.subtract(1, o, out=o)
                o *= q
                np.multiply(o, r, out=c)
                np.subtract(1, r, out=b)
                b *= gh[2]
                b *= c
            h = np.add(kept, n, out=kept)
            states[t, :, :s] = h
        return states, h

    def outputs(self, h: np.ndarray, y: np.ndarray, learn: bool = False):
        """Natural log probabilities of targets y from states h (rows); with gradients if learn.

        Rows are taken some at a time for the softmax over classes, in the order of their classes for
        those within; buckets are classes without words, the last.
        """
        wc, ww, n, grad, dh = self.p["wc"], self.p["ww"], len(y), None, None
        cls, rows, ones = CLASS_OF[y], np.arange(max(n, ROWS)), np.ones(OUTPUTS, np.float32)
        lp = np.empty(n, np.result_type(h, wc))
        if learn:
            grad, dh = {"wc": np.zeros_like(wc), "ww": np.zeros_like(ww)}, np.empty((n, STATE), np.float32)
        high, high_within, back = self._high(wc), self._high(ww), wc[:-1].T
        for at in range(0, n, ROWS):
            part = slice(at, at + ROWS)
            hp, cp = h[part], cls[part]
            e, here = hp @ wc, rows[: len(cp)]
            if high:
                np.minimum(e, HIGHEST, out=e)
            own = e[here, cp]
            np.exp(e, out=e)
            total = e @ ones
            lp[part] = own - np.log(total)
            if learn:
                e *= (1 / total)[:, None]
                e[here, cp] -= 1
                grad["wc"] += hp.T @ e
                np.matmul(e, back, out=dh[part])
        order = np.argsort(cls, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(cls, minlength=CLASSES)[:CLASSES])).tolist()
        order = order[: ends[-1]]
        ordered, word, own_lp = h[order], (y % PER_CLASS)[order], np.empty(ends[-1], np.float32)
        ones = np.ones(PER_CLASS, np.float32)
        if learn:
            within = np.empty((ends[-1], STATE), np.float32)
        for c, (a, z) in enumerate(itertools.pairwise(ends)):
            if a == z:
                continue
            hc, k, here = ordered[a:z], word[a:z], rows[: z - a]
            inner = hc @ ww[c]
            if high_within:
                np.minimum(inner, HIGHEST, out=inner)
            own = inner[here, k]
            np.exp(inner, out=inner)
            total = inner @ ones
            own_lp[a:z] = own - np.log(total)
            if learn:
                inner *= (1 / total)[:, None]
                inner[here, k] -= 1
                grad["ww"][c] = hc.T @ inner
                np.matmul(inner, ww[c, :-1].T, out=within[a:z])
        lp[order] += own_lp
        if learn:
            dh[order] += within
        return lp, grad, dh

    @staticmethod
    def _high(w: np.ndarray) -> bool:
        """Whether logits of weights w could be above HIGHEST (states are within 1), and have to be bounded."""
        return np.abs(w).sum(-2).max() > HIGHEST

    def learn(self, docs: Iterable[np.ndarray], rate: float) -> int:
        """Truncated backpropagation with Adam, once over docs; returns the number of tokens seen."""
        h, s, seen, full = np.zeros((LEARNING, STATE), np.float32), STATE, 0, 0
        for stay, x, y, f, *_ in _windows(long_first((None, d) for d in docs), LEARNING):
            h = h[: x.shape[1]] if stay is None else h[stay]
            saved: list = []
            states, h = self.window(x, f, h, saved)
            ok = y >= 0
            n = int(ok.sum())
            seen += n
            full = full or n  # windows with few lanes left move the weights less
            whole = n == ok.size
            _, grad, dho = self.outputs(states.reshape(-1, s + 1) if whole else states[ok], y.ravel() if whole else y[ok], learn=True)
            if whole:
                dstate = dho.reshape(*x.shape, s)
            else:
                dstate = np.zeros((*x.shape, s), np.float32)
                dstate[ok] = dho
            (before, keep), into, own = saved
            carry, back, starts = np.zeros_like(h), np.ascontiguousarray(self.gates("u").transpose(0, 2, 1)), f.any(1)
            moved, d, u = np.empty((3, *h.shape), np.float32), np.empty((3, *h.shape), np.float32), np.zeros((3, s, s), np.float32)
            inputs = np.empty((*x.shape, 3, s), np.float32)
            for t in range(len(x) - 1, -1, -1):
                carry += dstate[t]
                np.multiply(into[:, t], carry, out=d)
                np.matmul(d, back, out=moved)
                u += before[t].T @ d
                np.multiply(own[t], carry, out=d[2])
                inputs[t] = d.transpose(1, 0, 2)
                carry *= keep[t]
                for m in moved:
                    carry += m
                if starts[t]:
                    carry *= ~f[t][:, None]
            grad["u"] = u.transpose(1, 0, 2).reshape(s, 3 * s)
            flat = x.ravel()
            order = np.argsort(flat.astype(np.int16), kind="stable")
            used, begin = np.unique(flat[order], return_index=True)
            grad["table"] = np.zeros_like(self.p["table"])
            grad["table"][used] = run_sums(inputs.reshape(-1, 3 * s)[order], begin)
            self.step += 1
            norm = math.sqrt(sum(float((g * g).sum()) for g in grad.values())) / n
            scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
            for k, g in grad.items():
                g = g * scale
                self.m[k] += np.float32(0.1) * (g - self.m[k])
                self.v[k] += np.float32(0.01) * (g * g - self.v[k])
                self.p[k] -= np.float32(rate * min(1, n / full) / (1 - 0.9**self.step)) * self.m[k] / (np.sqrt(self.v[k] / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))
        return seen

    def scored(self, docs: Iterable[tuple[object, np.ndarray]]):
        """(key, log10 probability) of each document's outputs as it ends; its state is carried through."""
        h, totals = np.zeros((LANES, STATE), np.float32), {}
        for stay, x, y, f, piece, keys, ended in _windows(long_first(docs), LANES):
            h = h[: x.shape[1]] if stay is None else h[stay]
            states, h = self.window(x, f, h)
            ok = y >= 0
            if ok.all():
                ok = ...
            lp, _, _ = self.outputs(states[ok].reshape(-1, STATE + 1), y[ok].ravel())
            for key, p in zip(keys, np.bincount(piece[ok].ravel(), lp, len(keys)).tolist()):
                totals[key] = totals.get(key, 0.0) + p
            for key in ended:
                yield key, totals.pop(key) / math.log(10)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each of docs."""
        found = dict(self.scored(enumerate(docs)))
        return np.array([found[k] for k in range(len(docs))])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def unflatten(self, w: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = w[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size


class Places:
    """Words' places: the rank of a known word, KNOWN and its bucket for another."""

    last = None

    def __init__(self, stats: Statistics):
        self.known = pa.array(list(stats.known), pa.large_binary()).cast(pa.large_string())
        self.buckets: dict[str, int] = {}
        ranks = len(self.known)
        #: The output id and the base score (nan: not known here) of each place.
        self.output = np.full(KNOWN + BUCKETS, -1, np.int32)
        self.output[:ranks] = WORDS + self.bucket(self.known)
        own = min(ranks, WORDS)
        self.output[:own] = np.arange(own)
        self.output[KNOWN:] = WORDS + np.arange(BUCKETS)
        self.base = np.full(KNOWN + BUCKETS, np.nan)
        self.base[:ranks] = [math.log10(c + FLOOR) for c in stats.known.values()]

    @classmethod
    def by(cls, stats: Statistics) -> Places:
        """The places of stats, made once in a worker."""
        if cls.last is None or cls.last[0] is not stats:
            cls.last = (stats, cls(stats))
        return cls.last[1]

    def bucket(self, words: pa.Array) -> np.ndarray:
        """The bucket of each of words; those of pairs of last characters met before are held, emptied when large."""
        tails = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        if len(self.buckets) > 400_000:
            self.buckets.clear()
        found = []
        for tail in tails.dictionary.to_pylist():
            b = self.buckets.get(tail)
            if b is None:
                b = self.buckets[tail] = bucket(tail.encode())
            found.append(b)
        return np.array(found, np.int32)[tails.indices.to_numpy()]

    def of(self, words: pa.Array) -> np.ndarray:
        out = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy()
        other = out < 0
        if other.any():
            out = out.copy()
            out[other] = KNOWN + self.bucket(words.filter(pa.array(other)))
        return out


def _averaged(docs: DataFrame, net: Network, stats: Statistics, rate: float) -> Network:
    """net after one pass of all rows of docs: each task learns on, then weights are averaged by tokens."""
    held = docs.sparkSession.sparkContext.broadcast((net, stats))

    def over(batches):
        from pyspark import TaskContext

        mine, stats = held.value
        mine.start_learning()
        places = Places.by(stats)

        def coming():
            for b in slices(batches):
                words, at, ends = tokens(b.column("text"))
                yield from np.split(places.output[places.of(words)][at], ends[:-1])

        seen = mine.learn(coming(), rate)
        if seen:
            yield _row(mine.flat().astype(np.float64) * seen, seen, TaskContext.get().partitionId() % SUMS)

    def summed(batches):
        w, n = 0.0, 0
        for b in batches:
            for x, k in zip(b.column("w").to_pylist(), b.column("n").to_pylist()):
                w, n = w + np.frombuffer(x, np.float64), n + k
        if n:
            yield _row(w, n, 0)

    kind = "k int, n long, w binary"
    sums = docs.select("text").mapInArrow(over, kind).repartition(SUMS, "k").mapInArrow(summed, kind).collect()  # SUMS rows at most
    held.destroy()
    out = Network(stats)
    out.p = {k: v.copy() for k, v in net.p.items()}
    if sums:
        out.unflatten(sum(np.frombuffer(r.w, np.float64) for r in sorted(sums, key=lambda r: (r.n, bytes(r.w)))) / sum(r.n for r in sums))
    return out


def _row(w: np.ndarray, n: int, k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["k", "n", "w"])


def train(docs: DataFrame, stats: Statistics) -> Network:
    """Fit on the training rows docs, each of which is learnt from once."""
    early = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0
    # the first round's tasks read several splits, so that each has enough to learn from
    tasks = max(1, docs.rdd.getNumPartitions() // FIRST)
    net = _averaged(docs.where(early).coalesce(tasks), Network(stats), stats, RATES[0])
    return _averaged(docs.where(~early), net, stats, RATES[1])


def score(docs: DataFrame, train_rows=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns where not held out."""
    spark = docs.sparkSession
    ship(spark)
    out = in_fold(10, 0)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learnt = docs.where(~out if train_rows is None else train_rows)
    counts = written(word_counts(learnt))
    stats = statistics(counts)
    net = train(learnt, stats)
    held = spark.sparkContext.broadcast((net, stats))

    def over(batches):
        from pyspark import TaskContext

        net, stats = held.value
        row, places = TaskContext.get().partitionId() << 40, Places.by(stats)
        in_bucket = np.array([stats.bucket_total(b) for b in range(BUCKETS)])
        under_way: dict = {}

        def coming():
            nonlocal row
            for b in slices(batches):
                words, at, ends = tokens(b.column("text"))
                places_ = places.of(words)
                code, p = places.output[places_][at], places.base[places_][at]
                far = np.isnan(p)
                p[far] = 0.0
                begins = np.append(0, ends[:-1])
                # a word's share of its bucket; the count of a word that is not known here is joined
                share = np.where(code >= WORDS, p - in_bucket[np.maximum(code - WORDS, 0)], 0.0)
                texts = np.repeat(np.arange(len(ends)), ends - begins)
                coded = words.take(pa.array(at[far])).dictionary_encode()
                words = coded.dictionary
                rare, tf = np.unique(texts[far] * len(words) + coded.indices.to_numpy(), return_counts=True)
                cut = np.searchsorted(rare, np.arange(len(ends) + 1) * len(words))
                rare %= max(len(words), 1)
                sums = zip(b.column("doc_id").to_pylist(), (ends - begins).tolist(), np.add.reduceat(~far, begins, dtype=np.int64).tolist(), np.add.reduceat(p, begins).tolist(), np.add.reduceat(share, begins).tolist())
                for k, (sum_, c) in enumerate(zip(sums, np.split(code, ends[:-1]))):
                    under_way[row] = (row, *sum_, words, rare[cut[k] : cut[k + 1]], tf[cut[k] : cut[k + 1]])
                    row += 1
                    yield row - 1, c

        names, done = ["row", "doc_id", "n_tokens", "n_known", "base", "model", "words", "tf"], []

        def out():
            *plain, words, rare, tf = zip(*done)
            offsets = pa.array(np.append(0, np.cumsum([len(r) for r in rare])), pa.int32())
            flat = pa.concat_arrays([w.take(pa.array(r)) for w, r in zip(words, rare)]).cast(pa.string())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds)), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tf), pa.int64()))], names=names)

        for key, lp in net.scored(coming()):
            d = under_way.pop(key)
            done.append((*d[:5], d[5] + lp, *d[6:]))
            if len(done) == TEXTS:
                yield out()
                done.clear()
        if done:
            yield out()

    scored = written(docs.mapInArrow(over, "row long, doc_id long, n_tokens long, n_known long, base double, model double, words array<string>, tf array<long>"))
    far = scored.select("row", F.explode(F.arrays_zip("words", "tf")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.tf").alias("tf"))
    c = F.coalesce("n", F.lit(0))
    worth = F.log10(c + F.lit(FLOOR)) * F.col("tf")
    met = far.join(counts, "word", "left").groupBy("row").agg(F.sum(worth).alias("far"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("far_known"))
    joined = scored.drop("words", "tf").join(met, "row", "left")
    add = F.coalesce("far", F.lit(0.0))
    return joined.select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(stats.n)).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(stats.base_total)).alias("base_score"), (F.col("model") + add).alias("score"),
    )
