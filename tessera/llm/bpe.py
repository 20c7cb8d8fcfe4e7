"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of codepoint classes. Token boundaries follow from the classes of neighbours
and from one bit of left context (may an apostrophe begin a contraction here?), which is found by
an associative scan that composes each position's state-transition function with those before it.
No regular expression is used. The slices between boundaries are looked up in a cache; slices that
it lacks are merged together, by rank, in arrays. Piece offsets are retained beside the ids, so any
stretch of ids can be decoded to its place in the text.

The pre-tokenisation that is reproduced, in order of preference at each place: contractions
('s 't 're 've 'm 'll 'd); an optional space and letters; an optional space and numbers; an optional
space and other non-space characters; white space up to the last before a non-space; white space.

Edge cases: null and empty texts have no ids; nothing in a text is a special token; repeated rows
are encoded row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, texts

LETTER, NUMBER, OTHER, SPACE, BLANK = 0, 1, 2, 3, 4  # BLANK: white space but U+0020
#: White space by the Unicode property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Pieces of more symbols are merged with a heap, so that very long words take n log n steps.
LONG = 96
#: Pieces that a worker keeps; at twice as many the older half goes. It bounds memory, not results.
CACHE = 250_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every codepoint."""
    global _classes
    if _classes is None:
        kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
        table = np.full(len(kinds), OTHER, np.uint8)
        table[kinds == ord("L")], table[kinds == ord("N")] = LETTER, NUMBER
        table[WHITE] = BLANK
        table[0x20] = SPACE
        _classes = table
    return _classes


#: For each class, the state after it from state 0 and from state 1. State 0: an apostrophe that
#: follows would begin a token; 1: it would belong to a token that has begun.
TRANSITIONS = np.array([[0, 0], [0, 0], [1, 1], [1, 1], [0, 0]], np.uint8)


def scan(functions: np.ndarray) -> np.ndarray:
    """The composition of each row's function with all before it, applied to state 0.

    functions has one row per position: the next state from each state. Composition is associative.
    A constant function forgets what came before, so every position needs only those since the last
    constant one; these stretches are composed by doubling.
    """
    done = functions.copy()
    open_ = np.flatnonzero((done != done[:, :1]).any(1))
    step = 1
    while len(open_) and open_[-1] >= step:
        open_ = open_[open_ >= step]
        done[open_] = np.take_along_axis(done[open_], done[open_ - step].astype(np.intp), 1)
        open_ = open_[(done[open_] != done[open_, :1]).any(1)]
        step *= 2
    return done[:, 0]


def starts_of(code: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in concatenated texts (codepoints), each text starting anew."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[code]
    white = cls >= SPACE
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    before, now = cls[:-1], cls[1:]
    # a class change begins a piece, but not after the space that leads it
    start[1:] = (before != now) & ~((before == SPACE) & ~white[1:])
    # within white space only its last character before a non-space begins a piece
    inner = white[1:] & white[:-1]
    ends = np.empty(n, bool)
    ends[-1] = False
    ends[:-1] = ~white[1:] & ~first[1:n]
    start[1:][inner] = ends[1:][inner]
    start |= first[:n]
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        state = np.zeros(len(quote), np.uint8)
        inside = np.flatnonzero(~first[quote])
        # the stretch that decides: the character before, which has a constant function
        around = quote[inside] - 1
        pairs = TRANSITIONS[cls[around]]
        state[inside] = scan(pairs)
        free = quote[state == 0]
        text_end = np.append(doc_starts[1:], n)
        limit = text_end[np.searchsorted(doc_starts, free, "right") - 1]
        padded = np.append(code, [0, 0])
        took = np.zeros(len(free), np.int64)
        for c in CONTRACTIONS:
            ok = (took == 0) & (free + len(c) < limit)
            for k, ch in enumerate(c):
                ok &= padded[np.minimum(free + 1 + k, n)] == ord(ch)
            took[ok] = len(c)
        hit = took > 0
        free, took, limit = free[hit], took[hit], limit[hit]
        start[free + 1] = False
        after = free + took + 1
        start[after[after < limit]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of byte strings, with the tables that array merging needs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    NONE = np.int64(1) << 40

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's union, or NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.NONE)

    def merge_long(self, data: bytes) -> list[int]:
        """One piece by a heap of pairs: the lowest rank first, the leftmost of equals."""
        ids = self.of_byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (q := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (p := prev[i]) >= 0 and (q := get(ids[p] << 32 | r)) is not None:
                heapq.heappush(heap, (q, p, ids[p], r))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit integers; all pieces advance together, one merge a round."""
        out: list = [None] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = self.ranks[p].to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = np.array(self.merge_long(p), np.uint32).tobytes()
            else:
                short.append(i)
        if not short:
            return out
        sizes = np.array([len(pieces[i]) for i in short])
        ids = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), sizes)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.append(self.rank(ids[:-1], ids[1:]), self.NONE)
        rank[last] = self.NONE
        finished: list = [(owner[:0], ids[:0])]
        while len(ids):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(ids)))
            over = np.repeat(best == self.NONE, counts)
            if over.any():
                finished.append((owner[over], ids[over]))
                ids, owner, last, rank = ids[~over], owner[~over], last[~over], rank[~over]
                continue
            spots = np.flatnonzero(rank == np.repeat(best, counts))
            lead = spots[np.append(True, owner[spots[1:]] != owner[spots[:-1]])]  # the leftmost of each piece
            ids[lead] = rank[lead]
            last[lead] = last[lead + 1]
            keep = np.ones(len(ids), bool)
            keep[lead + 1] = False
            lead -= np.arange(len(lead))  # each piece before has lost one symbol
            ids, owner, last, rank = ids[keep], owner[keep], last[keep], rank[keep]
            for spot in (lead, lead[lead > 0] - 1):
                spot = spot[~last[spot]]
                rank[spot] = self.rank(ids[spot], ids[spot + 1])
            rank[last] = self.NONE
        own, val = (np.concatenate(x) for x in zip(*finished))
        order = np.argsort(own, kind="stable")
        ends = 4 * np.cumsum(np.bincount(own, minlength=len(short)))
        packed = val[order].astype(np.uint32).tobytes()
        for i, (a, b) in zip(short, itertools.pairwise([0, *ends.tolist()])):
            out[i] = packed[a:b]
        return out

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit integers."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        lacking = {p for p, f in zip(pieces, found) if f is None} if None in found else ()
        if lacking:
            new = []
            for p in lacking:
                if (f := old.get(p)) is not None:
                    young[p] = f
                else:
                    new.append(p)
            for p, ids in zip(new, self.merge([p.encode("utf-8", "surrogatepass") for p in new])):
                young[p] = ids
            found = list(map(young.get, pieces))
        return found

    def encode(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: its ids, and each piece's first codepoint and first id."""
        joined = "".join(batch)
        sizes = np.array([len(t) for t in batch], np.int64)
        doc = np.cumsum(sizes) - sizes
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = starts_of(code, doc[sizes > 0])
        cut = begin.tolist()
        pieces = [joined[a:b] for a, b in itertools.pairwise([*cut, len(joined)])]
        coded = self.look_up(pieces)
        ids = np.frombuffer(b"".join(coded), np.uint32)
        held = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        first = np.cumsum(held) - held
        at = np.searchsorted(begin, doc)
        upto = np.append(at[1:], len(begin))
        first = np.append(first, len(ids))
        return [(ids[first[a] : first[b]], begin[a:b] - d, first[a:b] - first[a]) for a, b, d in zip(at, upto, doc)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, loaded once per worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, piece_chars array<int>, piece_ids array<int> (offsets of the pieces)."""

    def over(batch):
        vocab = vocabulary(path)
        done = vocab.encode(texts(batch))
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([d[k].astype(np.int32) for d in done], kind) for k in range(3))], names=["doc_id", "ids", "piece_chars", "piece_ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), over, "doc_id long, ids array<int>, piece_chars array<int>, piece_ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes: the byte strings that the ids stand for."""

    def over(batch):
        vocab = vocabulary(path)
        out = [vocab.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return arrow_map(encoded.select("doc_id", "ids"), over, "doc_id long, bytes binary")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def over(batch):
        vocab = vocabulary(path)
        number, token = vocab.decimal.__getitem__, vocab.bytes.__getitem__
        n, sha, back = [], [], []
        for ids, _, _ in vocab.encode(texts(batch)):
            ids = ids.tolist()
            n.append(len(ids))
            sha.append(hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
