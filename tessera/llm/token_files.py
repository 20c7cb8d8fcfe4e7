"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are numbered anew by their frequency in the corpus (ties by id), so common ones take one byte.
An id takes 1 to 4 data bytes, least first; its number of bytes less one is a 2-bit field of a
control stream that is kept apart from the data, four ids a control byte, the first in the lowest
bits. Decoding looks each control byte up in tables of numpy and gathers all ids at once.

A file is a Parquet table of blocks of whole documents in ascending doc_id order (null ids first):
part, block, start_in_part, doc_ids, lengths, control, data; the ranking is a table beside it. All is
written and read by Spark, so any shared store serves and lost executors cost only their tasks.

Edge cases: null and empty texts hold only the end id; repeated ids and rows keep a place each;
an empty table gives files without blocks; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, shared_dir, ship

END_ID = 2
#: Ids in a block, unless one document holds more.
BLOCK_IDS = 1 << 18
#: Chunks that a worker keeps the ids of; at twice as many the older half goes.
CACHE = 400_000

#: Texts that are encoded together: more share more chunks.
BATCH = 4000
#: Marks that may end a chunk; after a letter they are a piece of their own (no apostrophe here).
TAIL = ".,;:!?%*#&$|"

#: White space as the pre-tokenisation sees it.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: 4-bit groups: the number of data bytes of four ids, and their sum, by control byte.
WIDTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) bytes of unsigned 32-bit ids."""
    ids = ids.astype(np.uint32)
    width = 1 + (ids > 0xFF).astype(np.int64) + (ids > 0xFFFF) + (ids > 0xFFFFFF)
    fields = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    fields[: len(ids)] = width - 1
    control = (fields.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < width[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of (control, data)."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(width) - width
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def spans(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at ``begin`` and hold ``size`` values, one after another."""
    total = int(size.sum())
    small = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    return pool[np.repeat((begin - (np.cumsum(size) - size)).astype(small), size) + np.arange(total, dtype=small)]


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without spaces in them, split from one joined string."""
    if not len(column):
        return []
    spaced = pc.binary_join_element_wise(column, *pa.array(["", " "], column.type))  # each string and a space, in one buffer
    _, offsets, data = spaced.buffers()
    first, last = np.frombuffer(offsets, np.int64)[[spaced.offset, spaced.offset + len(spaced)]]
    return str(data[int(first) : int(last)], "utf-8").split(" ")[:-1]


class Encoder:
    """The tokenizers library over chunks that no token crosses, each distinct one encoded once.

    A space before a non-space, and a line break between non-spaces, always begins a piece of
    byte-level pre-tokenisation, so the ids of a text are those of its chunks. Chunks not seen before
    are encoded in one call, joined.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Names of added tokens; in a text each is one id and ends the piece before it.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        lengths = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            lengths[i] = len(token)  # one character stands for one byte
        self.lengths = lengths
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.width = np.dtype(np.uint16 if len(lengths) <= 1 << 16 else np.uint32)

    def fresh(self, chunks: list[str], sizes: np.ndarray) -> list[bytes]:
        """The ids of chunks that begin at piece boundaries and take ``sizes`` bytes, from one call for all."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), "left") + 1
        packed = ids.tobytes()
        return [packed[a:b] for a, b in itertools.pairwise([0, *(4 * cut).tolist()])]

    def tail(self, marks: str) -> bytes:
        """The ids of marks after a letter, always a piece of their own."""
        if marks not in self.tails:
            self.tails[marks] = np.array(self.tokenizer.encode_batch_fast([marks], add_special_tokens=False)[0].ids, np.uint32).tobytes()
        return self.tails[marks]

    def look_up(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words, each with a space before it unless it begins with a line break."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        names = strings(words)
        got = list(map(young.get, names))
        new = []
        for k in [k for k, g in enumerate(got) if g is None]:
            if (g := old.get(names[k])) is None:
                new.append(k)
            else:
                young[names[k]] = got[k] = g
        if new:
            broken = np.asarray(pc.starts_with(words, "\n"))
            sizes = np.asarray(pc.binary_length(words))[new] + ~broken[new]
            for k, g in zip(new, self.fresh([names[k] if broken[k] else " " + names[k] for k in new], sizes)):
                young[names[k]] = got[k] = g
        return got

    def pooled(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks, the number of ids of each): their words, then the marks that end them."""
        word = pc.utf8_rtrim(chunks, TAIL)
        marks = np.asarray(pc.subtract(pc.binary_length(chunks), pc.binary_length(word)))
        marks = np.where(np.asarray(pc.match_substring_regex(word, r"\pL$")) & (marks <= 4), marks, 0)
        words = pc.if_else(pa.array(marks > 0), word, chunks).dictionary_encode()
        parts = self.look_up(words.dictionary)
        part = np.empty((len(chunks), 2), np.int64)
        part[:, 0] = np.asarray(words.indices)
        # the first part after the words is the empty tail
        part[:, 1] = len(parts)
        parts.append(b"")
        for n in range(1, 5):
            at = np.flatnonzero(marks == n)
            tails = pc.utf8_slice_codeunits(chunks.take(pa.array(at)), -n).dictionary_encode()
            part[at, 1] = len(parts) + np.asarray(tails.indices)
            parts.extend(map(self.tail, tails.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = spans(np.frombuffer(b"".join(parts), np.uint32), (np.cumsum(sizes) - sizes)[part.ravel()], sizes[part.ravel()])
        return ids, sizes[part].sum(1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column, the number of ids of each)."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        n = len(column)
        # a chunk begins at each space and at each line break; the latter keeps its break
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        flat, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
        ends = ends - ends[0]
        coded = flat.dictionary_encode()
        index = np.asarray(coded.indices, np.int64)
        # where a space or a line break meets other white space, it may not begin a piece: such texts go whole
        whole = np.asarray(pc.match_substring_regex(column, f"[ \\n]{WHITE}|{WHITE}\\n"))
        for name in self.added:
            whole = whole | np.asarray(pc.match_substring(column, name))
        chunk = np.ones(len(index), bool)
        chunk[ends[:-1]] = False
        chunk &= ~np.repeat(whole, np.diff(ends))
        head = flat.take(pa.array(ends[:-1])).to_pylist()
        for k in np.flatnonzero(whole).tolist():
            head[k] = column[k].as_py()
        wanted = np.zeros(len(coded.dictionary), bool)
        wanted[index[chunk]] = True
        sizes = np.zeros(len(wanted), np.int64)
        ids, sizes[wanted] = self.pooled(coded.dictionary.filter(pa.array(wanted)))
        first = np.cumsum(sizes) - sizes
        heads = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(head, add_special_tokens=False)]
        # heads follow the chunks' ids in one pool, so that all is gathered in one step
        pool = np.concatenate([ids, *heads])
        size = np.where(chunk, sizes[index], 0)
        begin = first[index]
        head_sizes = np.array([len(h) for h in heads], np.int64)
        size[ends[:-1]], begin[ends[:-1]] = head_sizes, len(ids) + np.cumsum(head_sizes) - head_sizes
        out = spans(pool, begin, size)
        return out, np.add.reduceat(size, ends[:-1]) if n else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids: binary, little-endian ids (16 bits if the vocabulary allows), the end id last."""

    def over(batch):
        enc = encoder(path)
        ids, sizes = enc.encode(batch.column("text"))
        ends = np.cumsum(sizes)
        packed = np.insert(ids, ends, end_id).astype(enc.width).tobytes()
        cut = (enc.width.itemsize * (ends + np.arange(1, len(ends) + 1))).tolist()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([packed[a:b] for a, b in itertools.pairwise([0, *cut])], pa.binary())], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), over, "doc_id long, ids binary", rows=BATCH)


def ranking(encoded: DataFrame, width: np.dtype) -> DataFrame:
    """id, n, rank: ids by falling frequency; as many rows as distinct ids, whatever the corpus."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), width))
            if len(c) > len(total):
                total, c = c, total
            total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    ship(encoded.sparkSession)
    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.id))  # one row per vocabulary entry
    return encoded.sparkSession.createDataFrame([(r.id, r.n, k) for k, r in enumerate(rows)], "id long, n long, rank long")


def write(encoded: DataFrame, path: str, width: np.dtype) -> None:
    """Write the files of documents from encode() below path: ranking and blocks."""
    spark = encoded.sparkSession
    ranking(encoded, width).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranking")
    ranked = spark.read.parquet(f"{path}/ranking").collect()
    rank = np.zeros(max((r.id for r in ranked), default=0) + 1, np.uint32)
    for r in ranked:
        rank[r.id] = r.rank
    held = spark.sparkContext.broadcast(rank)

    def blocks(batches):
        from pyspark import TaskContext

        part, block, done = TaskContext.get().partitionId(), 0, 0
        docs, sizes, chunks, size = [], [], [], 0

        def out():
            nonlocal block, done, docs, sizes, chunks, size
            control, data = pack(held.value[np.frombuffer(b"".join(chunks), width)])
            row = [[part], [block], [done], [docs], [sizes], [control], [data]]
            block, done = block + 1, done + size
            docs, sizes, chunks, size = [], [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "block", "start_in_part", "doc_ids", "lengths", "control", "data"])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                docs.append(d)
                sizes.append(len(x) // width.itemsize)
                chunks.append(x)
                size += sizes[-1]
                if size >= BLOCK_IDS:
                    yield out()
        if docs:
            yield out()

    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of a repeated or null id may be many: they are dealt by a hash of their ids too
    deal = F.xxhash64("ids")
    ordered = encoded.repartitionByRange(n, F.col("doc_id"), deal).sortWithinPartitions("doc_id", deal, "ids")
    schema = "part int, block int, start_in_part long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    ordered.mapInArrow(blocks, schema).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), ids (binary, as in encode)."""
    files = spark.read.parquet(f"{path}/blocks")
    ranked = sorted(spark.read.parquet(f"{path}/ranking").collect(), key=lambda r: r.rank)
    of_rank = np.array([r.id for r in ranked], np.uint32)
    # ids before each part: as many rows as range partitions were written
    totals = files.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).collect()
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        before[r.part], at = at, at + r.n
    held = spark.sparkContext.broadcast((of_rank, before))

    def over(batches):
        of_rank, before = held.value
        for b in batches:
            for row in b.to_pylist():
                ids = of_rank[unpack(row["control"], row["data"], sum(row["lengths"]))]
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - np.array(row["lengths"], np.int64)
                base = before[row["part"]] + row["start_in_part"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(base + starts), pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], names=["doc_id", "start", "ids"])

    ship(spark)
    return files.mapInArrow(over, "doc_id long, start long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read()'s rows."""
    return decoded.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, write, read back: read()'s rows, from files in the shared folder."""
    spark = docs.sparkSession
    width = Encoder(tokenizer_path).width
    coded = shared_dir(spark)
    encode(docs, tokenizer_path).write.option("compression", "zstd").parquet(coded)
    path = shared_dir(spark)
    write(spark.read.parquet(coded), path, width)
    discard(spark, coded)
    return read(spark, path)
