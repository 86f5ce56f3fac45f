"""Token ids in wavelet matrices: one compressed file per shard of documents.

A shard holds the ids of consecutive documents. Ids are numbered by rank among
those that occur, so a file needs only as many bit planes as the ranks have bits.
Plane by plane from the highest bit, the sequence is split stably into zeros and
ones; the planes alone give back every token (access), how often an id occurs
before a position (rank, and so counting), and where (select). Planes are
compressed in blocks; a directory of block places and of the ones before each
block lets a reader open just the blocks that a question touches.

Layout, little-endian: magic ``WMT1``; seven uint64 (tokens, documents, ids,
planes, bits per block, blocks per plane, length of the id column); for each
document its id as int64 (the smallest int64 stands for null) and its start as
uint64; the occurring ids as uint32; zeros per plane as uint64; ones before each
block as uint64 and the end of each compressed block as uint64, plane by plane;
the blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronvoice.llm.common import register, shared_folder, table
from patronvoice.llm.tokens import encoder, word_tokenizer

MAGIC = b"WMT1"
BLOCK_BITS = 1 << 16
END_ID = 2
NULL_ID = -(1 << 63)
#: UTF-8 bytes of text per shard, about; a single document may exceed it.
SHARD_BYTES = 16 << 20
#: Words that a worker keeps while it encodes; nothing else in this job needs much memory.
CACHE_WORDS = 600_000


def build(doc_ids: np.ndarray, starts: np.ndarray, tokens: np.ndarray) -> bytes:
    """The file content for the tokens of some documents."""
    used = np.flatnonzero(np.bincount(tokens)) if len(tokens) else np.zeros(0, np.int64)
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint32)
    number[used] = np.arange(len(used))
    x = number[tokens]
    planes = max(1, int(len(used) - 1).bit_length()) if len(used) else 0
    x = x.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    per_plane = -(-len(x) // BLOCK_BITS)
    pack = zstandard.ZstdCompressor(level=1).compress
    zeros, ones_before, ends, blocks, at = [], [], [], [], 0
    for plane in range(planes):
        bit = (x >> (planes - 1 - plane) & 1).astype(bool)
        zeros.append(len(x) - int(np.count_nonzero(bit)))
        packed = np.packbits(bit, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64)
        ones_before += (np.cumsum(counts) - counts).tolist()
        for i in range(per_plane):
            blocks.append(pack(packed[i * BLOCK_BITS // 8 : (i + 1) * BLOCK_BITS // 8].tobytes()))
            at += len(blocks[-1])
            ends.append(at)
        x = np.concatenate([x[~bit], x[bit]])
    head = np.array([len(tokens), len(doc_ids), len(used), planes, BLOCK_BITS, per_plane, 8 * len(doc_ids)], "<u8")
    parts = [head, np.asarray(doc_ids, "<i8"), np.asarray(starts, "<u8"), used.astype("<u4"), np.array(zeros, "<u8")]
    parts += [np.array(ones_before, "<u8"), np.array(ends, "<u8")]
    return b"".join([MAGIC, *(p.tobytes() for p in parts), *blocks])


class WaveletFile:
    """Questions to one file's content; blocks are opened when a question needs them."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.content = memoryview(content)
        at = 4

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(self.content, kind, count, at)
            at += got.nbytes
            return got

        self.tokens, docs, used, self.planes, self.block_bits, self.per_plane, _ = map(int, take(7, "<u8"))
        self.doc_ids, self.starts = take(docs, "<i8"), take(docs, "<u8").astype(np.int64)
        self.ids = take(used, "<u4")
        self.zeros = take(self.planes, "<u8").astype(np.int64)
        self.ones_before = take(self.planes * self.per_plane, "<u8").astype(np.int64)
        self.ends = take(self.planes * self.per_plane, "<u8").astype(np.int64)
        self.body = at
        self.block = lru_cache(maxsize=64)(self._block)

    def _raw(self, plane: int, block: int) -> bytes:
        k = plane * self.per_plane + block
        start = int(self.ends[k - 1]) if k else 0
        return zstandard.ZstdDecompressor().decompress(self.content[self.body + start : self.body + int(self.ends[k])])

    def _block(self, plane: int, block: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(self._raw(plane, block), np.uint8), bitorder="little")
        return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    def _ones(self, plane: int, i: int) -> int:
        """Ones in the first ``i`` bits of a plane."""
        if i <= 0:
            return 0
        block = (i - 1) // self.block_bits
        return int(self.ones_before[plane * self.per_plane + block] + self.block(plane, block)[i - block * self.block_bits])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        rank = 0
        for plane in range(self.planes):
            before = self._ones(plane, i)
            bit = self._ones(plane, i + 1) - before
            rank = rank << 1 | bit
            i = int(self.zeros[plane]) + before if bit else i - before
        return int(self.ids[rank])

    def _rank_of(self, token: int) -> int | None:
        k = int(np.searchsorted(self.ids, token))
        return k if k < len(self.ids) and self.ids[k] == token else None

    def _range(self, rank: int, lo: int, hi: int) -> tuple[int, int]:
        for plane in range(self.planes):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if rank >> (self.planes - 1 - plane) & 1:
                lo, hi = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in positions ``lo`` to ``hi``."""
        rank = self._rank_of(token)
        if rank is None:
            return 0
        hi = self.tokens if hi is None else min(hi, self.tokens)
        lo, hi = self._range(rank, min(lo, hi), hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The position of an id's occurrence number ``k``, from 0."""
        rank = self._rank_of(token)
        if rank is None:
            raise IndexError(k)
        lo, hi = self._range(rank, 0, self.tokens)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for plane in reversed(range(self.planes)):
            one = rank >> (self.planes - 1 - plane) & 1
            i = self._find(plane, i - int(self.zeros[plane]) if one else i, one)
        return i

    def _find(self, plane: int, k: int, one: int) -> int:
        """The position of a plane's bit number ``k`` of the given value."""
        ones = self.ones_before[plane * self.per_plane : (plane + 1) * self.per_plane]
        before = ones if one else np.arange(self.per_plane) * self.block_bits - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        sums = self.block(plane, block)
        if not one:
            sums = np.arange(len(sums)) - sums
        return block * self.block_bits + int(np.searchsorted(sums, k - int(before[block]) + 1, side="left")) - 1

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes from the last to the first, each merging its zeros and ones."""
        planes = []
        for plane in range(self.planes):
            raw = b"".join(self._raw(plane, b) for b in range(self.per_plane))
            planes.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=self.tokens, bitorder="little").view(bool))
        x = np.zeros(self.tokens, np.uint16 if len(self.ids) <= 1 << 16 else np.uint32)
        for plane in reversed(range(self.planes)):
            bit = planes.pop()
            y = np.empty_like(x)
            zeros = int(self.zeros[plane])
            y[~bit] = x[:zeros]
            y[bit] = x[zeros:] | x.dtype.type(1 << (self.planes - 1 - plane))
            x = y
        return self.ids[x] if self.tokens else np.zeros(0, "<u4")


def _write(path: str, content: bytes) -> None:
    """Write under another name and rename, so that a repeated task replaces the whole file."""
    fs, place = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, place)


def shard_bounds(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> list[int]:
    """Ids that begin a new shard: about equal counts of documents, as many shards as the bytes ask for.

    An id that more than one shard begins with holds more rows than a shard.
    """
    size = F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint") + 64)
    shards = max(1, -(-int(docs.agg(size).first()[0] or 0) // shard_bytes))
    if shards == 1:
        return []
    at = [k / shards for k in range(1, shards)]
    cuts = docs.agg(F.percentile_approx(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)), F.array(*map(F.lit, at)), 10 * shards)).first()[0]
    return sorted(cuts or [])


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write ``<folder>/<shard>.wmt`` for all documents in ascending order of their id.

    A null or empty text has the end id alone. Null ids come first; rows with
    equal ids are ordered by their tokens' bytes, within shards of their own where
    they are many. An empty table gives one file without documents.
    """
    bounds = shard_bounds(docs, id_col, text_col, shard_bytes)
    cuts = np.array(bounds, dtype=np.int64)
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer, CACHE_WORDS).encode
        for batch in batches:
            names = batch.column(0).fill_null(NULL_ID)
            low, shard = (np.searchsorted(cuts, names.to_numpy(zero_copy_only=False), side=s) for s in ("left", "right"))
            for i in range(0, len(batch), 512):
                found = [np.frombuffer(t + end, "<u4") for t in run(batch.column(1).slice(i, 512).to_pylist())]
                # two bytes an id on the way, where they hold it
                wide = [bool(t.max() >= 1 << 16) for t in found]
                short = [t.tobytes() if w else t.astype("<u2").tobytes() for t, w in zip(found, wide)]
                for k, t in enumerate(found, i):
                    if shard[k] - low[k] > 1:  # an id with many rows has several shards
                        shard[k] = low[k] + 1 + zlib.crc32(t) % (shard[k] - low[k])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, 512), pa.array(shard[i : i + 512], pa.int32()), pa.array(wide), pa.array(short, pa.binary())],
                    names=["doc", "shard", "wide", "ids"],
                )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens, shard = [], [], None
        for batch in batches:
            shards = batch.column(1).to_numpy()
            for run in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if shard is not None and len(run) and shards[run[0]] != shard:
                    yield save(shard, names, tokens)
                    names, tokens = [], []
                for i in run.tolist():
                    shard = int(shards[i])
                    wide, ids = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                    names.append(batch.column(0)[i].as_py())
                    tokens.append(np.frombuffer(ids, "<u4" if wide else "<u2"))
        if shard is not None:
            yield save(shard, names, tokens)

    def save(shard, names, tokens) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        content = build(np.array(names, np.int64), np.cumsum(sizes) - sizes, np.concatenate(tokens))
        _write(f"{folder}/{shard:08d}.wmt", content)
        columns = [pa.array([shard], pa.int32()), pa.array([len(content)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "bytes"])

    encoded = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        encode, "doc bigint, shard int, wide boolean, ids binary"
    )
    placed = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc", "ids")
    written = placed.mapInArrow(store, "shard int, bytes bigint").agg(F.count(F.lit(1))).first()[0]
    if not written:
        _write(f"{folder}/{0:08d}.wmt", build(np.zeros(0), np.zeros(0), np.zeros(0, np.uint32)))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files.

    ``start`` counts the ids of all documents in earlier files and earlier in the
    same file; only one number per file is needed for that.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmt").load(folder)
    files = files.select(F.regexp_extract("path", r"(\d+)\.wmt$", 1).cast("int").alias("shard"), "content")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [int(np.frombuffer(c.as_py(), "<u8", 1, 4)[0]) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.int64())], names=["shard", "tokens"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1)):
                file = WaveletFile(content.as_py())
                ids = file.decode().astype("<u4")
                ends = np.append(file.starts[1:], file.tokens)
                for i in range(0, len(file.doc_ids), 2048):
                    cuts = [ids[a:b].tobytes() for a, b in zip(file.starts[i : i + 2048], ends[i : i + 2048])]
                    names = file.doc_ids[i : i + 2048]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(names), shard.as_py()), pa.int32()),
                            pa.array(names, pa.int64(), mask=names == NULL_ID),
                            pa.array(file.starts[i : i + 2048]),
                            pa.array([len(c) // 4 for c in cuts], pa.int64()),
                            pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                            pa.array(cuts, pa.binary()),
                        ],
                        names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                    )

    totals = files.mapInArrow(total, "shard int, tokens bigint")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    first = totals.select("shard", F.coalesce(before, F.lit(0)).alias("first"))
    rows = files.mapInArrow(
        decode, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    )
    # one row per file; a file holds millions of ids, so this side is always small
    joined = rows.join(F.broadcast(first), "shard")
    return joined.select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")


@register("op3_wavelet_token_files")
def op3(spark, folder):
    out = shared_folder(spark)
    write_token_files(table(spark, folder, "documents"), out, word_tokenizer())
    return read_token_files(spark, out).drop("ids")
