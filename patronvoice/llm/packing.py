"""Harmonic packing of token sequences.

Lengths fall into the classes (C/(k+1), C/k] of the capacity C, and a bin of
class k takes exactly k of them, so that every worker can fill its bins without
looking at the others. Whole capacities are cut off a document first; what is
left over is classified. The room that k pieces leave in their bin is filled by
cuts of a stream of other documents: the short ones, the groups that do not fill
a bin, and, as long as room is left, the bins with the most room, taken apart
again. What then remains of the stream is laid into full bins and, at its end,
into bins of falling powers of two. So no bin is padded, and a document is cut
only where a bin ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import register, table
from patronvoice.llm.tokens import encoder, word_tokenizer

CAPACITY = 4096
END_ID = 2
#: Classes up to this one get bins; shorter lengths are filling.
CLASSES = 16
#: A worker packs this many tokens at a time (a longer document alone), which bounds its memory.
CHUNK_TOKENS = 4_000_000
#: Words that a worker keeps the ids of, about 150 bytes each.
CACHE_WORDS = 1_200_000
_SEQUENCE_BITS = 33  # sequences of one task
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


def harmonic_pieces(lengths: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> np.ndarray:
    """Pieces (document, start, length, bin, offset) of documents with these lengths.

    Every token is in one piece; bins are numbered from 0, their pieces are
    gapless from offset 0; a bin holds ``capacity`` tokens or a power of two.
    Equal lengths are taken in the order given. Lengths of 0 have no piece.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    out: list[np.ndarray] = []
    whole = lengths // capacity
    docs = np.repeat(np.arange(len(lengths)), whole)
    block = np.arange(len(docs)) - np.repeat(np.cumsum(whole) - whole, whole)
    bins = len(docs)
    full = np.full(bins, capacity)
    out.append(np.stack([docs, block * capacity, full, np.arange(bins), np.zeros(bins, np.int64)], axis=1))

    rest = np.flatnonzero(lengths % capacity)
    left = lengths[rest] % capacity
    kind = np.minimum(capacity // np.maximum(left, 1), classes)
    fill = [rest[kind == classes]]
    groups: list[np.ndarray] = []  # a row of document numbers for each bin of one class
    for k in range(1, classes):
        own = rest[kind == k]
        own = own[np.argsort(lengths[own] % capacity, kind="stable")]
        odd = len(own) % k
        fill.append(own[:odd])
        groups.append(own[odd:].reshape(-1, k))
    loads = [(lengths[g] % capacity).sum(axis=1) for g in groups]
    room = np.concatenate([capacity - load for load in loads]) if groups else np.zeros(0, np.int64)
    # take apart the bins with the most room until the stream fills the others
    order = np.argsort(-room, kind="stable")
    supply = sum(int((lengths[f] % capacity).sum()) for f in fill)
    need = room.sum() - np.concatenate([[0], np.cumsum(room[order])])
    have = supply + np.concatenate([[0], np.cumsum(capacity - room[order])])
    apart = np.zeros(len(room), dtype=bool)
    apart[order[: int(np.argmax(have >= need))]] = True
    at = 0
    gap_bin, gap_at, gap_size = [], [], []
    for group, load in zip(groups, loads):
        gone = apart[at : at + len(group)]
        at += len(group)
        fill.append(group[gone].ravel())
        stay = group[~gone]
        if not len(stay):
            continue
        size = lengths[stay] % capacity
        offset = np.cumsum(size, axis=1) - size
        number = bins + np.repeat(np.arange(len(stay)), stay.shape[1])
        flat = stay.ravel()
        out.append(np.stack([flat, lengths[flat] // capacity * capacity, size.ravel(), number, offset.ravel()], axis=1))
        gap_bin.append(bins + np.arange(len(stay)))
        gap_at.append(load[~gone])
        gap_size.append(capacity - load[~gone])
        bins += len(stay)
    gap_bin, gap_at, gap_size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gap_bin, gap_at, gap_size))

    stream = np.concatenate(fill)
    stream_size = lengths[stream] % capacity
    extra = int(stream_size.sum() - gap_size.sum())
    tail = [capacity] * (extra // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if extra % capacity >> b & 1]
    slot_bin = np.concatenate([gap_bin, bins + np.arange(len(tail))]).astype(np.int64)
    slot_at = np.concatenate([gap_at, np.zeros(len(tail), np.int64)]).astype(np.int64)
    slot_size = np.concatenate([gap_size, np.array(tail, dtype=np.int64)]).astype(np.int64)
    out.append(_pour(stream, stream_size, lengths[stream] // capacity * capacity, slot_bin, slot_at, slot_size))
    pieces = np.concatenate(out)
    return pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]


def _pour(stream, size, first, slot_bin, slot_at, slot_size) -> np.ndarray:
    """Cut a stream of documents at the ends of the slots that it fills exactly."""
    doc_end, slot_end = np.cumsum(size), np.cumsum(slot_size)
    ends = np.union1d(doc_end, slot_end[slot_size > 0])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if not len(ends):
        return np.zeros((0, 5), dtype=np.int64)
    d = np.searchsorted(doc_end, starts, side="right")
    s = np.searchsorted(slot_end, starts, side="right")
    return np.stack(
        [
            stream[d],
            first[d] + starts - (doc_end[d] - size[d]),
            ends - starts,
            slot_bin[s],
            slot_at[s] + starts - (slot_end[s] - slot_size[s]),
        ],
        axis=1,
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = True,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """One row per piece of a packed document (schema ``PIECES``), with its ids as bytes.

    A narrow job: each task packs the rows it reads, ``chunk_tokens`` at a time, so
    a repeated task gives the same rows and no key can be hot. ``capacity`` is a
    power of two. A null or empty text is a document of the end id alone; a null
    id stays null; repeated ids are documents of their own; an empty table gives
    no piece. Other columns are not looked at.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, CACHE_WORDS).encode
        sequence = TaskContext.get().partitionId() << _SEQUENCE_BITS
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = [t + end for t in encode(part.column(1).to_pylist())]
                ids += part.column(0).to_pylist()
                tokens += found
                held += sum(map(len, found)) // 4
                if held >= chunk_tokens:
                    yield from emit(ids, tokens, sequence)
                    sequence += held // capacity + capacity.bit_length()  # full bins and the tail
                    ids, tokens, held = [], [], 0
        if ids:
            yield from emit(ids, tokens, sequence)

    def emit(ids, tokens, sequence) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) // 4 for t in tokens], dtype=np.int64)
        pieces = harmonic_pieces(sizes, capacity)
        for i in range(0, len(pieces), 4096):
            doc, start, length, number, offset = pieces[i : i + 4096].T
            cuts = [tokens[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            columns = [
                pa.array([ids[d] for d in doc.tolist()], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                pa.array(sizes[doc]),
                pa.array(number + sequence),
                pa.array(offset),
            ]
            if with_ids:
                columns.append(pa.array(cuts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    names_out = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(pack, schema)


@register("op4_harmonic_packing")
def op4(spark, folder):
    return pack_documents(table(spark, folder, "documents"), word_tokenizer(), with_ids=False)
