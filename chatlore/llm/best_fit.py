"""Packed token-id matrices: best-fit-decreasing with a segment tree over free capacities.

Every task packs the documents of its own input split, a bounded block of tokens at a time, so
nothing is shuffled, no group grows with the data and a lost task is simply run again.  A block's
loss is one part-filled sequence or so out of about a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import id_and_text, slices
from chatlore.llm.tokens import tokens, vocabulary_path

CAPACITY = 2048
END_ID = 49407
PAD_ID = 0
BLOCK_TOKENS = 2_000_000     # tokens packed together in a task
EMIT_SEQUENCES = 128

SCHEMA = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<long>, starts array<long>")


class FreeSpace:
    """Open sequences by free capacity; a segment tree finds the tightest that still fits."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._some = [0] * (2 * self._leaves)   # sequences in the node's capacity range
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, free: int, change: int) -> None:
        node = self._leaves + free
        while node:
            self._some[node] += change
            node >>= 1

    def put(self, sequence: int, free: int) -> None:
        if free:
            self._open[free].append(sequence)
            self._count(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The sequence of least free capacity >= ``length`` and that capacity."""
        some, node = self._some, self._leaves + length
        while not some[node]:                    # up until a range to the right holds one
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:               # down to its least capacity
            node <<= 1
            node += not some[node]
        free = node - self._leaves
        self._count(free, -1)
        return self._open[free].pop(), free


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces (by index) of each sequence."""
    space, sequences = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = space.take(lengths[i])
        if found is None:
            sequences.append([i])
            space.put(len(sequences) - 1, capacity - lengths[i])
        else:
            sequences[found[0]].append(i)
            space.put(found[0], found[1] - lengths[i])
    return sequences


def _pack_block(block: list[tuple[int | None, np.ndarray]], first: int, capacity: int) -> Iterator[pa.RecordBatch]:
    pieces = [(doc, start, ids[start:start + capacity]) for doc, ids in block for start in range(0, len(ids), capacity)]
    sequences = best_fit([len(p[2]) for p in pieces], capacity)
    for low in range(0, len(sequences), EMIT_SEQUENCES):
        rows = []
        for k, members in enumerate(sequences[low:low + EMIT_SEQUENCES], first + low):
            ends = np.cumsum([len(pieces[i][2]) for i in members])
            ids = np.full(capacity, PAD_ID, "<u4")
            ids[:ends[-1]] = np.concatenate([pieces[i][2] for i in members])
            positions = np.zeros(capacity, "<u4")
            positions[:ends[-1]] = np.concatenate([np.arange(len(pieces[i][2])) for i in members])
            rows.append((k, int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], positions.tobytes(),
                         [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                         names=[x.split()[0] for x in SCHEMA.split(", ")])
    return len(sequences)


def pack_matrices(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                  block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence: ``ids`` (``capacity`` little-endian 32-bit ids, ``PAD_ID`` after
    ``n_tokens``), ``cu_seqlens`` (0 and the end of each segment), ``positions`` (from 0 again at each
    segment), and the document and first token of each segment.

    Every document is its ids and ``end_id``; one longer than ``capacity`` is cut into full pieces and
    a rest, all of which are packed.  Null and empty texts are the end id alone.  Repeated rows and null
    ids are packed like any others; pieces of one length go in input order.  An empty table gives no rows.
    ``sequence_id`` is unique: the task's number times 2**32, plus a count.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens(path)
        tail = np.array([end_id], np.uint16)
        first = TaskContext.get().partitionId() << 32
        block: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate((vocabulary.of(text.as_py()), tail))
                block.append((doc, ids))
                held += len(ids)
                if held >= block_tokens:
                    first += yield from _pack_block(block, first, capacity)
                    block, held = [], 0
        if block:
            yield from _pack_block(block, first, capacity)

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed sequences as a Parquet table of fixed-size id rows (a shared or object-store path)."""
    packed.write.parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "starts",
                         F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
