"""Packing by cutting-stock column generation.

Documents become token pieces (one document, cut every ``CAPACITY`` ids).  Piece lengths, rounded up
to units, form a histogram of at most ``CAPACITY / UNIT`` classes whatever the input; only it
reaches the driver.  A linear program over packing patterns covers it with the fewest sequences:
starting from one pattern per class, a knapsack dynamic program prices the classes by the current
duals and adds the best pattern until none improves (revised simplex).  The counts are rounded
down, what is left over is packed first-fit, and Spark hands the pattern slots of each class to the
ranked pieces of that class.  Ranks come from counts per (class, hash bucket), so no class, however
common, is ranked in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlore.llm.common import id_and_text, slices, written
from chatlore.llm.tokens import tokens, vocabulary_path

CAPACITY = 2048
UNIT = 8
END_ID = 1
ROWS_PER_BUCKET = 50_000
MAX_COLUMNS = 4_000          # simplex steps; any stop leaves a valid packing

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut every ``capacity`` ids (``keep_ids``
    adds them as little-endian 32-bit bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens(path)
        tail = np.array([end_id], np.uint16)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate((vocabulary.of(text.as_py()), tail)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity].tobytes()
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece))
            kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)],
                                             names=[x.split()[0] for x in schema.split(", ")])

    schema = PIECES + ", ids binary" * keep_ids
    return id_and_text(docs).mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern of ``sizes`` (ascending)."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room], last[room] = value[room - 1], -1
        if k := fits[room]:
            worth = value[room - sizes[:k]] + prices[:k]
            best = int(worth.argmax())
            if worth[best] > value[room] + 1e-12:
                value[room], last[room] = worth[best], best
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(value[capacity]), pattern


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: basic patterns (one per column) and how often the LP uses each."""
    basis = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse.diagonal() * demand
    for _ in range(MAX_COLUMNS):
        worth, pattern = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        some = np.flatnonzero(pattern)
        change = (inverse[:, some] * pattern[some]).sum(axis=1)
        rises = change > 1e-9
        ratio = np.full(len(sizes), np.inf)
        ratio[rises] = amount[rises] / change[rises]
        leaves = int(ratio.argmin())
        basis[:, leaves] = pattern
        row = inverse[leaves] / change[leaves]
        inverse -= change[:, None] * row
        inverse[leaves] = row
        enters = ratio[leaves]
        amount = np.maximum(amount - change * enters, 0)
        amount[leaves] = enters
    return basis, amount


def plan(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns ({size: copies}, times) that hold exactly ``demand[i]`` items of ``sizes[i]``."""
    if not sizes:
        return []
    s, left = np.asarray(sizes, np.int64), np.asarray(demand, np.int64).copy()
    order = np.argsort(s)
    s, left = s[order], left[order]
    basis, amount = fractional_patterns(s, left, capacity)
    out: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-(amount - np.floor(amount + 1e-6)), kind="stable"):
        pattern, times = basis[:, j], int(np.floor(amount[j] + 1e-6))
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= pattern * times
            out.append((pattern, times))
    for j in np.argsort(-(amount - np.floor(amount + 1e-6)), kind="stable"):
        pattern = basis[:, j]
        if (pattern <= left).all():
            left -= pattern
            out.append((pattern, 1))
    while left.any():  # first fit, longest first: a few patterns' worth of pieces
        pattern, room = np.zeros(len(s), np.int64), capacity
        for i in range(len(s) - 1, -1, -1):
            pattern[i] = min(left[i], room // s[i])
            room -= int(pattern[i] * s[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return [({int(s[i]): int(p[i]) for i in np.flatnonzero(p)}, t) for p, t in out]


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``rank`` of each piece within its ``units`` class, from 0."""
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    marked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (marked.groupBy("units", "bucket").agg(F.count(F.lit(1)).alias("n"))
            .select("units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("units", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (marked.withColumn("nth", F.row_number().over(inside) - 1).join(base, ["units", "bucket"])
            .withColumn("rank", F.col("base") + F.col("nth")).drop("bucket", "base", "nth"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """``pieces`` with ``sequence_id`` (0, 1, ... without gaps) and ``offset`` in that sequence."""
    sized = pieces.withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r.units: r.n for r in sized.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity / unit rows
    slots, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan([*histogram], [*histogram.values()], capacity // unit):
        for units, copies in pattern.items():
            slots.append((units, taken[units], taken[units] + copies * times, copies, sequence))
            taken[units] += copies * times
        sequence += times
    spark = pieces.sparkSession
    table = F.broadcast(spark.createDataFrame(slots, "of int, low long, high long, copies long, first long"))
    ranked = _ranked(sized, sum(histogram.values()))
    placed = ranked.join(table, (F.col("units") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div copies"))
    before = (Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packed pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` (and ``ids`` with ``keep_ids``).

    Null and empty text: the end id alone.  Long texts: cut every ``CAPACITY`` ids, nothing is lost.
    Repeated rows and null ids are packed like any others.  Ties in a class go by id, start and
    checksum.  An empty table gives no pieces.
    """
    return pack(written(cut(docs, path or vocabulary_path(), keep_ids=keep_ids), "pieces"))
