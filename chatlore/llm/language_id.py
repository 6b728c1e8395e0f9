"""Language identification by rank-order n-gram profiles.

A profile is a language's ``TOP`` most frequent letter n-grams (1 to 3 letters, word edges
included) in order.  A document's own most frequent n-grams are ranked likewise, and its distance
to a profile is the sum over them of how far out of place each is (``TOP`` if the profile lacks
it).  The nearest profile wins.  Profiles come from all learning rows: tasks count n-grams,
Spark adds the counts up and keeps the first ``TOP`` of each language (a few thousand rows,
broadcast).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlore.llm.common import SLICE_ROWS, slices

TOP = 300
LONGEST = 3
EDGE = 1                     # a code point that is no letter
UNDETERMINED = "und"
COUNTED = 500_000            # distinct n-grams a task holds before it sends its counts on
RESULT = "lang_pred string, score double, distance double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (packed code points, with ``EDGE`` for a word's edge) and their counts."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(letter, c, EDGE).astype(np.int64)
    c = np.concatenate(([EDGE], c[letter | np.append(True, letter[:-1])], [EDGE]))
    c = c[np.append(True, (c[1:] != EDGE) | (c[:-1] != EDGE))]   # one edge between words
    found = [c[c != EDGE]]
    for n in range(2, LONGEST + 1):
        inner = np.ones(len(c) - n + 1, bool)
        for k in range(1, n - 1):
            inner &= c[k:len(c) - n + 1 + k] != EDGE
        code = np.zeros(len(c) - n + 1, np.int64)
        for k in range(n):
            code = code << 21 | c[k:len(c) - n + 1 + k]
        found.append(code[inner])
    return np.unique(np.concatenate(found), return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[int, int]] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(counts, pa.int64()),
                                              pa.array(counts.values(), pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text or "")
        for lang, texts in by.items():
            counts = held.setdefault(lang, {})
            for gram, n in zip(*(x.tolist() for x in ngrams(" ".join(texts))), strict=True):
                counts[gram] = counts.get(gram, 0) + n
        if sum(map(len, held.values())) > COUNTED:
            yield from send()
    yield from send()


@dataclass(frozen=True)
class Profiles:
    """``ranks[i, j]``: rank of n-gram ``grams[i]`` (ascending) in the profile of ``languages[j]``."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """Language, lead over the second nearest (0 to 1), and mean displacement (0 to 1)."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0, 1.0
        order = np.lexsort((grams, -counts))[:TOP]
        at = np.searchsorted(self.grams, grams[order])
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[order][known]
        out = np.full((len(order), len(self.languages)), TOP, np.int64)
        out[known] = np.minimum(TOP, np.abs(self.ranks[at[known]] - np.flatnonzero(known)[:, None]))
        far = out.sum(axis=0)
        best = int(far.argmin())
        mean = float(far[best]) / (TOP * len(order))
        if len(far) == 1:
            return self.languages[best], 1.0 - mean, mean
        second = int(np.partition(far, 1)[1])
        return self.languages[best], (second - int(far[best])) / second if second else 0.0, mean


def learn(rows: DataFrame) -> Profiles:
    """Profiles from ``lang, text``; rows with a null ``lang`` teach nothing."""
    counted = (rows.where("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank - 1).where(F.col("rank") < TOP).collect()   # TOP rows a language
    languages = sorted({r.lang for r in top})
    grams = np.array(sorted({r.gram for r in top}), np.int64)
    ranks = np.full((len(grams), len(languages)), 2 * TOP, np.int64)
    for r in top:
        ranks[np.searchsorted(grams, r.gram), languages.index(r.lang)] = r.rank
    return Profiles(languages, grams, ranks)


def prediction(docs: DataFrame, profiles: Profiles, text: str = "text") -> Column:
    """``struct<lang_pred, score, distance>`` for a column of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.nearest(t) for i in range(0, len(texts), SLICE_ROWS) for t in texts.slice(i, SLICE_ROWS).to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))],
            names=["lang_pred", "score", "distance"])

    return F.arrow_udf(run, RESULT).asNondeterministic()(F.col(text).cast("string"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, distance``: learned from the rows that aren't held out and
    have a ``lang``, predicted for all from the text alone.

    Null text or text without letters: ``und``, score 0.  Ties go to the first language by name.  A null
    ``doc_id`` isn't held out.  Without learning rows all is ``und``; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    profiles = learn(rows.where(~held_out()))
    return (rows.select("doc_id", held_out().alias("held_out"), prediction(rows, profiles).alias("found"))
            .select("doc_id", "held_out", "found.*"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told (columns as they were)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    profiles = learn(rows.where(~held_out()))
    return docs.withColumn("__found", prediction(docs, profiles)).where(
        F.col("__found.lang_pred") != UNDETERMINED).drop("__found")
