"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

The terms of a text are its hashed character trigrams (case kept, white space as it is, so layout
and shouting count) and hashed shapes of its words.  A bounded sample of labelled documents gives
term weights and, by a truncated singular value decomposition, ``RANK`` latent directions; these
and the labelled vectors (``SAMPLE x RANK`` numbers) are broadcast.  Every document is projected and
compared with all labelled vectors by one matrix product per block; the ``NEIGHBOURS`` nearest
vote, weighted by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import id_and_text, slices, utf8

SAMPLE = 4_000               # labelled documents learned from, the first by hash of their id
TRIGRAMS, SHAPES = 1 << 11, 1 << 9
TERMS = TRIGRAMS + SHAPES
RANK = 64
NEIGHBOURS = 15
POWER = 8                    # of the cosine, as a vote's weight
THRESHOLD = 0.3
_SHAPE = np.zeros(256, np.uint8)
for _k, _group in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?",
                             b"#*$%&|<>", b"'\"()[]{}-_/\\+=@^~`"), 1):
    _SHAPE[list(_group)] = _k
_SHAPE[128:] = 8
_SHAPE[list(b" \t\n\r\v\f")] = 9


def terms(text: bytes | None) -> np.ndarray:
    """Counts of the hashed terms of a text."""
    out = np.zeros(TERMS, np.float32)
    b = np.frombuffer(text or b"", np.uint8)
    if len(b) >= 3:
        x = b.astype(np.uint32)
        code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
        out[:TRIGRAMS] = np.bincount(code >> np.uint32(21), minlength=TRIGRAMS)
        s = _SHAPE[b]
        s = s[np.append(True, s[1:] != s[:-1])].astype(np.uint32)   # runs of one kind count once
        if len(s) >= 4:
            code = (s[:-3] * 1000 + s[1:-2] * 100 + s[2:-1] * 10 + s[3:]) * np.uint32(2654435761)
            out[TRIGRAMS:] = np.bincount(code >> np.uint32(23), minlength=SHAPES)
    return out


@dataclass(frozen=True)
class Neighbours:
    """Term weights, latent directions, labelled unit vectors and their labels."""

    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = x @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        cosine = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.clip(np.where(total > 0, vote, prior), 0, 1).round(6)    # the products' last bits depend on the block


def latent_directions(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration (fixed seed)."""
    start = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    q = np.linalg.qr(x.T @ (x @ start))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([terms(t).tobytes() for t in utf8(batch.column("text"))], pa.binary())],
                                         names=["quality", "counts"])


def held_out() -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """From at most ``sample`` labelled rows that aren't held out (null labels teach nothing)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
             .where("doc_id is not null and quality is not null").where(~held_out())
             .groupBy("doc_id").agg(F.avg("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    one = id_and_text(docs).join(F.broadcast(known), "doc_id")          # at most ``sample`` ids
    got = one.select("quality", "text").mapInArrow(_term_rows, "quality double, counts binary").limit(2 * sample).collect()
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in got]) if got else np.zeros((0, TERMS), np.float32)
    y = np.array([r.quality for r in got])
    seen = (counts > 0).sum(axis=0)
    weight = np.log((1 + len(y)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    if not len(y):
        return Neighbours(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y)
    x = np.log1p(counts) * weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    model = Neighbours(weight, latent_directions(x, RANK), np.zeros((0, 1), np.float32), y)
    return Neighbours(weight, model.directions, model.project(counts), y)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its text alone.

    Null, empty and one- or two-character texts have no terms and get the learned share of label 1.
    Equal texts get equal scores (up to the rounding to six digits).  A null ``doc_id`` isn't held out and has no label.  Without labels
    the score is 0.5; an empty table gives no rows.
    """
    rows = id_and_text(docs)
    shared = rows.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score(np.stack([terms(t) for t in utf8(batch.column("text"))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    scored = rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
