"""Removal of long repeated passages by recompression.

Every document is rewritten as a shrinking sequence of globally named symbols: runs of one word
become one symbol, then three rounds join neighbouring symbols (a, b) whose names' coins are 0
and 1.  A name is a hash of what the symbol stands for and a round looks at a symbol and its
neighbours only, so all tasks agree on names without an exchange and equal passages get equal
symbols, except within 8 words of their ends (1 for a run that reaches outside, then 1 + 2 + 4).

Each window of ``WINDOW`` words has an anchor: of the top-level symbols that start in its middle,
the one with the least name.  Equal windows have the same anchor, so a window repeats only if its
anchor (the symbol with 8 words on either side, all inside the window) does.  Spark counts the
anchors, a seventh of the words; then, for windows whose anchor repeats, the windows themselves,
which verifies the find exactly.  Both counts keep the single ones, so nothing is joined on a hot
key, and a passage that a third of all documents share is pre-aggregated like any other.  Of whole
texts that occur again, one sends its windows.

Windows that touch a run are always verified, as a run's symbol has no bounded length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import (RollingHash, as_long, id_and_text, mix, row_ref, slices, utf8, word_hashes,
                                 words)

WINDOW = 35
ROUNDS = 3
MARGIN = 2 ** ROUNDS          # words at either end of a window whose symbols may differ
_STARTS = WINDOW - 2 * MARGIN - 2 ** ROUNDS + 1  # places where an anchor may start
_PLACE = np.uint64((1 << 20) - 1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(h: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols of the last round."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    length = np.diff(np.append(first, len(h))).astype(np.uint64)
    names = np.where(length > 1, mix(h[first] + mix(length)), h[first])
    for r in range(rounds):
        coin = (names >> np.uint64(r + 1) & np.uint64(1)).astype(bool)
        joins = ~coin[:-1] & coin[1:]
        left = np.flatnonzero(joins)
        names = names.copy()
        names[left] = mix(names[left] * np.uint64(3) + mix(names[left + 1] + np.uint64(r + 11)))
        stays = np.ones(len(names), bool)
        stays[left + 1] = False
        names, first = names[stays], first[stays]
    return names, first


class Passage:
    """The windows of one document (of ``WINDOW`` words at least) and their anchors."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.windows = self.n - WINDOW + 1
        self.rolling = RollingHash(h)
        names, first = symbols(h)
        ends = np.zeros(self.n, np.int64)
        ends[first] = np.append(first[1:], self.n)
        # least name per middle, the first of equals: names keep their upper bits, places go below
        place = np.arange(self.n, dtype=np.uint64)
        at = np.full(self.n, _TOP, np.uint64)
        at[first] = names & ~_PLACE | place[first] & _PLACE
        least = at[MARGIN:]
        width = 1
        while 2 * width <= _STARTS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:len(least) - (_STARTS - width)], least[_STARTS - width:])[:self.windows]
        begin = place[MARGIN:MARGIN + self.windows]
        self.anchor = (begin + ((least - begin) & _PLACE)).astype(np.int64)
        # windows that touch a run: no anchor, always verified
        twice = np.concatenate(([0], np.cumsum(h[1:] == h[:-1]), [0]))
        twice[-1] = twice[-2]
        self.loose = twice[WINDOW - 1: WINDOW - 1 + self.windows] > twice[: self.windows]
        self.anchor[self.loose] = 0
        tight = self.anchor[~self.loose]         # in order, as the least of moving windows is
        self.places = tight[np.append(True, tight[1:] != tight[:-1])[:len(tight)]]
        self._ends = ends

    def keys(self) -> np.ndarray:
        """Names of the anchors at ``places``, with the words that any of their windows holds."""
        return self.rolling.of(self.places - MARGIN, self._ends[self.places] + MARGIN)

    def candidates(self, single: list[int] | None) -> np.ndarray:
        """Windows to verify: those whose anchor isn't one of the ``single`` ones."""
        alone = np.zeros(self.n, bool)
        if single is not None:
            alone[np.asarray(single, np.int64)] = True
        return np.flatnonzero(self.loose | ~alone[self.anchor])

    def window_hashes(self, start: np.ndarray) -> np.ndarray:
        return self.rolling.of(start, start + WINDOW)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, refs, places = [], [], []
        for text, ref in zip(utf8(batch.column("text")), batch.column("ref").to_numpy(), strict=True):
            parts = words(text)
            if len(parts) >= WINDOW:
                p = Passage(word_hashes(parts))
                keys.append(p.keys())
                refs.append(np.full(len(p.places), ref))
                places.append(p.places)
        if keys:
            yield pa.RecordBatch.from_arrays([as_long(np.concatenate(keys)), pa.array(np.concatenate(refs)),
                                              pa.array(np.concatenate(places).astype(np.int32))],
                                             names=["key", "ref", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for text, ref, single, spare in zip(utf8(batch.column("text")), batch.column("ref").to_numpy(),
                                            batch.column("places").to_pylist(), batch.column("spare").to_pylist(), strict=True):
            parts = [] if spare else words(text)        # its copy stands for it
            if len(parts) >= WINDOW:
                p = Passage(word_hashes(parts))
                if len(start := p.candidates(single)):
                    yield pa.RecordBatch.from_arrays(
                        [as_long(p.window_hashes(start)), pa.array(np.full(len(start), ref)),
                         pa.array(start.astype(np.int32))], names=["key", "ref", "place"])


def kept_words(parts: list[bytes], single_anchors: list[int] | None, single_windows: list[int] | None,
               copied: bool) -> np.ndarray:
    """Which words of a document stay."""
    cover = np.zeros(len(parts) + 1, np.int32)
    if len(parts) >= WINDOW and copied:
        cover[0] = 1
    elif len(parts) >= WINDOW:
        p = Passage(word_hashes(parts))
        repeated = np.zeros(p.windows, bool)
        repeated[p.candidates(single_anchors)] = True
        if single_windows is not None:
            repeated[np.asarray(single_windows, np.int64)] = False
        start = np.flatnonzero(repeated)
        cover[start] += 1
        cover[start + WINDOW] -= 1
    return np.cumsum(cover[:-1]) == 0


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, kept = [], []
        for text, anchors, windows, spare in zip(utf8(batch.column("text")), batch.column("places").to_pylist(),
                                                 batch.column("windows").to_pylist(), batch.column("spare").to_pylist(), strict=True):
            parts = words(text)
            stays = kept_words(parts, anchors, windows, spare is not None)
            n.append(len(parts))
            kept.append((int(stays.sum()), b" ".join([w for w, s in zip(parts, stays.tolist(), strict=True) if s])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()),
             pa.array([a - k for a, (k, _) in zip(n, kept, strict=True)], pa.int64()),
             pa.array([t for _, t in kept], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"])


def _single(rows: DataFrame, name: str) -> DataFrame:
    """Per document, the places whose key is found nowhere else."""
    once = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("ref").alias("ref"), F.min("place").alias("place"))
            .where("c = 1"))
    return once.groupBy(F.col("ref").alias("of")).agg(F.collect_list("place").alias(name))


def _copies(docs: DataFrame) -> DataFrame:
    """``copy, spare``: the documents whose whole text occurs again; all but one of each are spare."""
    texts = id_and_text(docs).where("text is not null").select(row_ref().alias("copy"), F.xxhash64("text").alias("hash"))
    more = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("one")).where("n > 1")
    return texts.join(more, "hash").select("copy", (F.col("copy") != F.col("one")).alias("spare")).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: each document without the words covered by a window of
    ``WINDOW`` consecutive words that also starts anywhere else (another document, another place of
    the same one).  Windows are judged on the input.

    Null or empty text, or fewer than ``WINDOW`` words: nothing is removed (``kept_text`` is the words
    joined by one space, ``''`` without any).  Repeated rows are documents like any others, so all their
    windows go.  A null ``doc_id`` is kept as it is.  An empty table gives an empty result.
    """
    # one exchange of the texts serves all three passes (each takes all columns, so that it is one)
    rows = id_and_text(docs).withColumn("ref", row_ref()).repartition("ref")
    single = _single(rows.mapInArrow(_anchors, "key long, ref long, place int"), "places")
    known = (rows.join(single, F.col("ref") == F.col("of"), "left").drop("of")
             .join(_copies(docs), F.col("ref") == F.col("copy"), "left").drop("copy"))
    windows = _single(known.mapInArrow(_windows, "key long, ref long, place int"), "windows")
    return known.join(windows, F.col("ref") == F.col("of"), "left").drop("of").mapInArrow(
        _removal, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """The same by counting all windows; for tests on small tables."""
    from collections import Counter

    split = [words(t.encode()) if t else [] for t in texts]
    seen = Counter(tuple(w[i:i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - WINDOW + 1) if seen[tuple(w[i:i + WINDOW])] > 1 for k in range(i, i + WINDOW)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
