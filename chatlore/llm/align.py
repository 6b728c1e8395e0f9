"""Alignment of two tokenizers' tokens over the same bytes.

Diagonal run skipping: with both sequences as arrays of end offsets, the tokens of one-to-one
stretches end at equal offsets under a fixed shift between the indices.  Exponential probing compares
ever longer slices of the two arrays at the current shift and so jumps such a stretch; where they
part, the smaller end is advanced until both meet again, which closes an irregular group and
gives the new shift.  Links are the diagonals of the stretches and the overlaps inside the irregular
groups.

Corpus counts (in how many documents two ids are linked) come from two aggregations: a block of
documents sends every id pair once with its number of documents; the scored pairs go back to the
blocks.  A pair moves at most once a block, so the most frequent pair makes no hot key.

Results for odd input: null and empty texts, and texts whose tokens' bytes aren't the text (a literal
U+2581, for instance), have no tokens: zeros and an empty digest.  Null ids and repeated rows are
documents of their own; a text of any length is one row, handled ``SEGMENT`` characters at a time; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlore.llm.byte_bpe import _packed, _unpacked, encoding, pre_tokens, segments, split_pattern
from chatlore.llm.common import id_and_text, written
from chatlore.llm.tokens import _byte_letters, vocabulary_path

VOCABULARY_A, RANKS_A, VOCABULARY_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
BLOCK_LINKS = 4_000_000      # a block closes with the document that reaches it
SEGMENT = 1 << 17            # characters tokenised and aligned at once
SIDE = 1 << 32               # a pair is the first id times this, plus the second

BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, n_pairs array<long>, codes binary, pairs array<struct<pair: long, n: long>>")


class Tokens:
    """The ids of both vocabularies and the bytes of every token."""

    def __init__(self, path_a: str, ranks_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        self._ranks = encoding(ranks_a, split_pattern())
        self._unsure = pre_tokens(split_pattern()).unsure
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of the second vocabulary cross a space; texts can't be cut there")
        self.lengths_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.lengths_b = np.fromiter(map(len, self.bytes_b), np.int64)

    def a(self, segment: str) -> np.ndarray:
        """Ids of a segment by the first vocabulary: the merges run on its rank form, in texts of
        characters newer than some engine's tables on the vocabulary file itself."""
        if self._unsure(segment):
            return np.array(self._a.encode(segment, add_special_tokens=False).ids, np.int64)
        return np.array(self._ranks.encode_ordinary(segment), np.int64)

    def b(self, segment: str) -> np.ndarray:
        """Ids of a segment that begins with a space, which stands for the one the second vocabulary adds.
        No merge crosses from a character to a space, so segments' ids are those of the whole text."""
        return np.array(self._b.encode(segment[1:], num_threads=1), np.int64)

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, text: bytes) -> bool:
        """Whether both sequences' bytes are the text; the byte-level vocabulary drops or spells it."""
        return (int(self.lengths_a[ids_a].sum()) == int(self.lengths_b[ids_b].sum()) == len(text)
                and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == text)


@lru_cache(maxsize=1)
def tokens(path_a: str, ranks_a: str, path_b: str) -> Tokens:
    return Tokens(path_a, ranks_a, path_b)


def irregular_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The groups that are not one token to one, as rows ``(first a, end a, first b, end b)``; all other
    tokens are one-to-one.  Both arrays rise and end at the same offset."""
    # different last items, so that no comparison runs past the ends
    a = np.append(ends_a, -1).astype("<i4").tobytes()
    b = np.append(ends_b, -2).astype("<i4").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    i = j = 0
    n = len(list_a)
    found = array("q")
    while i < n:
        if list_a[i] == list_b[j]:
            i += 1
            j += 1
            at_a, at_b, step = 4 * i, 4 * j, 16
            while a[at_a:at_a + step] == b[at_b:at_b + step]:     # at this shift, ever longer slices
                at_a += step
                at_b += step
                step += step
            while step > 4:                                       # the rest of the stretch
                step >>= 1
                if a[at_a:at_a + step] == b[at_b:at_b + step]:
                    at_a += step
                    at_b += step
            i, j = at_a >> 2, at_b >> 2
        else:
            first_a, first_b = i, j
            end_a, end_b = list_a[i], list_b[j]
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a = list_a[i]
                else:
                    j += 1
                    end_b = list_b[j]
            i += 1
            j += 1
            found.extend((first_a, i, first_b, j))
    return np.frombuffer(found, np.int64).reshape(-1, 4)


def _inner(groups: np.ndarray, side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``size`` tokens, which are in an irregular group; and which open a group."""
    start, end = groups[:, side], groups[:, side + 1]
    change = np.zeros(size + 1, np.int8)
    change[start] += 1
    change[end] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    opens = ~inside
    opens[start] = True
    return inside, opens


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, group of every a, group of every b)``; pairs are one per link."""
    groups = irregular_groups(ends_a, ends_b)
    in_a, opens_a = _inner(groups, 0, len(ids_a))
    in_b, opens_b = _inner(groups, 2, len(ids_b))
    pairs = ids_a[~in_a] * SIDE + ids_b[~in_b]
    if len(groups):
        # inside irregular groups every stretch between neighbouring ends is one link
        odd_a, odd_b = ends_a[in_a], ends_b[in_b]
        both = np.concatenate((odd_a, odd_b))
        order = np.argsort(both, kind="stable")      # two rising runs are merged, a's first among equals
        ends, of_a = both[order], order < len(odd_a)
        shared = np.diff(ends, prepend=-1) == 0      # an end of b that a has too
        last = np.append(~shared[1:], True)
        before_a = np.cumsum(of_a) - (of_a | shared)
        before_b = np.cumsum(~of_a) - ~of_a
        pairs = np.concatenate((pairs, ids_a[in_a][before_a[last]] * SIDE + ids_b[in_b][before_b[last]]))
    return pairs, np.cumsum(opens_a) - 1, np.cumsum(opens_b) - 1


_DIGITS = 5      # of the longest id


@lru_cache(maxsize=1)
def _decimals() -> np.ndarray:
    """The digits of every id below 100,000 as the low bytes of a word, 0 where there is none; the next
    byte is for the sign after it."""
    out = np.zeros((10 ** _DIGITS, 8), np.uint8)
    ids = np.arange(10 ** _DIGITS)
    for place in range(_DIGITS):
        left = ids // 10 ** place
        out[:, _DIGITS - 1 - place] = np.where((left > 0) | (place == 0), left % 10 + ord("0"), 0)
    return out.view("<u8").reshape(-1)


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``."""
    table = _decimals()
    comma, bar, semicolon = (np.uint64(ord(c) << 8 * _DIGITS) for c in ",|;")
    per_a, per_b = np.bincount(group_a), np.bincount(group_b)
    out = np.empty(len(ids_a) + len(ids_b), "<u8")
    out[np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]] = (
        table[ids_a] | np.where(np.diff(group_a, append=-1) == 0, comma, bar))
    out[np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]] = (
        table[ids_b] | np.where(np.diff(group_b, append=-1) == 0, comma, semicolon))
    flat = out.view(np.uint8)
    return flat[flat != 0].tobytes()[:-1]


def _document(text: str | None, both: Tokens) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """``n_a, n_b, n_groups, n_links, groups_sha256``, the distinct pairs and how often each is linked."""
    nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
    if not text:
        return nothing
    n_a = n_b = n_groups = n_links = 0
    digest, pairs, times = hashlib.sha256(), [], []
    for segment in segments(" " + text, SEGMENT):
        ids_a, ids_b = both.a(segment), both.b(segment)
        spelled = segment.encode()
        if not both.spelled(ids_a, ids_b, spelled):
            return nothing
        ends_a, ends_b = np.cumsum(both.lengths_a[ids_a]), np.cumsum(both.lengths_b[ids_b])
        links, group_a, group_b = aligned(ids_a, ids_b, ends_a, ends_b)
        if n_a:
            digest.update(b";")
        digest.update(groups_text(ids_a, ids_b, group_a, group_b))
        n_a, n_b, n_links = n_a + len(ids_a), n_b + len(ids_b), n_links + len(links)
        n_groups += int(group_a[-1]) + 1
        some, often = np.unique(links, return_counts=True)
        pairs.append(some)
        times.append(often)
    if len(pairs) > 1:
        some, where = np.unique(np.concatenate(pairs), return_inverse=True)
        pairs, times = [some], [np.bincount(where, np.concatenate(times)).astype(np.int64)]
    return n_a, n_b, n_groups, n_links, digest.hexdigest(), pairs[0], times[0]


def linked_blocks(docs: DataFrame, path_a: str, ranks_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Blocks of documents with their digests, their pairs as codes, and the block's distinct pairs with
    the number of its documents that hold each."""

    def close(block: int, rows: list[tuple]) -> pa.RecordBatch:
        all_pairs = np.concatenate([r[6] for r in rows])
        pairs, codes, docs_of = np.unique(all_pairs, return_inverse=True, return_counts=True)
        times = np.concatenate([r[7] for r in rows])
        lists = [pa.array([[r[k] for r in rows]], pa.list_(pa.string() if k == 5 else pa.int64())) for k in range(6)]
        sent = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(docs_of.astype(np.int64))], names=["pair", "n"])
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), *lists, pa.array([[len(r[6]) for r in rows]], pa.list_(pa.int64())),
             pa.array([_packed(codes.astype("<u4"), times.astype("<u4"))], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), sent)],
            names=[c.split()[0] for c in re.sub("<.*?>+", "", BLOCKS).split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens(path_a, ranks_a, path_b)
        block, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                rows.append((doc.as_py(), *_document(text.as_py(), both)))
                held += rows[-1][4] + 1
                if held >= block_links:
                    yield close(block, rows)
                    block, rows, held = block + 1, [], 0
        if rows:
            yield close(block, rows)

    return id_and_text(docs).mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count`` (documents that hold it linked) and ``best`` (the count is the highest of its first
    id; that group has at most as many rows as the second vocabulary ids)."""
    counts = blocks.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("count"))
    first = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(first)).alias("best"))


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            held = {c: batch.column(c)[k].as_py() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")}
            codes, times = (np.frombuffer(x, "<u4").astype(np.int64) for x in _unpacked(batch.column("codes")[k].as_py(), 2))
            scores = batch.column("scores")[k].values
            count, best = np.zeros(0, np.int64), np.zeros(0, bool)
            if scores is not None and len(scores):
                code = scores.field("code").to_numpy()
                count, best = np.empty(len(code), np.int64), np.empty(len(code), bool)
                count[code] = scores.field("count").to_numpy()
                best[code] = scores.field("best").to_numpy(zero_copy_only=False)
            ends = np.cumsum(held.pop("n_pairs"))
            for name, value in (("n_best", times * best[codes]), ("count_sum", times * count[codes])):
                sums = np.concatenate(([0], np.cumsum(value)))
                held[name] = np.diff(sums[np.concatenate(([0], ends)).astype(np.int64)])
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(held[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in names],
                                             names=names)


def align_documents(docs: DataFrame, path_a: str | None = None, ranks_a: str | None = None, path_b: str | None = None,
                    block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per row of ``docs``: the tokens of space + text by both vocabularies (``n_a``, ``n_b``), the groups
    between common ends, the links, how many links are of their first id's most frequent pair in the
    corpus (``n_best``, ties included), the sum of the links' counts, and the digest of the groups."""
    blocks = written(linked_blocks(docs, path_a or vocabulary_path(VOCABULARY_A), ranks_a or vocabulary_path(RANKS_A),
                                   path_b or vocabulary_path(VOCABULARY_B), block_links), "align-blocks")
    asked = blocks.select("block", F.posexplode("pairs").alias("code", "p")).select("block", "code", "p.pair")
    scores = (asked.join(pair_counts(blocks), "pair")
              .groupBy("block").agg(F.collect_list(F.struct("code", "count", "best")).alias("scores")))
    return blocks.drop("pairs").join(scores, "block", "left").mapInArrow(_scored, RESULT)
