"""Byte-level BPE of whole texts by one global shuffle of distinct words, and its inverse.

Documents are exploded into pre-tokens with their positions, a block of documents at a time; a
block keeps one code per position and sends each of its distinct words once.  The words of all
blocks meet by hash bucket, where every distinct word of the corpus is encoded once; the ids go
back to their blocks and the documents are put together by position.  A word moves at most once a
block however often it occurs, so no frequent word makes a hot key, and what moves is the blocks'
vocabularies and not the texts.  Decoding joins the ids with the token-byte table, whose size the
rank file bounds.

Results for odd input: null and empty texts have no ids (and decode to nothing); null ids of
documents and repeated rows are kept, row by row; a text of any length is one row, its pre-tokens
are made ``SEGMENT`` characters at a time; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import id_and_text
from chatlore.llm.tokens import vocabulary_path
from chatlore.session import scratch_path

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_PRE_TOKENS = 2_000_000    # a block closes with the document that reaches it
SEGMENT = 1 << 20               # characters split at once
LEVEL = 6                       # of zstd
EMIT_IDS = 2_000_000            # ids (or decoded bytes) in one Arrow batch, a longer document alone

# Fixed value: Unicode white space (what \s of ``re`` finds, less four control characters).
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(rf"(?<=[^{_SPACES}])(?= [^{_SPACES}])")   # no pre-token spans such a place
BLOCKS = ("block long, doc_ids array<long>, sizes array<long>, codes binary, buckets binary, "
          "vocabulary array<struct<bucket: int, words: binary>>")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut before a single space between words (so
    pre-tokens stay whole); a stretch without such a space is not cut."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF of a general category as a class body of ``re``."""
    found = [o for o in range(0x10000) if unicodedata.category(chr(o)).startswith(kind)]
    starts = [o for o, before in zip(found, [-2, *found]) if o != before + 1]
    ends = [o for o, after in zip(found, [*found[1:], -2]) if o != after - 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


class PreTokens:
    """The matches of the split pattern, as ``tiktoken`` finds them.

    ``re`` with the letters and numbers spelled out splits texts of characters whose class all
    Unicode versions agree on.  In others, each newer character is first replaced by an old one of the
    class that ``tiktoken``'s own engine gives it, and the matches are cut from the original."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        letters, numbers = _ranges("L"), _ranges("N")
        spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{letters}{numbers}]")
        for short, body in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", _SPACES), (r"\S", f"^{_SPACES}")):
            spelled = spelled.replace(short, f"[{body}]")
        self._fast = re.compile(spelled).findall
        self.unsure = re.compile(f"[{_ranges('Cn')}\U00010000-\U0010ffff]").search
        self._slow = regex.compile(pattern).finditer
        one_byte = {bytes([b]): b for b in range(256)}
        self._class = {kind: tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=one_byte, special_tokens={})
                       for kind in (r"\p{L}", r"\p{N}", r"\s")}
        self._old = {r"\p{L}": "ª", r"\p{N}": "½", r"\s": " ", "": "§"}
        self._stand_in = lru_cache(4096)(self._stand_in_of)

    def _stand_in_of(self, char: str) -> str:
        if not self.unsure(char):
            return char
        return self._old[next((kind for kind, e in self._class.items() if e.encode_ordinary(char)), "")]

    def __call__(self, text: str) -> list[str]:
        if not self.unsure(text):
            return self._fast(text)
        return [text[m.start():m.end()] for m in self._slow("".join(map(self._stand_in, text)))]


@lru_cache(maxsize=2)
def pre_tokens(pattern: str) -> PreTokens:
    return PreTokens(pattern)


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _packed(*columns: np.ndarray | bytes) -> bytes:
    """Columns as one compressed value."""
    parts = [c if isinstance(c, bytes) else c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts))


def _unpacked(value: bytes, columns: int) -> list[memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(value))
    ends = 8 * columns + np.cumsum(np.frombuffer(data[:8 * columns], "<u8")).astype(np.int64)
    return [data[a:b] for a, b in zip([8 * columns, *ends.tolist()], ends.tolist())]


def _packed_codes(codes: np.ndarray) -> bytes:
    """Codes of which small ones are frequent: a byte for those below 255, four more for others, each
    place of the bytes by itself."""
    rest = (codes[codes >= 255] - np.uint32(255)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return _packed(np.minimum(codes, 255).astype(np.uint8), *[np.ascontiguousarray(rest[:, k]) for k in range(4)])


def _unpacked_codes(value: bytes) -> np.ndarray:
    first, *rest = (np.frombuffer(part, np.uint8) for part in _unpacked(value, 5))
    codes = first.astype(np.uint32)
    codes[first == 255] = np.ascontiguousarray(np.stack(rest, axis=1)).view("<u4").reshape(-1) + np.uint32(255)
    return codes


class _Codes(dict):
    """Word -> its code, given in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches ``values[start:start + length]`` one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


def _by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    """The codes of each bucket that has some, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def exploded(docs: DataFrame, buckets: int, pattern: str, block_pre_tokens: int = BLOCK_PRE_TOKENS) -> DataFrame:
    """Blocks of documents: every document's pre-tokens as codes by position, the block's distinct words
    by hash bucket, and the bucket of every code.  Codes go from the most frequent word to the rarest,
    and so do the words of a bucket."""

    def close(block: int, ids: list, sizes: list, codes: list[np.ndarray], vocabulary: _Codes) -> pa.RecordBatch:
        positions = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(positions, minlength=len(vocabulary)), kind="stable")
        renamed = np.empty(len(order), np.uint32)
        renamed[order] = np.arange(len(order), dtype=np.uint32)
        words = list(vocabulary)
        words = [words[k].encode() for k in order.tolist()]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), "<u4", len(words))
        sent = []
        for members in _by_bucket(bucket):
            found = [words[k] for k in members.tolist()]
            sent.append({"bucket": int(bucket[members[0]]),
                         "words": _packed(np.fromiter(map(len, found), "<u4", len(found)), b"".join(found))})
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([_packed_codes(renamed[positions])], pa.binary()), pa.array([_packed_codes(bucket)], pa.binary()),
             pa.array([sent], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))],
            names=["block", "doc_ids", "sizes", "codes", "buckets", "vocabulary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokens(pattern)
        block = TaskContext.get().partitionId() << 32
        ids, sizes, codes, vocabulary, held = [], [], [], _Codes(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                size = 0
                for segment in segments(text.as_py() or ""):
                    found = array("I", map(vocabulary.__getitem__, split(segment)))
                    codes.append(np.frombuffer(found, np.uint32))
                    size += len(found)
                ids.append(doc.as_py())
                sizes.append(size)
                held += size + 1
                if held >= block_pre_tokens:
                    yield close(block, ids, sizes, codes, vocabulary)
                    block += 1
                    ids, sizes, codes, vocabulary, held = [], [], [], _Codes(), 0
        if ids:
            yield close(block, ids, sizes, codes, vocabulary)

    return id_and_text(docs).mapInArrow(run, BLOCKS)


def encoded_words(asked: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(block, bucket, words)``, all rows of a bucket in one partition -> ``(block, bucket, ids)``: each
    distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoding(path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, tuple[int, bytes]] = {}
        for batch in batches:
            answers = []
            for value in batch.column("words"):
                lengths, text = _unpacked(value.as_py(), 2)
                ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
                text, start, found = bytes(text), 0, []
                for end in ends:
                    word = text[start:end]
                    start = end
                    ids = known.get(word)
                    if ids is None:
                        new = merge(word)
                        known[word] = ids = (len(new), np.array(new, "<u4").tobytes())
                    found.append(ids)
                answers.append(_packed(np.fromiter((n for n, _ in found), "<u4", len(found)), b"".join(i for _, i in found)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(answers, pa.binary())],
                                             names=["block", "bucket", "ids"])

    return asked.mapInArrow(run, "block long, bucket int, ids binary")


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of blocks whose words have come back with their ids."""
    for batch in batches:
        for row in range(batch.num_rows):
            answers = [_unpacked(a["ids"].as_py(), 2) for a in batch.column("answers")[row].values or ()]
            order = np.argsort(_unpacked_codes(batch.column("buckets")[row].as_py()), kind="stable")   # as they were sent
            sent = np.concatenate([np.frombuffer(n, "<u4") for n, _ in answers] or [np.empty(0, "<u4")]).astype(np.int64)
            flat = np.concatenate([np.frombuffer(i, "<u4") for _, i in answers] or [np.empty(0, "<u4")])
            starts, lengths = np.empty_like(sent), np.empty_like(sent)
            starts[order], lengths[order] = np.cumsum(sent) - sent, sent
            codes = _unpacked_codes(batch.column("codes")[row].as_py())
            docs, ids, held, at = [], [], 0, 0
            for doc, size in zip(batch.column("doc_ids")[row].as_py(), batch.column("sizes")[row].as_py(), strict=True):
                mine = codes[at:at + size]
                at += size
                found = _gathered(flat, starts[mine], lengths[mine])
                docs.append(doc)
                ids.append(found.astype("<u4", copy=False).tobytes())
                held += len(found)
                if held >= EMIT_IDS:
                    yield _encoded_batch(docs, ids)
                    docs, ids, held = [], [], 0
            if docs:
                yield _encoded_batch(docs, ids)


def _encoded_batch(docs: list, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _kept(blocks: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, dealt by ``block`` like a shuffle of this session, so that
    the codes stay where they are when the ids come back."""
    spark = blocks.sparkSession
    name = f"byte_bpe_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocks.write.format("parquet").bucketBy(parts, "block").option("path", scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, buckets: int | None = None,
                     block_pre_tokens: int = BLOCK_PRE_TOKENS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``ids`` (little-endian unsigned 32-bit), as
    ``tiktoken``'s ``encode_ordinary`` gives them.

    A bucket's distinct words stay in its task's memory, so ``buckets`` (the session's shuffle
    partitions, unless given) is to grow with the corpus' vocabulary."""
    path, pattern = path or vocabulary_path(RANKS), pattern or split_pattern()
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _kept(exploded(docs, buckets, pattern, block_pre_tokens))
    asked = blocks.select("block", F.inline("vocabulary")).repartitionById(buckets, F.col("bucket"))
    answers = (encoded_words(asked, path, pattern)
               .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("answers")))
    return (blocks.drop("vocabulary").join(answers, "block", "left")
            .select("doc_ids", "sizes", "codes", "buckets", "answers").mapInArrow(_reassembled, "doc_id long, ids binary"))


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and each id's start and length (-1: no such id)."""
    ranks = read_ranks(path)
    top = max(ranks.values(), default=-1) + 1
    table = [b""] * top
    known = np.zeros(top, bool)
    for token, i in ranks.items():
        table[i], known[i] = token, True
    lengths = np.fromiter(map(len, table), np.int64, top)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, np.where(known, lengths, -1)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (``doc_id, ids``) and ``decoded``, the bytes of its ids in order.

    The token-byte table is the build side of a map-side join: it has one row per rank of the file
    (50,256 in the default one), whatever the corpus.  An id that the table lacks fails the job."""
    path = path or vocabulary_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, starts, lengths = _token_bytes(path)
        for batch in batches:
            first, decoded, held = 0, [], 0
            for k, value in enumerate(batch.column("ids"), 1):
                ids = np.frombuffer(value.as_py() or b"", "<u4")
                found = []
                for at in range(0, len(ids), EMIT_IDS):
                    part = ids[at:at + EMIT_IDS]
                    if len(part) and (part.max() >= len(lengths) or lengths[part].min() < 0):
                        raise ValueError("an id has no token")
                    found.append(_gathered(text, starts[part], lengths[part]).tobytes())
                decoded.append(b"".join(found))
                held += len(decoded[-1])
                if held >= EMIT_IDS or k == batch.num_rows:
                    part = batch.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())],
                                                     names=[*part.schema.names, "decoded"])
                    first, decoded, held = k, [], 0

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    decoded = decode_documents(encode_documents(docs, path), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
