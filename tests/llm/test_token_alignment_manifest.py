"""Byte-level BPE, cross-tokenizer alignment and the Merkle manifest against brute force."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from edge_docs import edge_docs, edge_rows, no_docs, no_python, prose
from tokenizers import Tokenizer

import __spark_entry__ as E
from chatlore.llm import align, byte_bpe, manifest
from conftest import SF_SMALL

ODD = "abcXYZ'stré ñÜßµ²ªº¼ \t\n\r\x1c\x85\xa0\xad​ 　﻿12!?.,-–’“日本İΣ́😀🏽𝐀𝟙<|>՘꟎꟝࢏\U00011de0\x00 's 're"


def odd_texts(n: int, seed: int = 0) -> list[str]:
    r = random.Random(seed)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(n)]
    return texts + ["a <|endoftext|> b", "<s> x </s> <unk> <0x41>", " ", "  ", "\n", " \n x", "a  b   c    ", "don't we'll I'm 'S",
                    "x" * 3000, "ab" * 9000, " " * 500, "a▁b", "▁", "a ▁ b", "é ﬁ ﷺ"]


def reference_bpe():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_pre_tokens_are_those_of_tiktoken():
    """One id per byte shows every match's bytes; a pattern that drops a class shows where matches end."""
    split = byte_bpe.PreTokens(public_tokenizers.PATTERN)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):   # no character outside ``unsure`` is of a class of its own in ``tiktoken``
        e = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for block in range(0, 0x10000, 0x800):
            if 0xD800 <= block < 0xE000:
                continue
            text = "".join(c for c in map(chr, range(block, block + 0x800)) if not split.unsure(c))
            mine = b"".join(c.encode() for c in text if {r"\p{L}": split("1" + c) == ["1", c] and split("a" + c) == ["a" + c],
                                                         r"\p{N}": split("1" + c) == ["1" + c], r"\s": c.isspace() and not "\x1c" <= c <= "\x1f"}[kind])
            assert bytes(e.encode_ordinary(text)) == mine, (kind, hex(block))


@pytest.mark.parametrize("size", [byte_bpe.SEGMENT, 7])
def test_segments_keep_pre_tokens_whole(size):
    split = byte_bpe.pre_tokens(public_tokenizers.PATTERN)
    for text in [*odd_texts(500), prose(5, 300)]:
        parts = list(byte_bpe.segments(text, size))
        assert "".join(parts) == text
        assert [t for p in parts for t in split(p)] == split(text)


def test_byte_bpe_equals_tiktoken(spark, monkeypatch):
    texts = [r[1] for r in edge_rows()] + odd_texts(400) + [prose(7, 30_000)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, block long").repartition(3)
    whole = reference_bpe()
    expected = {i: np.array(whole.encode_ordinary(t or ""), "<u4").tobytes() for i, t in enumerate(texts)}
    for limits in ({}, {"buckets": 3, "block_pre_tokens": 50}):
        if limits:
            monkeypatch.setattr(byte_bpe, "EMIT_IDS", 10)
        got = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, **limits)).collect()
        assert {r.doc_id: bytes(r.ids) for r in got} == expected and len(got) == len(texts)
        assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in got)


def test_byte_bpe_edge_rows(spark):
    rows, whole = edge_rows(), reference_bpe()

    def line(doc, text):
        ids = whole.encode_ordinary(text or "")
        return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    got = byte_bpe.digest(edge_docs(spark)).collect()
    assert Counter(map(tuple, got)) == Counter(line(r[0], r[1]) for r in rows)
    assert byte_bpe.digest(no_docs(spark)).collect() == []
    with pytest.raises(Exception, match="no token"):
        byte_bpe.decode_documents(spark.createDataFrame([(1, np.array([50256], "<u4").tobytes())], "doc_id long, ids binary")).collect()


def test_byte_bpe_sends_each_word_once_a_block(spark):
    docs = spark.createDataFrame([(i, "the " * 500 + f"word{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    blocks = byte_bpe.exploded(docs, 4, public_tokenizers.PATTERN, block_pre_tokens=5_000)
    sent = Counter()
    for row in blocks.collect():
        found = [w for b in row.vocabulary for w in split_words(b.words)]
        assert len(found) == len(set(found))
        sent.update(found)
    assert sent[b" the"] == blocks.count() < 6


def split_words(value):
    lengths, text = byte_bpe._unpacked(bytes(value), 2)
    ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
    return [bytes(text[a:b]) for a, b in zip([0, *ends], ends)]


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    both = align.tokens(*map(public_tokenizers.path, (align.VOCABULARY_A, align.RANKS_A, align.VOCABULARY_B)))
    found, counts = [], Counter()
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [both.bytes_a[i] for i in ids_a], [both.bytes_b[i] for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((doc, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in p]).tolist() for p in (bytes_a, bytes_b))
        i = j = 0
        groups, links = [], []
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = bisect.bisect_right(ends_a, end), bisect.bisect_right(ends_b, end)
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            links += [(ids_a[x], ids_b[y]) for x in range(i, i2) for y in range(j, j2)
                      if max(ends_a[x] - len(bytes_a[x]), ends_b[y] - len(bytes_b[y])) < min(ends_a[x], ends_b[y])]
            i, j = i2, j2
        counts.update(set(links))
        found.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return Counter((doc, n_a, n_b, n_groups, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest)
                   for doc, n_a, n_b, n_groups, links, digest in found)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, monkeypatch, small):
    texts = odd_texts(300, 3) + [prose(7, 400), prose(8, 2500), None, ""]
    rows = [(r[0], r[1]) for r in edge_rows()] + [(100 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block long").repartition(3)
    limits = {"block_links": 100} if small else {}
    got = align.align_documents(docs, **limits).collect()
    assert Counter(map(tuple, got)) == brute_alignment(rows)
    if not small:
        assert align.align_documents(no_docs(spark)).collect() == []


def test_alignment_in_segments_is_the_same(monkeypatch):
    both = align.tokens(*map(public_tokenizers.path, (align.VOCABULARY_A, align.RANKS_A, align.VOCABULARY_B)))
    texts = [*odd_texts(200, 5), prose(9, 500)]
    whole = [align._document(t, both) for t in texts]
    monkeypatch.setattr(align, "SEGMENT", 5)
    for text, one in zip(texts, whole):
        for x, y in zip(one, align._document(text, both), strict=True):
            assert np.array_equal(x, y), text


def test_irregular_groups_on_random_ends():
    r = random.Random(4)
    for _ in range(2000):
        n = r.randrange(1, 60)
        p = r.choice([0.2, 0.5, 0.9, 1.0])
        a, b = (np.array([*[k for k in range(1, n) if r.random() < p], n]) for _ in range(2))
        found = align.irregular_groups(a, b).tolist()
        expected, i, j = [], 0, 0
        for end in sorted(set(a.tolist()) & set(b.tolist())):
            i2, j2 = int(np.searchsorted(a, end)) + 1, int(np.searchsorted(b, end)) + 1
            if (i2 - i, j2 - j) != (1, 1):
                expected.append([i, i2, j, j2])
            i, j = i2, j2
        assert found == expected


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc, source, lang, n_chars, text):
        return sha("".join(map(field, (doc, source, lang, n_chars, text))))

    def climb(nodes):
        """The top, and each node's steps (left, right)."""
        steps = [[] for _ in nodes]
        groups = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            for k, members in enumerate(groups):
                run = nodes[k // 16 * 16:k // 16 * 16 + 16]
                for m in members:
                    steps[m].append(("".join(run[:k % 16]), "".join(run[k % 16 + 1:])))
            groups = [sum(groups[k:k + 16], []) for k in range(0, len(groups), 16)]
            nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
        return nodes[0], steps

    by_source = defaultdict(list)
    for doc, text, lang, source, n_chars in rows:
        small = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = leaf(doc, source, lang, n_chars, text)
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        by_source[source].append((doc is not None, doc or 0, own, doc, leaf(doc, source, lang, n_chars, small) if tampered else own))
    out, tops, inner = [], [], []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(by_source[source], key=lambda m: m[:3])
        top, steps = climb([m[2] for m in members])
        tops.append(top)
        inner.append((members, steps))
    if not tops:
        return Counter()
    root, outer = climb(tops)
    for subroot, (members, steps), above in zip(tops, inner, outer, strict=True):
        for (_, _, own, doc, changed), way in zip(members, steps, strict=True):
            for left, right in (path := way + above):
                changed = sha(left + changed + right)
            out.append((doc, own, subroot, root, sha("".join(a + b for a, b in path)), changed, changed == root))
    return Counter(out)


MANIFEST_SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, grp string, idx long, place int, row int"


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 16, "c": 17, "d": 1, None: 5}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"é": 1}, {"b": 257, "B": 2}])
def test_manifest_equals_brute_force_and_sql(spark, sizes):
    r = random.Random(6)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i, r.choice([None, "", "small", f"Text {i}", "É ABC é" * 3]), r.choice([None, "en"]), source, r.choice([None, i])))
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "", 1, 1, 1) for x in rows], MANIFEST_SCHEMA).repartition(5)
    found = manifest.digest(docs)
    got = Counter(map(tuple, found.collect()))
    assert got == brute_manifest(rows)
    assert no_python(found)
    documents = docs.drop("grp", "idx", "place", "row").toPandas().astype({"doc_id": "Int64", "n_chars": "Int32"})  # noqa: F841
    sql = duckdb.sql(manifest.ORACLE)
    columns = [c for c in sql.columns]
    picked = [columns.index(c) for c in found.columns]
    assert Counter(tuple(x[k] for k in picked) for x in sql.fetchall()) == got


def test_manifest_edge_rows(spark):
    got = Counter(map(tuple, manifest.digest(edge_docs(spark)).collect()))
    assert got == brute_manifest([r[:5] for r in edge_rows()])
    assert manifest.digest(no_docs(spark)).collect() == []


def test_queries_are_registered():
    assert {"op11_align", "op12_manifest", "op13_byte_bpe"} <= set(E.queries())
    assert "op12_manifest" in E.oracle_sql()
    assert SF_SMALL
