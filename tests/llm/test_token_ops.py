"""Tokens, cutting-stock and best-fit packing: round trips, and the whole pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
from edge_docs import edge_docs, edge_rows, no_docs, prose
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from chatlore.llm import best_fit, cutting_stock, decontaminate, language_id, line_dedup, ngram_join
from chatlore.llm.tokens import Tokens, vocabulary_path
from conftest import SF_SMALL


def whole():
    return Tokenizer.from_file(vocabulary_path())


def test_tokens_equal_the_tokenizer(spark):
    t, mine = whole(), Tokens(vocabulary_path())
    texts = [r[1] for r in edge_rows() if r[1]]
    texts += [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    r = random.Random(0)
    alphabet = "abcXYZ'stréñÜßµ²ªº¼ \t\n\r\x1c\x85\xa0\xad12!?.,-–’“日本İΣσς́‍😀<|>"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|startoftext|>", "don't we'll I'm 'S", "x" * 3000, "  lead", "tail  "]
    for x in texts:
        assert mine.of(x).tolist() == t.encode(x, add_special_tokens=False).ids, x[:80]
    assert mine.of(None).tolist() == mine.of("").tolist() == []


def test_patterns_cover_demand_exactly():
    r = random.Random(2)
    for capacity in (16, 64, 256):
        sizes = sorted(r.sample(range(1, capacity + 1), r.randrange(1, min(40, capacity))))
        demand = [r.randrange(1, 500) for _ in sizes]
        plan = cutting_stock.plan(sizes, demand, capacity)
        got = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(s * n for s, n in pattern.items()) <= capacity
            for s, n in pattern.items():
                got[s] += n * times
        assert got == Counter(dict(zip(sizes, demand, strict=True)))
        least = -(-sum(s * n for s, n in zip(sizes, demand, strict=True)) // capacity)
        big = sum(n for s, n in zip(sizes, demand, strict=True) if 2 * s > capacity)
        assert sum(t for _, t in plan) <= 1.25 * max(least, big) + len(sizes)
    assert cutting_stock.plan([], [], 16) == []


def check_pieces(rows, docs):
    t = whole()
    ids = [np.array([*(t.encode(x, add_special_tokens=False).ids if x else []), 1], "<u4") for _, x in docs]
    want = Counter((d, len(i)) for (d, _), i in zip(docs, ids, strict=True))
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    by = {(d, len(i)): i for (d, _), i in zip(docs, ids, strict=True)}
    for r in rows:
        assert zlib.crc32(by[r.doc_id, r.doc_tokens][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.length > 0
    total = Counter()
    for r in rows:
        total[r.doc_id, r.doc_tokens] += r.length
    assert all(total[k] == k[1] * n for k, n in want.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= cutting_stock.CAPACITY
    return sum(r.length for r in rows) / (len(sequences) * cutting_stock.CAPACITY)


def test_packing_edges(spark):
    rows = cutting_stock.pack_documents(edge_docs(spark)).collect()
    check_pieces(rows, [(r[0], r[1]) for r in edge_rows()])
    assert cutting_stock.pack_documents(no_docs(spark)).count() == 0
    kept = cutting_stock.pack_documents(edge_docs(spark), keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept)


def test_packing_query_is_tight_and_lossless(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert check_pieces(E.queries()["op6_packing"](spark, SF_SMALL).collect(), docs) > 0.97


def test_ranks_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(cutting_stock, "ROWS_PER_BUCKET", 10)
    rows = [(i, prose(i % 7, 40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert check_pieces(cutting_stock.pack_documents(docs).collect(), rows) > 0.9


def test_best_fit_finds_the_tightest_sequence():
    r = random.Random(4)
    for _ in range(30):
        lengths = [r.randrange(1, 65) for _ in range(r.randrange(0, 80))]
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f[0] >= lengths[i]]
            if fits:
                least = min(f[0] for f in fits)
                f = [f for f in free if f[0] == least][-1]
                f[0] -= lengths[i]
            else:
                free.append([64 - lengths[i]])
        got = best_fit.best_fit(lengths, 64)
        assert sorted(i for s in got for i in s) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in s) for s in got) == sorted(64 - f[0] for f in free)


def unpack(rows, end_id):
    """Texts' ids put together again from the packed rows."""
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        positions = np.frombuffer(r.positions, "<u4")
        assert len(ids) == best_fit.CAPACITY and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens:].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b]))
    return parts


def test_best_fit_round_trip(spark):
    t = whole()
    rows = best_fit.pack_matrices(edge_docs(spark), block_tokens=5000).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    parts = unpack(rows, best_fit.END_ID)
    docs = {}
    for i, x, *_ in edge_rows():
        docs.setdefault(i, []).append([*(t.encode(x, add_special_tokens=False).ids if x else []), best_fit.END_ID])
    assert set(parts) == set(docs)
    for i, want in docs.items():
        got = Counter(tuple(p.tolist()) for _, p in parts[i])
        cut = Counter(tuple(w[k:k + best_fit.CAPACITY]) for w in want for k in range(0, len(w), best_fit.CAPACITY))
        assert got == cut
        assert sorted(s for s, _ in parts[i]) == sorted(k for w in want for k in range(0, len(w), best_fit.CAPACITY))
    assert best_fit.pack_matrices(no_docs(spark)).count() == 0


def test_best_fit_query_round_trip(spark, tmp_path):
    t = whole()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    best_fit.write_matrices(best_fit.pack_matrices(docs), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    parts = unpack(rows, best_fit.END_ID)
    for r in docs.collect():
        ids = [i for _, p in sorted(parts[r.doc_id], key=lambda x: x[0]) for i in p.tolist()]
        assert ids == [*t.encode(r.text, add_special_tokens=False).ids, best_fit.END_ID]
    assert sum(r.n_tokens for r in rows) > 0.97 * best_fit.CAPACITY * len(rows)
    assert len(rows) == E.queries()["op10_best_fit"](spark, SF_SMALL).count()


def test_pipeline_applies_every_stage(spark):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect()))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    steps = [language_id.accepted, line_dedup.cleaned, ngram_join.one_of_each,
             lambda d: decontaminate.decontaminated(d, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))]
    columns = docs.columns
    for step in steps:
        docs = spark.createDataFrame(step(docs).collect(), docs.schema)
        assert docs.columns == columns
    rest = [(r.doc_id, r.text) for r in docs.collect()]
    plain = ngram_join.brute_force(rest)
    assert 0 < len(rest) < 200 and all(c == i for i, (_, c) in plain.items())
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    check_pieces(rows, rest)
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]


def test_pipeline_edges(spark, tmp_path):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    for name, frame in (("edge", edge_docs(spark)), ("none", no_docs(spark))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "edge")
