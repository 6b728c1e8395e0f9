"""Language, quality, rules, personal data: edge rows, brute force, held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_docs import edge_docs, edge_rows, no_docs, no_python

import __spark_entry__ as E
from chatlore.llm import language_id, pii, quality_knn, quality_rules
from conftest import SF_MID


def test_language_profiles_rank_out_of_place():
    grams = np.array(sorted([97, 98, 99]), np.int64)
    p = language_id.Profiles(["p", "q"], grams, np.array([[0, 600], [1, 0], [600, 1]]))
    assert p.nearest("1234 !!") == ("und", 0.0, 1.0) and p.nearest(None)[0] == "und"
    assert p.nearest("aab")[0] == "p" and p.nearest("bbc")[0] == "q"


def test_ngrams_match_a_plain_count():
    text = "Der Hund, der HUND2x!"
    want = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"\1{w}\1"
        want.update(w)
        for n in (2, 3):
            want.update(padded[i:i + n] for i in range(len(padded) - n + 1))

    def unpack(c, out=""):
        return out if not c else unpack(c >> 21, chr(c & 0x1FFFFF) + out)

    codes, counts = language_id.ngrams(text)
    assert {unpack(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == want


def test_language_edges(spark):
    rows = language_id.predict_documents(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by[i].lang_pred for i in (4, 5, 6, 9)} == {"und"} and by[14].lang_pred == "fr"
    assert language_id.predict_documents(no_docs(spark)).count() == 0
    kept = language_id.accepted(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and {4, 5, 6, 9}.isdisjoint({r.doc_id for r in kept.collect()})


def test_language_held_out_accuracy(spark):
    got = E.queries()["op1_language_id"](spark, SF_MID)
    lang = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(lang, "doc_id").selectExpr("avg(cast(lang = lang_pred as int)) a", "count(*) n").first()
    assert held.n > 150 and held.a >= 0.98


def test_quality_edges_and_blocks(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_knn.score_documents(edge_docs(spark), labels).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    same = [r.score for r in rows if r.doc_id == 3]
    assert len(same) == 3 and max(same) - min(same) < 1e-5
    assert quality_knn.score_documents(no_docs(spark), labels).count() == 0
    none = quality_knn.score_documents(edge_docs(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_votes_match_plain_cosine():
    r = np.random.default_rng(3)
    counts = r.poisson(0.05, (60, quality_knn.TERMS)).astype(np.float32)
    y = r.integers(0, 2, 50).astype(float)
    model = quality_knn.Neighbours(np.ones(quality_knn.TERMS, np.float32), quality_knn.latent_directions(np.log1p(counts), 20),
                                   np.zeros((0, 1)), y)
    model = quality_knn.Neighbours(model.weight, model.directions, model.project(counts[:50]), y)
    got = model.score(counts[50:])
    for row, score in zip(model.project(counts[50:]), got, strict=True):
        cosine = [float(row @ v) for v in model.vectors]
        near = sorted(range(50), key=lambda i: -cosine[i])[:quality_knn.NEIGHBOURS]
        w = [max(cosine[i], 0) ** quality_knn.POWER for i in near]
        assert score == pytest.approx(sum(a * y[i] for a, i in zip(w, near, strict=True)) / sum(w), rel=1e-3, abs=1e-6)


def test_quality_held_out_accuracy(spark):
    got = E.queries()["op3_quality_knn"](spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    repeat = {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + 5)}
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
    return *base, base[0] < 10 or 100 * base[4] > 20 * base[0]


def test_rule_measurements_match_plain_python(spark):
    docs = edge_docs(spark)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality_rules.digest(docs).collect())
    assert got == Counter((r[0], *plain_rules(r[1])) for r in edge_rows())
    assert quality_rules.digest(no_docs(spark)).count() == 0
    assert no_python(quality_rules.digest(docs))


def test_policies_and_ablations_read_the_ledger(spark):
    entries = quality_rules.ledger(edge_docs(spark)).cache()
    rows = entries.collect()
    for policy in quality_rules.POLICIES:
        kept = [r.failures & (policy.mask | quality_rules.BASE.mask) == 0 for r in rows]
        assert [r.kept for r in quality_rules.verdicts(entries, policy).collect()] == kept
        for a in quality_rules.ablation(entries, policy).collect():
            bit = quality_rules.BITS[a.rule]
            masks = [r.failures & policy.mask for r in rows]
            assert a.n_failed == sum(m & bit != 0 for m in masks) and a.n_failed_alone == sum(m == bit for m in masks)
            assert a.n_kept_without == sum(m & ~bit == 0 for m in masks) and a.n_documents == len(rows)
    entries.unpersist()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            odd = sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
            return 14 <= len(d) <= 19 and odd % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15
    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(kind, m[0])]
    return ",".join(f"{[*BASE][k]}:{a}:{b}" for a, k, b in sorted(out))


def test_plain_finds_match_the_patterns():
    import random
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("aB.@-+ 1234567890()_é%") for _ in range(r.randrange(60)))
        assert pii.joined(pii.detect(text)) == plain_pii(text), text
    text = "x 4111 1111 1111 1111, 4111-1111-1111-1112 10.0.0.256 1.2.3.4.5.6.7.8 +1 (212) 555-0100 a@b a@b.c@d.e"
    assert pii.joined(pii.detect(text)) == plain_pii(text)


@pytest.mark.parametrize("text, want", [
    ("mail john [at] example (dot) com now", [("email", "john [at] example (dot) com")]),
    ("jane at corp dot co dot uk", [("email", "jane at corp dot co dot uk")]),
    ("ｂｏｂ＠ｓｉｔｅ．ｏｒｇ", [("email", "ｂｏｂ＠ｓｉｔｅ．ｏｒｇ")]),
    ("jоhn@site.org", [("email", "hn@site.org")]),                  # the plain part stays as it is
    ("call plus one five five five two one two three four five six", [("phone", "plus one five five five two one two three four five six")]),
    ("host １９２.１６８.0.1 up", [("ip", "１９２.１６８.0.1")]),
    ("card 4111​1111​1111​1111", [("card", "4111​1111​1111​1111")]),
    ("he sat at the table and drew a dot here", []),
    ("one two buckle my shoe", []),
    ("", []),
])
def test_disguises_map_back_to_the_source(text, want):
    plain, spans = pii.find(text)
    assert set(plain) <= set(spans)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == want


@pytest.mark.parametrize("text, want", [
    ("mail john [at] example dot com now", [("email", "john [at] example dot com")]),
    ("mail john@example dot com now", [("email", "john@example dot com")]),
    ("mail john at example (dot) com now", [("email", "john at example (dot) com")]),
    ("mail john at example.com now", [("email", "john at example.com")]),
    ("ping 192 dot 168 dot 0 dot 1 now", [("ip", "192 dot 168 dot 0 dot 1")]),
    ("ping 192.168 dot zero.1 now", [("ip", "192.168 dot zero.1")]),
    ("call +1 five five five 555 1212 now", [("phone", "+1 five five five 555 1212")]),
    ("card 4111 1111 1111 one one one one", [("card", "4111 1111 1111 one one one one")]),
    ("he came at 10.30 and left at noon.Then two 300 km", []),
    ("chapter 1 dot 2 dot 3, 999 dot 1 dot 1 dot 1, one 2 three", []),
])
def test_mixed_disguises_map_back_to_the_source(text, want):
    plain, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == want


def test_mixed_disguises_are_linear_on_hostile_texts():
    import time
    for text in ("a@b dot " * 3000, "1 dot " * 5000, "one." * 5000, " at a.b" * 4000, "1 one " * 4000, "one-" * 5000 + " dot ", "@" * 20000 + " at "):
        t = time.process_time()
        pii.find(text)
        assert time.process_time() - t < 2


def test_pii_is_linear_on_hostile_texts():
    import time
    for text in ("a" * 20000, "1" * 20000, "1.1." * 5000, "+1" + "(" * 20000, " " * 20000, "(at" * 7000, "a at b dot " * 2000):
        t = time.process_time()
        pii.find(text)
        assert time.process_time() - t < 2


def test_pii_edges(spark):
    rows = pii.digest(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows()) and pii.digest(no_docs(spark)).count() == 0
    full = pii.find_pii(spark.createDataFrame([(1, "to a@b.cd, ok"), (2, None)], "doc_id long, text string")).collect()
    assert full[0].redacted == "to [EMAIL], ok" and full[1].redacted is None and full[0].n_email == 1
