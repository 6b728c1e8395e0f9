"""N-gram join, line dedup, substring dedup, decontamination: brute force and edge rows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from edge_docs import edge_docs, edge_rows, no_docs, no_python, prose

import __spark_entry__ as E
import oracle_harness as OH
from chatlore.llm import components, decontaminate, line_dedup, ngram_join, substring_dedup
from chatlore.llm.queries import ORACLE
from conftest import SF_MID, SF_SMALL


def copies_and_variants(seed: int = 0) -> list[tuple[int, str]]:
    """Families of texts with growing edits, so that links and near misses both occur."""
    r = random.Random(seed)
    out = []
    for family in range(6):
        base = prose(100 * seed + family, r.randrange(6, 200)).split(" ")
        for k in range(25):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            out.append((1000 + len(out), " ".join(w[: len(w) - r.randrange(3)])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("few, cell, leaf", [(32, 400_000, 32), (2, 600, 3), (1000, 300, 2)])
def test_ngram_join_matches_all_pairs(spark, monkeypatch, few, cell, leaf):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "CELL_TOKENS", cell)
    rows = copies_and_variants() + [(i, t) for i, t, *_ in edge_rows() if i is not None and i < 13]
    rows = [*{i: (i, t) for i, t in rows}.values()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == ngram_join.brute_force(rows)


def test_ngram_join_query_matches_all_pairs(spark):
    t = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in E.queries()["op2_ngram_join"](spark, SF_MID).collect()}
    assert got == ngram_join.brute_force([(r.doc_id, r.text) for r in t])


def test_signature_tree_prunes_nothing_that_links():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - k], r.integers(0, 2**63, k).astype(np.uint64)))) for k in range(0, 120, 2)]
    for i, a in enumerate(sets):
        for b in sets[i:]:
            both = len(np.intersect1d(a, b))
            assert ngram_join.may_link(len(a), ngram_join.bitmap(a, 256), len(b), ngram_join.bitmap(b, 1024)) or both < ngram_join.needed(len(a), len(b))
            x, y = ngram_join.Node([0], [a], []), ngram_join.Node([0], [b], [])
            assert x.overlap_bound(y) >= both
    for a in range(1, 60):
        for b in range(a, 80):
            assert all((100 * i >= 80 * (a + b - i)) == (i >= ngram_join.needed(a, b)) for i in range(a + 1))


def test_ngram_join_prefix_tokens_are_whole_hashes(spark):
    texts = [" ".join(f"w{i * k % 97}" for i in range(60)) for k in range(1, 9)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, ref long, text string")
    for r in ngram_join.profiles(rows).collect():
        tokens = set(ngram_join.shingles(texts[r.doc_id].encode()).view(np.int64).tolist())
        assert len(set(r.prefix)) == len(r.prefix) == r.n - (-(-80 * r.n // 100)) + 1 and set(r.prefix) <= tokens


def test_ngram_join_moves_and_keeps_some_bytes_a_token(spark, monkeypatch):
    """What is written for the search of pairs is less than the prefix tokens as they are."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(600)]
    texts += [t + " end" for t in texts[:50]]
    sizes, real = {}, ngram_join.written

    def sized(df, name):
        out = real(df, name)
        sizes[name] = sizes.get(name, 0) + sum(os.path.getsize(f.replace("file://", "").replace("file:", "")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "written", sized)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: i if i < 600 else i - 600 for i in range(650)}
    tokens = sum(len(t.split()) // 5 for t in texts)
    assert sizes["profiles"] < 8 * tokens


@pytest.mark.parametrize("few, run, bucket", [(32, 300, 100), (3, 200, 50), (2, 1_000_000, 10)])
def test_ngram_join_over_many_runs_and_buckets(spark, monkeypatch, few, run, bucket):
    for name, value in (("FEW", few), ("RUN_TOKENS", run), ("BUCKET_TOKENS", bucket)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = copies_and_variants(7)
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == ngram_join.brute_force(rows)


def test_ngram_join_packs_without_loss():
    r = np.random.default_rng(1)
    for values in (r.integers(0, 2**64, 999, np.uint64), np.arange(7, dtype=np.uint32), np.empty(0, np.uint16)):
        assert (ngram_join.unpacked(ngram_join.packed(values), values.dtype) == values).all()
    for tokens in (0, 10, 10**9, 10**13):
        bits, bucket_bits = ngram_join.token_bits(tokens)
        assert bucket_bits <= bits <= 64 and (tokens * 0.2) / 2.0**bits <= 2.0**-ngram_join.SPARE_BITS


def test_one_of_each_keeps_every_column_and_always_the_same_row(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "de", 5, 7, {"a": 1}), (1, text, "en", 6, 8, {"a": 2}), (2, text, "fr", 7, 9, None)]
    schema = "doc_id long, text string, lang string, __ref int, ref int, row map<string,int>"
    kept = {tuple(map(str, *ngram_join.one_of_each(spark.createDataFrame(some, schema).repartition(n)).collect()))
            for some in (rows, rows[::-1]) for n in (1, 5)}
    assert len(kept) == 1 and next(iter(kept))[0] == "1"
    assert ngram_join.one_of_each(spark.createDataFrame(rows, schema)).columns == ["doc_id", "text", "lang", "__ref", "ref", "row"]


def test_ngram_join_edges(spark):
    rows = ngram_join.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    assert [by[i].component_id for i in (0, 1, 2, 4, 5, 6, 7, 8)] == [0, 0, 0, 4, 5, 6, 7, 7]
    assert [by[i].n_shingles for i in (4, 5, 6, 7)] == [0, 0, 0, 1]
    assert ngram_join.near_duplicates(no_docs(spark)).count() == 0
    stay = ngram_join.one_of_each(edge_docs(spark))
    ids = Counter(r.doc_id for r in stay.collect())
    assert stay.columns == edge_docs(spark).columns and ids[3] == 1 and ids[1] == ids[2] == ids[8] == 0 and ids[4] == 1


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    links = ngram_join.Links(600)
    for a, b in edges:
        links.add(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    least = {}
    for x in sorted(nodes):
        least.setdefault(links.root(x), x)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: least[links.root(x)] for x in nodes} and len(got) == len(nodes)


def test_line_dedup_matches_sql(spark):
    con = OH.duck(SF_MID)
    r = OH.compare(spark, "op8", E.queries()["op8_line_dedup"], ORACLE["op8_line_dedup"], SF_MID, con)
    assert r["cols_match"] and r["hash_match"], r
    assert spark.sql("select 1").count() and E.queries()["op8_line_dedup"](spark, SF_MID).agg({"n_removed": "sum"}).first()[0] > 0


def plain_lines(rows, sites):
    on = {}
    for _, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip(line_dedup.AROUND) and site is not None:
                on.setdefault(line.strip(line_dedup.AROUND), set()).add(site)
    bad = {k for k, v in on.items() if len(v) >= sites}
    out = Counter()
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        left = [x for x in lines if x.strip(line_dedup.AROUND) not in bad]
        out[(i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())] += 1
    return out


def test_line_dedup_knows_lines_by_their_text_alone(spark):
    """Line ends and white space around don't tell lines apart; hashes go by broadcast or not."""
    rows = [(k, f"own {k}\r\n{' ' * (k % 3)}imprint and terms{chr(13) if k % 2 else ''}\n\t\r\nlast {k}", f"s{k}") for k in range(16)]
    rows += [(50, "imprint and terms", "s1"), (51, "imprint and  terms\n imprint", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_lines(rows, line_dedup.SITES)
    assert sum(r[2] for r in want) == 17
    for size in (line_dedup.BROADCAST_BYTES, 0):
        line_dedup.BROADCAST_BYTES, before = size, line_dedup.BROADCAST_BYTES
        try:
            assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.digest(docs).collect()) == want
        finally:
            line_dedup.BROADCAST_BYTES = before


def test_line_dedup_near_the_threshold(spark):
    rows = [(k, f"own line {k} of this page\nfooter {k % 3}\n\n  shared by all ", f"site{k % (9 + 3 * (k % 3))}") for k in range(120)]
    rows += [(200, None, "site1"), (201, "", None), (202, "shared by all", "site2"), (203, "footer 1\nlong enough to stay here", None)]
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.digest(docs)
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in out.collect())
    assert got == plain_lines(rows, line_dedup.SITES)
    assert no_python(out) and line_dedup.digest(no_docs(spark)).count() == 0
    clean = line_dedup.cleaned(edge_docs(spark))
    assert clean.schema.names == edge_docs(spark).columns and clean.count() == len(edge_rows())


def test_lines_go_from_pages_that_are_mostly_boilerplate(spark):
    footer = "all rights reserved, terms of use, contact, imprint, privacy"
    article = "\n".join(f"sentence {k} of an article that many sites print" for k in range(4))
    rows = [(k, f"own {k}\n{footer}\n{footer}", f"s{k}") for k in range(12)] + [(100 + k, article, f"s{k}") for k in range(15)]
    rows += [(300, f"{article}\n{footer}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs).collect()}
    assert got == {k: f"own {k}" for k in range(12)} | {100 + k: article for k in range(15)} | {300: ""}
    assert no_python(line_dedup.cleaned(docs))


def test_substring_dedup_matches_all_windows(spark):
    rows = copies_and_variants(2)
    r = random.Random(3)
    passage = prose(77, 34).split(" "), prose(78, 35).split(" "), prose(79, 80).split(" ")
    for k in range(60):
        w = prose(500 + k, r.randrange(0, 120)).split(" ")
        at = r.randrange(len(w))
        rows.append((5000 + k, "  ".join(w[:at] + passage[k % 3] + w[at:])))
    rows += [(6000, "ha " * 100), (6001, "ha ha ho " * 30), (6002, ("a b " * 40) + "c " + "a b " * 40), (6003, "z " * 35), (6004, "z " * 36)]
    rows += [(i, t) for i, t, *_ in edge_rows()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in
                  substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, substring_dedup.brute_force([t for _, t in rows]), strict=True))
    assert got == want
    assert substring_dedup.digest(no_docs(spark)).count() == 0
    assert substring_dedup.digest(edge_docs(spark)).count() == len(edge_rows())


def test_substring_dedup_query_matches_all_windows(spark):
    t = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in E.queries()["op9_substring_dedup"](spark, SF_SMALL).collect()}
    want = substring_dedup.brute_force([r.text for r in t])
    assert got == {r.doc_id: x for r, x in zip(t, want, strict=True)}


def test_equal_passages_get_equal_symbols():
    r = np.random.default_rng(1)
    inner = r.integers(1, 50, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = []
    for n in (0, 3, 11, 40):
        left, right = (r.integers(1, 50, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        names, first = substring_dedup.symbols(np.concatenate((left, inner, right)))
        edge = substring_dedup.MARGIN + 6           # runs of these few words are longer than in prose
        seen.append({(int(a), int(p) - n) for a, p in zip(names, first, strict=True) if edge <= p - n < 60 - edge - 8})
    assert seen[0] and all(s == seen[0] for s in seen)


ITEMS = ["On Monday the baker Tom Hill buys 5 kg of fresh river apples for 12 dollars at the old market, and then Tom Hill sells 5 kg of "
         "them again. How much does Tom Hill keep?", "what is the light of the winter garden", "a b", None, ""]


def test_decontamination(spark):
    copy = ITEMS[0]
    new = copy.replace("Tom Hill", "Ann").replace("5", "17").replace("12", "68").replace("kg", "pounds").replace("dollars", "euros")
    mixed = copy.replace("Tom Hill buys", "Ann buys").replace("sells 5", "sells 7")     # one name, one number stands for two
    texts = [f"intro words here. {copy} more words", f"{prose(5, 40)}. {new} {prose(6, 30)}", f"x. {mixed}", ITEMS[1].upper(), prose(8, 400),
             None, "", "a b", copy[:40], f"some. {copy} {copy}"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(ITEMS)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items).collect()}
    assert set(found) == {(0, 0), (1, 0), (3, 1), (9, 0)}
    assert found[0, 0].same_slots and not found[1, 0].same_slots and found[1, 0].n_slots > 3
    left = decontaminate.decontaminated(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 7, 8] and left.columns == docs.columns
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.matches(no_docs(spark), items).count() == 0
    assert decontaminate.decontaminated(edge_docs(spark), items).columns == edge_docs(spark).columns


def found_items(spark, texts, items):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}


def test_decontamination_of_slot_heavy_and_short_items(spark):
    items = ["What is 3 + 4 + 5 + 6 + 7?", "Convert 5 km 3 m 20 cm to mm", "Add 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13 and 14 to 99",
             "solve world hunger", "A shop has 3 m 20 cm 5 mm of 2 kg rope for the sailors who left the harbour"]
    texts = [f"some words. {i} more words" for i in items] + ["What is 1 + 4 + 5 + 6 + 7?", "Convert 6 km 3 m 20 cm to mm", "solve 5 world hunger",
             "A shop has 4 m 30 cm 6 mm of 7 kg rope for the sailors who left the harbour"]
    assert set(found_items(spark, texts, items)) == {(k, k) for k in range(5)} | {(8, 4)}


def test_decontamination_whatever_stands_before_a_copy(spark):
    items = ["What is the capital of France?", "Tom has 5 apples. Tom eats 2. Maria takes 1. How many apples does Tom have?"]
    texts = ["Q: What is the capital of France?", "Question: What is the capital of France?", 'he asked "What is the capital of France"',
             "well, What is the capital of France", "so what is the capital of france", "WHAT IS THE CAPITAL OF FRANCE?",
             "Q: Ann has 7 apples. Ann eats 3. Bob takes 4. How many apples does Ann have?", "What was the capital of France?",
             "Q: " + items[1].lower()]
    assert set(found_items(spark, texts, items)) == {(k, 0) for k in range(6)} | {(6, 1), (8, 1)}


def test_decontamination_with_some_slots_changed(spark):
    items = ["at noon the carpenter Tom Hill carries long oak boards over the bridge and then the carpenter Tom Hill saws them by the "
             "river while the rain falls on the roof of the old mill where nobody ever sees how the carpenter Tom Hill works",
             "a child takes 2 apples to the school every morning for 2 days and eats them there, how many apples is that",
             "a child takes 5 apples and then takes 7 pears to the school every morning, how many is that"]
    texts = [items[0].replace("Tom Hill saws", "Ann saws"), items[1].replace("2 apples", "3 apples").replace("2 days", "5 days"),
             items[2].replace("5", "6").replace("7", "6"), items[1].replace("2 days", "4 days")]
    found = found_items(spark, texts, items)
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 1)} and not any(r.same_slots for r in found.values())


def test_decontamination_slots_are_consistent(spark):
    items = ["What is 2 + 2?", "What is 17 + 25?", "How many km in 5 miles?",
             "Tom has 5 apples. Tom eats 2. Maria takes 1. How many apples does Tom have?"]
    texts = ["what is 100 200 exactly", "so what is 3 + 9 then", "so what is 4 + 4 then", "What is 17 + 25?", "how many kg in 9 dollars",
             "how many feet in 9 miles", "how many miles in 9 miles", "Maria has 7 apples. Maria eats 3. Ana takes 4. How many apples does Jose have?",
             "Maria has 7 apples. Maria eats 3. Ana takes 4. How many apples does Maria have?", "what is 2 + 2"]
    found = found_items(spark, texts, items)
    assert set(found) == {(1, 1), (2, 0), (2, 1), (3, 1), (5, 2), (8, 3), (9, 0)}
    assert {k for k, r in found.items() if r.same_slots} == {(3, 1), (9, 0)}


def test_decontamination_equals_a_brute_force_aligner(spark):
    """Re-parameterised, inconsistent and twin questions, found by trying every place of a document."""
    r = random.Random(7)
    names, numbers, dims = ["Tom", "Ana", "Lee", "Kim"], ["3", "5", "8"], [["kg", "pounds", "grams"], ["km", "miles"]]

    def question(goods, units, slots=None):
        a, b, c, n, m, u, v = slots or (r.choice(names), r.choice(names), r.choice(names), r.choice(numbers), r.choice(numbers),
                                        r.choice(units), r.choice(units))
        return f"{a} buys {n} {u} of {goods} and gives {m} {v} to {b} for {c}"

    kinds = {**{x: "name" for x in names}, **{x: "number" for x in numbers}, **{x: k for k, some in enumerate(dims) for x in some}}
    goods = ["rope", "wire", "cloth"]
    items = [question(g, dims[k % 2]) for k, g in enumerate(goods) for _ in range(6)]
    items = [*dict.fromkeys(items)]
    texts = [f"{prose(k, 9)}, {r.choice(items) if k % 4 == 0 else question(goods[k % 3], dims[r.randrange(2)])} {prose(k + 99, 9)}" for k in range(90)]

    def meets(item, text):
        item, text = item.split(), text.split()
        for at in range(len(text) - len(item) + 1):
            pairs = [*zip(item, text[at:at + len(item)], strict=True)]
            if any(kinds.get(x) != kinds.get(y) or (x not in kinds and x != y) for x, y in pairs):
                continue
            maps = {(x, y) for x, y in pairs if x in kinds}
            units = {(x, y) for x, y in maps if isinstance(kinds[x], int)}
            if len(maps) == len({x for x, _ in maps}) and len(units) == len({y for _, y in units}):
                return "copy" if item == text[at:at + len(item)] else "new"
        return None

    want = set()
    for d, text in enumerate(texts):
        some = {i: meets(item, text) for i, item in enumerate(items)}
        copies = {(d, i) for i, how in some.items() if how == "copy"}
        want |= copies or {(d, i) for i, how in some.items() if how}
    got = found_items(spark, texts, items)
    assert set(got) == want and len(want) > 30 and len({d for d, _ in want}) < 80


def test_decontamination_keeps_columns_with_its_own_names_and_int_ids(spark):
    docs = spark.createDataFrame([(1, f"so {ITEMS[1]} then", 7, "x"), (2, "other words", 8, "y")], "doc_id int, text string, ref long, ITEM string")
    left = decontaminate.decontaminated(docs, spark.createDataFrame([(0, ITEMS[1])], "item_id long, text string"))
    assert left.columns == docs.columns and [tuple(x) for x in left.collect()] == [(2, "other words", 8, "y")]


def test_decontamination_without_the_filter(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    filtered = sorted(decontaminate.matches(docs, items).collect())
    monkeypatch.setattr(decontaminate, "FILTER_WINDOWS", -1)
    assert sorted(decontaminate.matches(docs, items).collect()) == filtered


def test_decontamination_finds_whole_items(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in E.queries()["op7_decontaminate"](spark, SF_MID).collect()}
    assert len(want) > 10 and got == want
