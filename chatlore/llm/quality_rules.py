"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and one long whose bit
``k`` says that rule ``k`` failed.  A policy is a named, versioned mask over these bits: applying
one, or comparing many, reads the ledger and never the texts.  Ablations (what each rule of a
policy alone removes) are bitwise aggregates of the ledger.

Repeated windows are found within a row: window hashes and places are sorted, equal neighbours are
repeats, and the words they cover are added up from the gaps between their places.  That takes
n log n steps on a text of any length, and no exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import id_and_text

# The word, symbol and window definitions of the measurements.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
LETTERS = r"\p{L}"
SENTENCE_ENDS = ".!?"


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements."""

    name: str
    fails: str


#: In the order of their bits, which never changes; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("no_letters", "n_letter_words * 2 < n_words"),
    Rule("shouting", "n_upper_words * 2 > n_words"),
)
BITS = {r.name: 1 << k for k, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what removes a document: any of the named rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("v1", (*BASE.rules, "many_words", "symbols", "repeated_lines")),
    Policy("v2", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "no_letters", "shouting")),
)
CURRENT = POLICIES[-1]


def _n_of(characters: str) -> Column:
    """Characters of a set in the text: what its removal, one by one, takes away."""
    rest = F.col("text")
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.char_length("text") - F.char_length(rest)


def _repeat_words() -> tuple[Column, Column, Column, Column]:
    """Steps to the words in windows that occur twice or more: window hashes, hashes with places in
    order, places of the repeats, words they cover."""
    windows = F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW),
                          lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    placed = F.array_sort(F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    repeats = F.array_sort(F.transform(
        F.filter(F.col("placed"), lambda x, i: (x["h"] == F.coalesce(F.get("placed", i - 1)["h"], F.bitwise_not(x["h"])))
                 | (x["h"] == F.coalesce(F.get("placed", i + 1)["h"], F.bitwise_not(x["h"])))), lambda x: x["at"]))
    covered = F.aggregate(F.transform(F.col("repeats"), lambda at, i: F.least(F.lit(WINDOW), F.coalesce(
        F.get("repeats", i + 1) - at, F.lit(WINDOW)))), F.lit(0).cast("int"), lambda a, x: a + x)
    return windows, placed, repeats, covered


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of its whole text (null text: as an empty one)."""
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.select("doc_id", words.alias("words"), lines.alias("lines"), _n_of(SYMBOLS).alias("n_symbols"),
                       (F.char_length("text") - _n_of(SPACES)).alias("word_chars"))
    rows = rows.select("doc_id", "word_chars", "n_symbols", F.size("words").alias("n_words"), F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                       F.size(F.filter("words", lambda w: F.rlike(w, F.lit(LETTERS)))).alias("n_letter_words"),
                       F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) > 3))).alias("n_upper_words"),
                       F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows, placed, repeats, covered = _repeat_words()
    rows = rows.withColumn("windows", F.when(F.col("n_words") > WINDOW, windows))
    # sorted only where a window repeats at all
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    rows = rows.withColumn("repeats", repeats)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in counts),
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                       *(F.col(c).cast("long").alias(c) for c in ("n_lines", "n_letter_words", "n_upper_words")))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failures``: bit ``k`` is set where rule ``k`` failed.

    Null, empty and blank texts have no words, so ``few_words`` fails.  Repeated rows have a row each; a
    null ``doc_id`` stays null; an empty table gives an empty ledger.
    """
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.fails), BITS[rule.name]).otherwise(0)
    return measured(docs).withColumn("failures", bits)


def fails(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def verdicts(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return entries.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE) & ~fails(policy))


def ablation(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that the policy without it
    would keep.  One pass over the ledger, pre-aggregated by distinct failure masks."""
    masks = (entries.select(F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")).alias("mask"))
             .groupBy("mask").agg(F.count(F.lit(1)).alias("n")))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules]))
    per = masks.select("mask", "n", rules.alias("r")).select("n", "mask", "r.*")
    total = F.sum("n")
    return per.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        total.alias("n_documents")).withColumn("version", F.lit(policy.version))


def digest(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return verdicts(ledger(docs), policy)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] || ' ' || words[i + 5] AS win
      FROM (SELECT doc_id, words, unnest(range(len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_letter_words,
             CAST(len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 3)) AS BIGINT) AS n_upper_words
      FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 64 ELSE 0 END + CASE WHEN n_letter_words * 2 < n_words THEN 128 ELSE 0 END
             + CASE WHEN n_upper_words * 2 > n_words THEN 256 ELSE 0 END AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letter_words, n_upper_words, failures,
       (failures & 3) <> 0 AS base_failed, (failures & 3) = 0 AND (failures & 507) = 0 AS kept
FROM f
"""
