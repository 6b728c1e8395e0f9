"""Removal of cross-site boilerplate lines by their spread over sites, in DataFrame functions only.

A line that stands on many distinct sites is page furniture.  Every line (by hash) gets HyperLogLog
sketches of its sites and a count: they are built where the lines are, merged by aggregation, and
estimated.  Lines whose estimate is near the threshold are counted exactly; the others are decided by
it.  The hashes of the lines to remove go to the texts by broadcast while their counted size is small.

``digest`` (``op8_line_dedup``) removes such lines from every document, however much of it they are.
``cleaned`` (the pipeline's stage) does too, but in a text that stands on several sites as a whole, a line
stays that owes its spread to such copies: these are left to the near-duplicate stage, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import written

SITES = 12                   # distinct sites from which a line is boilerplate
LOG_K = 12                   # of the sketches: a standard error of 1.04 / sqrt(2 ** LOG_K), 1.6 %
NEAR = 0.1                   # relative distance from the threshold within which lines are counted
KEY_BYTES = 64               # of a broadcast hash, at most
BROADCAST_BYTES = 64 << 20   # of hashes; more are joined by shuffling
# Fixed value: the white space around a line that doesn't tell lines apart (``\r`` is there for CRLF).
AROUND = " \t\r\x0b\x0c"


def _rows(docs: DataFrame, site: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col(site).cast("string").alias("site"))


def _bare(line: Column | str) -> Column:
    return F.trim(F.col(line) if isinstance(line, str) else line, F.lit(AROUND))


def _key(line: Column) -> Column:
    """A line's hash; lines that differ in the white space around them are one."""
    return F.xxhash64(_bare(line))


def _sent(keys: DataFrame) -> DataFrame:
    """Hashes to join with all lines (a written table): broadcast if their counted size allows it, so that a
    line that a third of all documents hold moves nothing."""
    return F.broadcast(keys) if keys.count() * KEY_BYTES <= BROADCAST_BYTES else keys


def boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """``key``: hashes of the lines found on ``sites`` distinct sites or more (null sites count as none), as
    a written table."""
    lines = (_rows(docs, site).where("site is not null").select("site", F.explode(F.split("text", "\n")).alias("line"))
             .where(_bare("line") != "").select("site", _key(F.col("line")).alias("key")))
    # a line's sites are dealt over 64 parts, so that a frequent line is not one group
    parts = (lines.groupBy("key", F.pmod(F.xxhash64("site"), F.lit(64)).alias("part"))
             .agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch")))
    spread = (parts.groupBy("key").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch")).where(F.col("n") >= sites)
              .select("key", F.hll_sketch_estimate("sketch").alias("about")))
    near = F.abs(F.col("about") - sites) <= NEAR * sites + 1
    spread = written(spread.where(near | (F.col("about") >= sites)), "line-spread")
    exact = (lines.join(_sent(spread.where(near).select("key")), "key", "left_semi").distinct()
             .groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites))
    return written(spread.where(~near).select("key").union(exact.select("key")), "line-keys")


def copied_lines(docs: DataFrame, keys: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """``key, whole``: lines of texts (by hash) that stand on several sites as a whole, where the line is on
    fewer than ``sites`` sites when each distinct text counts for one of its sites only (the one of least
    hash, so that texts of the same sites don't all fall on one)."""
    lines = (_rows(docs, site).where("site is not null")
             .select("site", F.xxhash64("text").alias("whole"), F.explode(F.split("text", "\n")).alias("line"))
             .where(_bare("line") != "").select("site", "whole", _key(F.col("line")).alias("key")))
    one = (lines.join(_sent(keys), "key", "left_semi").groupBy("key", "whole")
           .agg(F.min(F.struct(F.xxhash64("site", "whole").alias("order"), "site")).alias("least"),
                (F.min("site") != F.max("site")).alias("copied")))
    often = (one.select("key", "least.site").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= sites).select("key"))
    return one.where("copied").join(often, "key", "left_anti").select("key", "whole")


def flagged_lines(docs: DataFrame, site: str = "source", sites: int = SITES, spare_copies: bool = False) -> DataFrame:
    """``ref, cut``: per document row that holds boilerplate, the (distinct) hashes of its lines to remove."""
    keys = boilerplate(docs, site, sites)
    lines = (_rows(docs, site).select(F.xxhash64("doc_id", "text").alias("ref"), F.xxhash64("text").alias("whole"),
                                      F.explode(F.split("text", "\n")).alias("line"))
             .where(_bare("line") != "").select("ref", "whole", _key(F.col("line")).alias("key")))
    found = lines.join(_sent(keys), "key")
    if spare_copies:
        found = found.join(copied_lines(docs, keys, site, sites), ["key", "whole"], "left_anti")
    return found.groupBy("ref").agg(F.collect_set("key").alias("cut"))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, spare_copies: bool = False) -> DataFrame:
    """``docs`` with ``__n_lines``, ``__n_removed`` and ``__text``, the text without boilerplate lines.

    Null text stays null, with no lines; an empty text is one empty line.  Blank lines stay.  Rows of a
    null site lose boilerplate but don't count towards it.  Repeated rows are treated alike.  With
    ``spare_copies`` exact copies keep the lines of ``copied_lines``.  An empty table stays empty.
    """
    found = flagged_lines(docs, site, sites, spare_copies).select(F.col("ref").alias("__ref"), F.col("cut").alias("__cut"))
    ref = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.join(found, ref == F.col("__ref"), "left").drop("__ref")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__cut", _key(x)), F.lit(False)) | (_bare(x) == ""))
    rows = rows.withColumn("__lines", F.coalesce(F.size(lines), F.lit(0))).withColumn(
        "__kept", F.when(F.col("__cut").isNotNull(), kept))
    left = F.array_join("__kept", "\n")
    whole = F.col("__kept").isNull()
    return (rows.withColumn("__n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines")).cast("long"))
            .withColumn("__n_removed", F.when(whole, 0).otherwise(F.col("__lines") - F.size("__kept")).cast("long"))
            .withColumn("__text", F.when(whole, F.col("text").cast("string")).otherwise(left)).drop("__cut", "__kept", "__lines"))


def cleaned(docs: DataFrame, site: str = "source") -> DataFrame:
    """The documents without boilerplate lines, however much of one those are; all columns as they were,
    ``n_chars`` too where a document lost nothing."""
    out = without_boilerplate(docs, site, spare_copies=True)
    lost = F.col("__n_removed") > 0
    columns = [F.when(lost, F.col("__text")).otherwise(F.col("text")).alias(c) if c == "text" else
               F.when(lost, F.char_length("__text")).otherwise(F.col(c)).cast(out.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col(c) for c in docs.columns]
    return out.select(*columns)


def digest(docs: DataFrame, site: str = "source") -> DataFrame:
    return without_boilerplate(docs, site).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce("__text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, text, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare, i
           FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                        unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
b AS (SELECT bare FROM l WHERE bare <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 12),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM l
      WHERE bare = '' OR bare NOT IN (SELECT bare FROM b) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
