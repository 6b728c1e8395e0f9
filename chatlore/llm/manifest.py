"""Merkle manifest of a dataset: leaves per document, one tree per source, one tree over the sources.

Slot pivot: conditional aggregates spread the children of every parent into ``FANOUT`` columns;
the columns in order, concatenated, hash to the parent, and leaving out a child's own column gives
its siblings.  Levels are written bottom-up, each a sixteenth of the one below; then the siblings
on the way to the root go top-down, one row per run of children, and are folded where the run is
taken apart.  No task holds more than its share of a level: ranks inside a source come from sorted
partitions and their counts, so a source with a third of all rows is spread like the others.

Only DataFrame functions are used.  Results for odd input: a null in any column is ``-`` in the
leaf; null ids rank first; repeated ids rank by their leaf, equal rows are leaves of their own (of
equal hash); an empty table gives no rows; columns other than the five are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlore.llm.common import written

FANOUT = 16
TAMPER_EVERY = 5


def _field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(column: Column) -> Column:
    return F.sha2(column, 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf`` and ``changed``, the leaf of the tampered row (null: not tampered)."""
    def leaf(text: Column) -> Column:
        return _hash(F.concat(_field(F.col("doc_id")), _field(F.col("source")), _field(F.col("lang")),
                              _field(F.col("n_chars")), _field(text)))

    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    return docs.select("source", "doc_id", leaf(F.col("text")).alias("leaf"),
                       F.when(tampered, leaf(F.translate("text", capitals, small))).alias("changed"))


def ranked(rows: DataFrame, order: list[Column], kept: list[str]) -> DataFrame:
    """``rows`` (a written table with ``grp``) with ``idx``, the 0-based rank in the group by ``order``,
    and ``last``, the group's highest.

    Rows are sorted over range partitions and written; a row's rank is its place in its partition,
    less the first place of its group there, plus the group's rows in the partitions before.  The
    table of counts has one row per group and partition."""
    placed = written(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
                     .select("grp", *kept, F.monotonically_increasing_id().alias("place")), "manifest-sorted")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"),
                            (F.sum("n").over(group) - 1).alias("last"))
    return (placed.join(offsets, ["grp", "part"])
            .select("grp", *kept, (F.col("place") + F.col("offset")).alias("idx"), "last"))


def _slots(column: str) -> list[str]:
    return [f"{column}{k}" for k in range(FANOUT)]


def pivoted(nodes: DataFrame, columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """One row per parent: ``grp, idx``, its children's ``columns`` in slot columns (null where it has
    fewer), its own ``hash`` and the group's ``last``."""
    slot = F.col("idx") % FANOUT
    spread = [F.max(F.when(slot == k, F.col(c))).alias(f"{c}{k}") for c in columns for k in range(FANOUT)]
    return (nodes.groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("parent"))
            .agg(*spread, F.max("last").alias("last")).withColumnRenamed("parent", "idx")
            .withColumn("hash", _hash(F.concat_ws("", *_slots("hash")))))


def _siblings(slot: int) -> Column:
    """The other slots' hashes, left and right of ``slot``."""
    hashes = _slots("hash")
    return F.struct(F.concat_ws("", F.lit(""), *hashes[:slot]).alias("left"),
                    F.concat_ws("", F.lit(""), *hashes[slot + 1:]).alias("right"))


def tree(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """All levels over ``nodes`` (``grp, idx, last, hash, row``) until every group has one node left.

    Returns the groups' top hashes (``grp, top``) and the pivoted levels, lowest first; a level holds
    the parents of the groups that still had several nodes, the lowest also its children's ``row``."""
    largest = nodes.agg(F.max("last")).first()[0]
    tops = nodes.where("last = 0").select("grp", F.col("hash").alias("top"))
    levels: list[DataFrame] = []
    width, below, columns = 1, nodes, ("hash", "row")
    while largest is not None and largest >= width:
        levels.append(written(pivoted(below.where(F.col("last") >= width), columns), f"{name}-level"))
        width, below, columns = width * FANOUT, levels[-1], ("hash",)
        tops = tops.unionByName(below.where(F.col("last") < width).select("grp", F.col("hash").alias("top")))
    return tops, levels


def _with_path(level: DataFrame, known: DataFrame | None, above: DataFrame, width: int) -> DataFrame:
    """A level's parents with ``path`` and ``about``: the tops of their groups take the group's."""
    tops = level.where(F.col("last") < width).join(above, "grp")
    if known is None:
        return tops
    return level.where(F.col("last") >= width).join(known, ["grp", "idx"]).unionByName(tops)


def _taken_apart(parents: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The children of pivoted parents, each with its path (own siblings first)."""
    child = F.array(*[F.struct(F.lit(s).alias("slot"), *[F.col(f"{c}{s}").alias(c) for c in columns],
                               _siblings(s).alias("step")) for s in range(FANOUT)])
    return (parents.select("grp", "idx", "path", "about", F.explode(child).alias("c")).where("c.hash IS NOT NULL")
            .select("grp", (F.col("idx") * FANOUT + F.col("c.slot")).alias("idx"), *[f"c.{c}" for c in columns],
                    F.concat(F.array("c.step"), "path").alias("path"), "about"))


def descended(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """``grp, hash, row, path, about`` of every node: ``path`` holds the siblings of the node, of its
    parent and so on up to its group's top, then the group's ``path`` in ``above`` (``grp, path, about``)."""
    found = nodes.where("last = 0").join(above, "grp").select("grp", "hash", "row", "path", "about")
    known: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        parents = _with_path(levels[k], known, above, FANOUT ** (k + 1))
        if k:
            known = written(_taken_apart(parents, ("hash",)).drop("hash"), f"{name}-paths")
        else:
            found = _taken_apart(parents, ("hash", "row")).select(*found.columns).unionByName(found)
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: ``source, doc_id, leaf, changed, subroot, root`` and ``path``, the siblings
    (``left``, ``right``) from the leaf's run up to the root."""
    rows = written(leaves(docs).select(_field(F.col("source")).alias("grp"), "source", "doc_id", "leaf", "changed",
                                       F.monotonically_increasing_id().alias("place_read")), "manifest-leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("place_read").asc()]
    nodes = written(ranked(rows, order, ["doc_id", "leaf", "changed"])
                    .select("grp", "idx", "last", F.col("leaf").alias("hash"), F.struct("doc_id", "changed").alias("row")),
                    "manifest-nodes")
    subroots, levels = tree(nodes, "manifest")
    # a source's field starts with its length; the order of sources needs the value itself
    names = rows.groupBy("grp").agg(F.max("source").alias("source"))
    tops = written(subroots.withColumnRenamed("grp", "key").join(names.withColumnRenamed("grp", "key"), "key")
                   .withColumn("grp", F.lit("")), "manifest-subroots")
    sources = written(ranked(tops, [F.col("source").asc_nulls_first()], ["key", "source", "top"])
                      .select("grp", "idx", "last", F.col("top").alias("hash"), F.struct("key", "source").alias("row")),
                      "manifest-sources")
    root, upper = tree(sources, "manifest-upper")
    end = root.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                      F.struct(F.col("top").alias("root")).alias("about"))
    above = written(descended(sources, upper, end, "manifest-upper")
                    .select(F.col("row.key").alias("grp"), "path",
                            F.struct("row.source", F.col("hash").alias("subroot"), "about.root").alias("about")),
                    "manifest-above")
    return (descended(nodes, levels, above, "manifest")
            .select("about.source", "row.doc_id", F.col("hash").alias("leaf"), "row.changed", "about.subroot", "about.root", "path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: _hash(F.concat(step["left"], node, step["right"])))


def proof(path: Column) -> Column:
    """All siblings from the leaf to the root, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def digest(docs: DataFrame) -> DataFrame:
    found = manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", _hash(proof(F.col("path"))).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


# DuckDB has no crc32: bit by bit over the digits of the id.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
  lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]),
  lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295))"""


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: DuckDB SQL of ``digest``.
ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
         CASE WHEN {_CRC} % {TAMPER_EVERY} = 0
              THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
node(source, lvl, idx, hash, n) AS (
  SELECT source, 0, idx, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT source, lvl + 1, idx // {FANOUT}, sha256(string_agg(hash, '' ORDER BY idx)), any_value((n + {FANOUT - 1}) // {FANOUT})
  FROM node WHERE n > 1 GROUP BY source, lvl, idx // {FANOUT}),
subroot AS (
  SELECT source, lvl AS depth, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM node WHERE n = 1),
upper(lvl, idx, hash, n) AS (
  SELECT 0, idx, subroot, count(*) OVER () FROM subroot
  UNION ALL
  SELECT lvl + 1, idx // {FANOUT}, sha256(string_agg(hash, '' ORDER BY idx)), any_value((n + {FANOUT - 1}) // {FANOUT})
  FROM upper WHERE n > 1 GROUP BY lvl, idx // {FANOUT}),
run AS (
  SELECT source, lvl, idx // {FANOUT} AS run, list(hash ORDER BY idx) AS hashes FROM node WHERE n > 1 GROUP BY ALL),
upper_run AS (
  SELECT lvl, idx // {FANOUT} AS run, list(hash ORDER BY idx) AS hashes FROM upper WHERE n > 1 GROUP BY ALL),
way AS (   -- a leaf's run on every level, up to the root
  SELECT p.source, p.idx, r.lvl, r.hashes, (p.idx // ({FANOUT} ** r.lvl)::BIGINT) % {FANOUT} AS slot
  FROM placed p JOIN run r ON r.source IS NOT DISTINCT FROM p.source AND r.run = p.idx // ({FANOUT} ** (r.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.source, p.idx, s.depth + r.lvl, r.hashes, (s.idx // ({FANOUT} ** r.lvl)::BIGINT) % {FANOUT}
  FROM placed p JOIN subroot s ON s.source IS NOT DISTINCT FROM p.source
  JOIN upper_run r ON r.run = s.idx // ({FANOUT} ** (r.lvl + 1))::BIGINT),
step AS (
  SELECT source, idx, lvl, array_to_string(hashes[:slot], '') AS before, array_to_string(hashes[slot + 2:], '') AS after FROM way),
path AS (
  SELECT source, idx, list({{'before': before, 'after': after}} ORDER BY lvl) AS steps FROM step GROUP BY source, idx),
folded AS (
  SELECT p.doc_id, p.leaf, s.subroot, r.hash AS root,
         sha256(coalesce(array_to_string(list_transform(w.steps, lambda x: x.before || x.after), ''), '')) AS proof_sha256,
         coalesce(list_reduce(list_prepend(coalesce(p.changed, p.leaf), list_transform(w.steps, lambda x: x.before || '*' || x.after)),
                              lambda h, x: sha256(replace(x, '*', h))), coalesce(p.changed, p.leaf)) AS folded_root
  FROM placed p JOIN subroot s ON s.source IS NOT DISTINCT FROM p.source
  CROSS JOIN (SELECT hash FROM upper WHERE n = 1) r
  LEFT JOIN path w ON w.source IS NOT DISTINCT FROM p.source AND w.idx = p.idx)
SELECT *, folded_root = root AS verified FROM folded
"""
