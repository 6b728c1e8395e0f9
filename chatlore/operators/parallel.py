"""Partition helpers for the Python-heavy stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SMALL_SCAN_BYTES = 64 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A file scan dealt over the cores if its files are so small that they give fewer splits; others
    pass through.  The size is the optimizer's estimate from file lengths: no job is started."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL_SCAN_BYTES:
        return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)
    return scan


def flatten_structs(df: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Struct columns become top-level columns (``__<struct>__<field>``) so
    they can pass through an Arrow Python stage; ``unflatten`` rebuilds them."""
    structs: dict[str, list[str]] = {}
    cols = []
    for f in df.schema.fields:
        if f.name not in keep:
            continue
        if f.dataType.typeName() == "struct":
            names = [c.name for c in f.dataType.fields]
            structs[f.name] = names
            cols += [F.col(f"`{f.name}`.`{n}`").alias(f"__{f.name}__{n}") for n in names]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols), structs


def unflatten(df: DataFrame, structs: dict[str, list[str]], order: list[str]) -> DataFrame:
    out = []
    for name in order:
        if name in structs:
            out.append(F.struct(*[F.col(f"__{name}__{n}").alias(n) for n in structs[name]]).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)
