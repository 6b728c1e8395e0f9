"""Small tables with the awkward cases every operator has a defined result for."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use themselves
          "n_words long, score double, component_id long, ref long, key long, class long, place int, hash long, "
          "quality int, failures long, kept boolean, length long, sequence_id long")
WORDS = "the of and to in river stone light garden winter house window paper bread water cloud road music letter".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", f"{r.randrange(40)}", "."]) for _ in range(n))


def edge_rows() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 90)
    near = a.split(" ")
    near[60] = "changed"
    texts = [
        (0, a, "en"), (1, a, "en"), (2, " ".join(near), "en"), (3, b, "fr"), (4, None, "en"), (5, "", None), (6, " \n\t ", "en"),
        (7, "one two three", "de"), (8, "One TWO three", "de"), (9, "12 34 !!", None),
        (10, prose(3, 30) + "\n" + prose(3, 30), "fr"), (11, "ha " * 80, "en"), (12, "x" * 5000, "en"),
        (13, prose(4, 20_000), "en"), (14, "Élan à côté du café, où l'été s'en va " * 6, "fr"), (15, "日本語のテキスト" * 10, None),
        (16, "\n".join(["same line here"] * 5), "en"), (17, prose(1, 60) + " " + prose(9, 100), None),
        (3, b, "fr"), (3, b, "fr"), (18, prose(18, 4), "en"), (None, prose(19, 50), "en"), (None, None, None),
    ]
    return [(i, t, lang, None if k % 5 == 0 else f"s{k % 4}", len(t) if t is not None else None, *[None] * 13)
            for k, (i, t, lang) in enumerate(texts)]


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def no_python(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))
