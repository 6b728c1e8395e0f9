"""Embedding operators (M1-M3).

``embed`` runs any vectorised embedder callable in ``mapInPandas``: the
callable is built once per task (a model would be loaded there), rows keep
their partitioning (no shuffle), and failures become ``embed_status`` /
``embed_error`` columns instead of killing the job unless ``fail_fast``.

The deterministic default is a token-hash embedder: tokens are runs of
letters and digits of the lowercased text; a token lands in bucket
``int(md5(token)[:6], 16) % dim`` and the vector holds the counts.  The same
function is available as a JVM-only expression plan (``hash_embed_sql``),
which the SQL oracle mirrors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore import schemas
from chatlore.operators.parallel import flatten_structs, unflatten

TOKEN_RE = r"[\p{L}\p{N}]+"

EmbedFn = Callable[[pd.Series], list]

MEMO_TOKENS = 200_000   # of a task, some 30 MB
SLICE_ROWS = 512        # embedded and handed on at once, so that Python holds few texts twice


class _BucketMemo(dict):
    """token -> bucket; computes (md5) only for tokens not seen in this task."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, tok: str) -> int:
        b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:6], 16) % self.dim
        if len(self) < MEMO_TOKENS:
            self[tok] = b
        return b


class HashEmbedder:
    """Counts of hashed tokens: one regex pass and one ``bincount`` per text."""

    def __init__(self, dim: int = 64):
        import regex

        self.dim = dim
        self._tok = regex.compile(TOKEN_RE)
        self._memo = _BucketMemo(dim)

    def __call__(self, texts: pd.Series) -> list:
        out = []
        memo, find, dim = self._memo, self._tok.findall, self.dim
        for text in texts:
            if text is None:
                raise ValueError("text is null")
            ids = [memo[t] for t in find(text.lower())]
            out.append(np.bincount(ids, minlength=dim).astype(np.float32))
        return out


def _embed_batches(make: Callable[[], EmbedFn], text_col: str, dim: int | None, fail_fast: bool,
                   model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make()
        for pdf in (batch.iloc[s:s + SLICE_ROWS] for batch in batches for s in range(0, len(batch), SLICE_ROWS)):
            texts = pdf[text_col]
            try:
                vecs = fn(texts)
                status = ["ok"] * len(pdf)
                errors = [None] * len(pdf)
            except Exception:  # retry row by row to isolate the failing rows
                vecs, status, errors = [], [], []
                for t in texts:
                    try:
                        vecs.append(fn(pd.Series([t]))[0])
                        status.append("ok")
                        errors.append(None)
                    except Exception as exc:  # noqa: BLE001 - recorded per row
                        if fail_fast:
                            raise RuntimeError(f"embedding failed for model '{model}': {exc}") from exc
                        vecs.append(None)
                        status.append("error")
                        errors.append(f"embedding failed for model '{model}': {exc}")
            clean = []
            for i, v in enumerate(vecs):
                if v is not None and dim is not None and len(v) != dim:
                    msg = f"embedding failed for model '{model}': dimension {len(v)} != {dim}"
                    if fail_fast:
                        raise RuntimeError(msg)
                    v, status[i], errors[i] = None, "error", msg
                clean.append(None if v is None else np.asarray(v, dtype=np.float32))
            yield pdf.assign(embedding=clean, embed_status=status, embed_error=errors)

    return run


def embed(df: DataFrame, text_col: str = "text", embedder: Callable[[], EmbedFn] | None = None,
          dim: int | None = 64, fail_fast: bool = False, model: str = "hash") -> DataFrame:
    """Attach ``embedding`` (ARRAY<FLOAT>), ``embed_status``, ``embed_error``.

    ``embedder`` is a zero-argument factory returning a callable
    ``pd.Series[str] -> list[vector]``; it runs once per task.
    """
    make = embedder or (lambda: HashEmbedder(dim or 64))
    names = [f.name for f in df.schema.fields if f.name not in ("embedding", "embed_status", "embed_error")]
    flat, structs = flatten_structs(df, names)
    out_schema = T.StructType(list(flat.schema.fields) + [
        T.StructField("embedding", schemas.EMBEDDING, True),
        T.StructField("embed_status", T.StringType(), False),
        T.StructField("embed_error", T.StringType(), True),
    ])
    embedded = flat.mapInPandas(_embed_batches(make, text_col, dim, fail_fast, model), out_schema)
    return unflatten(embedded, structs, names + ["embedding", "embed_status", "embed_error"])


def hash_bucket(tok: F.Column, dim: int) -> F.Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 6), 16, 10).cast("long"), F.lit(dim))


def hash_embed_sql(df: DataFrame, key: str, text_col: str = "text", dim: int = 64) -> DataFrame:
    """The hash embedder as built-in expressions, row by row without an exchange: ``(key, embedding)``.

    The buckets of a row's tokens are sorted together with one marker per
    bucket; the count of a bucket is the gap between its marker and the next.
    Rows with no token (or null text) get the zero vector.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_RE), 0)
    buckets = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: hash_bucket(t, dim))
    marked = df.select(F.col(key), F.sort_array(F.concat(buckets, F.sequence(F.lit(0).cast("long"), F.lit(dim).cast("long"))))
                       .alias("_sorted"))
    # every bucket is there, so the places where the value changes are those of the buckets in order
    starts = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1),
                      lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    placed = marked.select(key, starts.alias("_at"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.get("_at", i + 1) - F.get("_at", i) - 1).cast("float"))
    return placed.select(key, vec.alias("embedding"))
