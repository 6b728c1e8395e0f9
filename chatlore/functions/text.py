"""Scalar text functions (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlore.config import DEFAULT_DOMAIN, PY_SPACE_CLASS, SMALL_TALK, UNKNOWN_AUTHOR

_STRIP_RE = f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes the 29 ``isspace`` characters at both ends.

    ``trim`` only removes spaces, and ``\\s`` misses several of them.
    """
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def mention_strip(c: Column | str) -> Column:
    """Keep what follows the first ``>`` (the mention tag), then strip.

    Fires on any ``>``, mention or not: ``is a > b?`` gives ``b?``.
    """
    c = _col(c)
    pos = F.instr(c, ">")
    return F.when(pos > 0, py_strip(F.substring(c, pos + 1, 1 << 30))).otherwise(c)


def is_small_talk(c: Column | str, words=SMALL_TALK) -> Column:
    """Whole (already stripped) text, lowercased, is one of the greeting words."""
    return F.lower(_col(c)).isin(list(words))


def doc_id(channel: Column | str, ts: Column | str) -> Column:
    """Deterministic document id: hex sha256 of ``{channel}_{ts}``."""
    return F.sha2(F.concat(_col(channel), F.lit("_"), _col(ts)), 256)


def ts_digits(ts: Column | str) -> Column:
    """Message ts without its dot, as used in permalinks."""
    return F.replace(_col(ts), F.lit("."), F.lit(""))


def permalink(channel: Column | str, ts: Column | str, domain: str = DEFAULT_DOMAIN) -> Column:
    return F.concat(
        F.lit(f"https://{domain}.slack.com/archives/"),
        _col(channel),
        F.lit("/p"),
        ts_digits(ts),
    )


def reply_line(name: Column | str, text: Column | str) -> Column:
    """One stitched reply; a null reply text renders as empty."""
    return F.concat(
        F.lit("\n\n[Reply from "), _col(name), F.lit("]: "), F.coalesce(_col(text), F.lit(""))
    )


def falsy(c: Column | str) -> Column:
    """Python truthiness of an optional string: null or empty."""
    c = _col(c)
    return c.isNull() | (c == F.lit(""))


def author_name(user: Column | str, matched: Column | str, real_name: Column | str) -> Column:
    """Name shown for a user id: empty id -> Unknown; found -> real name; else the id."""
    return (
        F.when(falsy(user), F.lit(UNKNOWN_AUTHOR))
        .when(_col(matched), _col(real_name))
        .otherwise(_col(user))
    )


def ts_order(ts: Column | str) -> Column:
    """Numeric order of a ``seconds.micros`` ts string ('10.5' sorts after '9.5'); null if malformed."""
    return _col(ts).try_cast("decimal(20,6)")
