"""Virtual paths, identifiers and hashes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(text: Column, most: int = 100) -> Column:
    """Anything but letters, digits and underscores becomes one underscore; `unknown` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(text, r"\W", "_"), "_+", "_")
    return F.left(F.coalesce(F.nullif(F.trim(out, F.lit("_")), F.lit("")), F.lit("unknown")), F.lit(most))


def short_hash(text: Column) -> Column:
    return F.concat(F.lit("hash_"), F.substring(F.md5(text.cast("binary")), 1, 16))


def virtual_type(path: Column) -> Column:
    return F.regexp_extract(path, r"^([a-z]+)://", 1)


def virtual_id(path: Column) -> Column:
    return F.regexp_extract(path, r"^[a-z]+://(.*)$", 1)


def is_virtual(path: Column) -> Column:
    return path.rlike(r"^(sql|openapi|virtual)://.+")


def connection_id(url: Column) -> Column:
    """scheme_host_port_database of a connection string, without its credentials."""
    form = r"^([a-z]+)://(?:[^@/]*@)?([^:/?]+)(?::(\d+))?(?:/([^?]*))?"
    parts = [F.nullif(F.regexp_extract(url, form, i), F.lit("")) for i in (1, 2, 3, 4)]
    return sanitize(F.concat_ws("_", *parts))


def mask_connection(url: Column) -> Column:
    return F.regexp_replace(url, r"://([^:/@]+):[^@/]*@", "://$1:***@")


def duration_seconds(text: str) -> float:
    """`7d`, `2w`, or units in a row as in `1h30m` and `300ms`."""
    import re

    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}
    if not re.fullmatch(r"(\d+(?:\.\d+)?(?:ms|[smhdw]))+", text):
        raise ValueError(f"invalid duration {text!r}")
    return sum(float(n) * units[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw])", text))
