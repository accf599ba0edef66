"""Lenient and strict coercion of loosely typed values, as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


def safe_str(c: Column) -> Column:
    """A typed string, or '' for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def safe_list(c: Column, kind: str = STRINGS) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def variant_str(v: Column) -> Column:
    """The string in a VARIANT; '' for any other type, which a plain cast would convert."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.lit(""))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clipped to [low, high]; what isn't a number counts as low. NaN gives high."""
    return F.greatest(
        F.lit(low),
        F.least(F.lit(high), F.coalesce(F.expr("try_cast(null as double)") if c is None else c.try_cast("double"), F.lit(low)))
    )


def strict_clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clipped to [low, high]; null or text that isn't a number raises."""
    value = c.cast("double")
    checked = F.when(value.isNull(), F.raise_error(F.lit("a number is required")).cast("double")).otherwise(value)
    return F.greatest(F.lit(low), F.least(F.lit(high), checked))


def nonempty(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.when(c != "", c)


def first_nonempty(cols: Iterable[Column]) -> Column:
    return F.coalesce(*[nonempty(c) for c in cols], F.lit(""))


def distinct_by(items: Column, key) -> Column:
    """Items in order, the first of each key(item); those whose key is null all stay. Items and keys are worked out once."""
    first = lambda s, keys: F.filter(s, lambda e, i: F.coalesce(F.array_position(keys, e["k"]), i + 1) == i + 1)
    return let(
        F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x"))),
        lambda s: let(F.transform(s, lambda e: e["k"]), lambda keys: F.transform(first(s, keys), lambda e: e["x"]))
    )


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_string_list(items: Column, lower: bool = True) -> Column:
    """Squeezed strings without blanks; the first spelling of each, case aside."""
    squeezed = F.filter(
        F.transform(safe_list(items), lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))),
        lambda x: x != ""
    )
    return distinct_by(squeezed, F.lower if lower else (lambda x: x))


def unique_keep_order(items: Column, key) -> Column:
    return F.filter(distinct_by(safe_list(items), key), lambda x: key(x) != "")


def repaired_utf8(s: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; other text stays."""
    narrow = s.rlike(r"^[\x00-\xFF]*$")
    raw = F.encode(F.when(narrow, s), "ISO-8859-1")
    return F.when(narrow & F.coalesce(F.is_valid_utf8(raw.cast("string")), F.lit(False)), F.decode(raw, "UTF-8")).otherwise(s)


def rooted(path: Column, root: str) -> Column:
    """Null for an empty path; a relative one is put under root."""
    return F.when(
        F.coalesce(path, F.lit("")) == "", F.lit(None)
    ).when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def compact_json(c: Column) -> Column:
    return F.to_json(c)


def record_id(row_index: Column) -> Column:
    """Six digits or more, counted from 1."""
    return F.format_string("%06d", row_index + 1)
