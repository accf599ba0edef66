"""Lenient JSON: parse, take what looks like an object, repair what was cut off."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.coerce import let
from sievework.functions.text import is_generic_span, without_fences

#: Strings, ended or not, and brackets.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}\[\]]', re.S)

def parsed(s: Column) -> Column:
    """VARIANT of a text: as it is, else its widest object or array; null where neither parses."""
    t = without_fences(s)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)))


def parsed_object(s: Column) -> Column:
    """VARIANT object of a model's answer: after a think block, in fences, or from the first { to the last }."""
    t = F.regexp_replace(s, r"(?s)^.*</think>", "")
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    for_sure = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.coalesce(
        for_sure(F.try_parse_json(F.trim(t))), for_sure(F.try_parse_json(fenced)),
        for_sure(F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))
    )


def _closes(body: str) -> list[tuple[int, str]]:
    """Places of the closing braces of objects outside strings, each with what would close all that is still open."""
    out, open_ = [], []
    for m in _TOKEN.finditer(body):
        ch = m[0]
        if ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if open_:
                open_.pop()
            if ch == "}":
                out.append((m.start(), "".join(reversed(open_))))
    return out


def repaired(text: str | None) -> str | None:
    """A cut-off object closed after the last complete part up to which it parses, as JSON; null if none parses.

    One scan keeps what is open at each closing brace. A parse that fails tells where; as every longer part fails at
    that place too, the next one tried is the last that ends before it."""
    start = (text or "").find("{")
    if start < 0:
        return None
    body = text[start:]
    closes = _closes(body)
    while closes:
        end, rest = closes.pop()
        try:
            found = json.loads(body[: end + 1] + rest)
        except json.JSONDecodeError as e:
            while closes and closes[-1][0] >= e.pos:
                closes.pop()
            continue
        except (ValueError, RecursionError):
            continue
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
    return None


def repair(s: Column) -> Column:
    """repaired() in Arrow batches: closing brackets is iterative."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired)

    return F.pandas_udf(run, "string")(s)


def extracted(s: Column) -> Column:
    """Object as JSON text: parsed natively, else repaired, else null."""
    native = F.to_json(parsed_object(s))
    return F.coalesce(native, repair(F.when(native.isNull(), s)))


def has_fields(v: Column, kinds: dict[str, str]) -> Column:
    """Codes of the fields that a VARIANT object lacks or has of another type, in order. kinds: schema prefixes by name."""
    got = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    codes = [F.when(got(k).isNull(), f"missing_{k}").when(~got(k).startswith(kind), f"invalid_{k}") for k, kind in kinds.items()]
    return F.array_compact(F.array(*codes))


# The fields of extracted payloads with the types that they need, in the order of checking.
CAPTION_FIELDS = {"image_caption_literal": "string", "visible_text": "string", "people_count": "int", "notable_objects": "list"}
CAPTION_LISTS = ["visible_text_items", "visible_regions", "candidate_objects_all"]
ANCHOR_FIELDS = ["span", "semantic_tags", "functional_role", "localization", "attributes", "relations"]
ANCHOR_TYPES = {"semantic_tags": "list", "functional_role": "string", "localization": "object", "attributes": "list", "relations": "list"}
_KINDS = {"string": "STRING", "int": "(BIGINT|INT|SMALLINT|TINYINT|BOOLEAN)", "list": "ARRAY", "object": "OBJECT"}


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _keyed(v: Column, use) -> Column:
    """use(v, has): v is worked out and its keys are listed once; has(name) tells whether the object has a field, be it null."""
    keys = lambda x: F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>"))
    return let(v, lambda x: let(keys(x), lambda k: use(x, lambda name: F.array_contains(k, name))))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^{_KINDS[kind]}"), F.lit(False))


def caption_error(v: Column) -> Column:
    """The first rule that a caption (VARIANT) breaks; null if none."""
    def of(x: Column, has) -> Column:
        missing = [F.when(~has(k), F.lit(f"caption_missing_key:{k}")) for k in CAPTION_FIELDS]
        invalid = [F.when(~_is(_field(x, k), kind), F.lit(f"caption_invalid_{k}")) for k, kind in CAPTION_FIELDS.items()]
        lists = [F.when(has(k) & ~_is(_field(x, k), "list"), F.lit(f"caption_invalid_{k}")) for k in CAPTION_LISTS]
        return F.coalesce(F.when(~_is(x, "object"), F.lit("caption_not_dict")), *missing, *invalid, *lists)

    return _keyed(v, of)


def context_error(v: Column) -> Column:
    key = "article_context_rewrite"
    return _keyed(
        v,
        lambda x, has: F.when(~_is(x, "object"), F.lit("context_not_dict")).when(~has(key), F.lit(f"context_missing_{key}")).when(
            ~_is(_field(x, key), "string"), F.lit(f"context_invalid_{key}")
        )
    )


def missed_error(v: Column) -> Column:
    return let(
        v,
        lambda x: F.when(~_is(x, "object"), F.lit("missed_not_dict")).when(~_is(_field(x, "missed_anchors"), "list"), F.lit("missed_invalid_list"))
    )


def _anchor_error(a: Column, i: Column, ids: Column) -> Column:
    """The first rule that an anchor (VARIANT) breaks. ids: those of all anchors, of which an earlier one may have its own."""
    inside = ("level", "region_hint")
    every = lambda test: reduce(lambda x, y: x & y, [test(k) for k in inside])

    def placed(place: Column, has, name: Column) -> Column:
        return F.when(~every(has), F.concat(F.lit("anchor_missing_localization_fields:"), name)).when(
            ~every(lambda k: _is(_field(place, k), "string")), F.concat(F.lit("anchor_invalid_localization_fields:"), name)
        )

    def of(x: Column, has) -> Column:
        name, span = F.get(ids, i), F.try_variant_get(x, "$.span", "string")
        said = lambda what, *more: F.concat(F.lit(f"{what}:"), name, *more)
        return F.coalesce(
            F.when(~_is(x, "object"), F.concat(F.lit("anchor_not_dict:"), i.cast("string"))),
            F.when(~_is(_field(x, "anchor_id"), "string") | (name == ""), F.concat(F.lit("anchor_invalid_id:"), i.cast("string"))),
            F.when(F.array_position(ids, name) <= i, said("duplicate_anchor_id")),
            *[F.when(~has(k), said("anchor_missing_key", F.lit(f":{k}"))) for k in ANCHOR_FIELDS],
            F.when(~_is(_field(x, "span"), "string") | (F.trim(span) == ""), said("anchor_invalid_span")),
            F.when(is_generic_span(span), said("anchor_generic_span", F.lit(":"), span)),
            *[F.when(~_is(_field(x, k), kind), said(f"anchor_invalid_{k}")) for k, kind in ANCHOR_TYPES.items()],
            _keyed(_field(x, "localization"), lambda place, held: placed(place, held, name)),
        )

    return _keyed(a, of)


def anchors_error(v: Column, least: int = 1) -> Column:
    """The first rule that extracted anchors (VARIANT) break, with the place or id of the anchor; null if none."""
    caption = "grounded_context_caption"

    def listed(items: Column) -> Column:
        found = lambda ids: F.get(F.array_compact(F.transform(items, lambda a, i: _anchor_error(a, i, ids))), F.lit(0))
        first = let(F.transform(items, lambda a: F.try_variant_get(a, "$.anchor_id", "string")), found)
        return F.coalesce(F.when(F.size(items) < least, F.concat(F.lit("too_few_anchors:"), F.size(items).cast("string"))), first)

    return _keyed(
        v,
        lambda x, has: F.coalesce(
            F.when(~_is(x, "object"), F.lit("anchors_not_dict")), F.when(~has(caption) | ~has("anchors"), F.lit("anchors_missing_top_keys")),
            F.when(~_is(_field(x, caption), "string"), F.lit(f"anchors_invalid_{caption}")),
            F.when(~_is(_field(x, "anchors"), "list"), F.lit("anchors_invalid_list")),
            let(F.try_variant_get(x, "$.anchors", "array<variant>"), listed)
        )
    )
