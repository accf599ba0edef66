"""Quality gates: reasons in a fixed order, either the first that applies or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.coerce import clamp, let, safe_str
from sievework.functions.text import is_vague, lexical_change, lower_squeezed, squeeze

# Limits, and terms that mark articles and edits for review.
MASK_RATIOS, LEAST_GROUNDING, LEAST_VERIFY = (0.002, 0.60), 0.35, 0.30
CONTEXT_TERMS = [
    "ethnicity",
    "ethnic",
    "race",
    "racial",
    "racism",
    "racist",
    "religion",
    "religious",
    "muslim",
    "islam",
    "jewish",
    "hindu",
    "christian",
    "sikh",
    "buddhist",
    "antisemit",
    "islamophob",
    "gender",
    "transgender",
    "sexuality",
    "lgbtq",
    "gay", "lesbian", "disability", "disabled", "immigration", "immigrant", "refugee", "nationality", "indigenous", "aboriginal",
]
EDIT_TERMS = [
    "ethnicity", "ethnic", "race", "racial", "religion", "religious", "muslim", "islam", "jewish", "hindu",
    "sikh", "gay", "trans", "lgbtq", "immigrant", "refugee", "disabled", "indigenous"
]


def text_reason(text: Column, original: Column | None = None, least: int = 3, most: int = 80, change: float = 0.01) -> Column:
    """The first rule that a text breaks, else 'ok'."""

    def first(x: Column) -> Column:
        t, n = x["t"], x["n"]
        out = F.when(t == "", "empty_text").when(F.lower(t).rlike(r"\[(?:mask|fill|visual)\]"), "prompt_markup_left_in_text")
        out = out.when(n < least, "too_short").when(n > most, "too_long").when(t.rlike(r"(.)\1{4,}"), "repeated_chars")
        if original is not None:
            out = out.when(original.isNotNull() & (lexical_change(original, t) < change), "too_similar_to_original")
        return out.otherwise("ok")

    return let(let(squeeze(text), lambda t: F.struct(t.alias("t"), F.size(F.split(t, " ")).alias("n"))), first)


def broken(reason: Column) -> Column:
    """The reason of a text that breaks a rule, null for 'ok'."""
    return let(reason, lambda r: F.when(r != "ok", r))


def technical_reason(
    status: Column, grounding_status: Column, mask_path: Column, mask_ratio: Column, grounding: Column,
    verify: Column, text: Column
) -> Column:
    """The first rule that an anchor breaks, null if none."""
    ok = lambda s: safe_str(s) == "ok"
    return (
        F.when(
            ~ok(status) | ~ok(grounding_status), "status_not_ok"
        ).when(safe_str(mask_path) == "", "no_union_mask").when(mask_ratio.isNull(), "missing_mask_stats").when(mask_ratio < MASK_RATIOS[0], "mask_too_small")
        .when(mask_ratio > MASK_RATIOS[1], "mask_too_large").when(
            grounding.isNull() | (grounding < LEAST_GROUNDING), "low_grounding_score"
        ).when(verify < LEAST_VERIFY, "low_verify_score").when(is_vague(text), "vague_anchor")
    )


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """All reasons whose condition holds and that aren't null, in order."""
    return F.array_compact(F.array(*[F.when(hit, why if isinstance(why, Column) else F.lit(why)) for hit, why in rules]))


def filter_reason(found: Column) -> Column:
    """Distinct reasons joined, or 'passed'."""
    return let(found, lambda r: F.when(F.size(r) == 0, "passed").otherwise(F.array_join(F.array_distinct(r), ";")))


def kept_and_quarantined(df: DataFrame, reason: str = "filter_reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason) == "passed"), df.where(F.col(reason) != "passed")


def term_hits(text: Column, terms: list[str]) -> Column:
    """Terms that occur as substrings, in their order."""
    return let(lower_squeezed(text), lambda t: F.filter(F.array(*map(F.lit, terms)), lambda w: t.contains(w)))


def sensitive_flag(article: Column, candidates: Column) -> Column:
    """Struct of hits where both the article and a candidate name protected characteristics; null otherwise.
    candidates: array of struct severity, candidate_index, edited_anchor, edit_instruction."""
    hit = lambda c: F.struct(
        c["severity"].alias("severity"), c["candidate_index"].alias("candidate_index"),
        term_hits(F.concat_ws(" ", c["edit_instruction"], c["edited_anchor"]), EDIT_TERMS).alias("matched_terms"),
        c["edited_anchor"].alias("edited_anchor")
    )
    edits = F.filter(F.transform(candidates, hit), lambda h: F.size(h["matched_terms"]) > 0)
    flag = lambda x: F.when(
        (F.size(x["context"]) > 0) & (F.size(x["edits"]) > 0),
        F.struct(F.lit(True).alias("flagged"), x["context"].alias("context_terms_matched"), x["edits"].alias("edit_hits"))
    )
    return let(F.struct(term_hits(article, CONTEXT_TERMS).alias("context"), edits.alias("edits")), flag)


def edit_reasons(row: dict[str, Column], cfg) -> list[tuple[Column, str | Column]]:
    """Rules of an executed edit, before those of image and text. row: its columns by name."""
    changed, delta = F.coalesce(row["masked_changed_ratio"], F.lit(0.0)), F.coalesce(row["masked_mean_delta"], F.lit(0.0))
    return [
        (F.lit(cfg.require_accepted) & ~F.coalesce(row["accepted"], F.lit(False)), "edit_not_accepted"),
        (safe_str(row["error"]) != "", "edit_error"),
        (clamp(row["realism_score"]) < cfg.realism_min, "low_realism"),
        (changed < cfg.changed_min, "changed_ratio_too_low"),
        (changed > cfg.changed_max, "changed_ratio_too_high"),
        (delta < cfg.delta_min, "masked_delta_too_low"),
        (F.lit(cfg.exclude_sensitive) & F.coalesce(row["sensitive"], F.lit(False)), "sensitive_flagged"),
        (
            F.lit(cfg.require_valid) & (row["anchor_valid"] == F.lit(False)),
            F.concat(F.lit("anchor_invalid:"), F.coalesce(F.when(row["anchor_reason"] != "", row["anchor_reason"]), F.lit("unknown")))
        ),
    ]


def rejection_summary(rejected: Column) -> Column:
    """Histogram text of reasons, sorted, with the first verifier note. rejected: array of struct rejection_reasons, note."""
    why = F.flatten(F.transform(rejected, lambda r: F.coalesce(r["rejection_reasons"], F.array().cast("array<string>"))))
    parts = F.transform(
        F.array_sort(F.array_distinct(why)),
        lambda w: F.concat(w, F.lit(" x"), F.size(F.filter(why, lambda x: x == w)).cast("string"))
    )
    notes = F.filter(
        F.transform(
            rejected,
            lambda r: F.when(F.array_contains(r["rejection_reasons"], "verifier_rejected"), F.trim(safe_str(r["note"]))).otherwise(F.lit(""))
        ),
        lambda n: n != ""
    )
    noted = F.when(F.size(notes) > 0, F.concat(F.lit(" | verifier: "), F.get(notes, F.lit(0)))).otherwise("")
    return F.when(
        F.size(rejected) == 0, "no detections survived candidate generation"
    ).when(F.size(why) == 0, "detections existed, but no accepted box remained").otherwise(F.concat(F.array_join(parts, ", "), noted))


def failure_summary(why: Column, boxes: Column) -> Column:
    """The first three distinct reasons and the first two boxes of a failed segmentation."""
    shown = F.transform(
        F.slice(boxes, 1, 2),
        lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda v: F.bround(v.cast("double"), 1).cast("string")), ", "), F.lit("]"))
    )
    named = F.array_join(F.slice(F.array_distinct(F.filter(why, lambda w: w != "")), 1, 3), "; ")
    return F.when(F.size(why) == 0, "no SAM mask produced").otherwise(
        F.concat(F.lit("reasons="), named, F.lit(" boxes="), F.when(F.size(boxes) > 0, F.array_join(shown, ", ")).otherwise("none"))
    )
