"""Scores, buckets and calibration, as Columns. Sums keep one order, so that results are the same everywhere."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.coerce import clamp, let, safe_str, strict_clamp
from sievework.functions.text import has_any, lower_squeezed

# Weights, thresholds and priors of the release and of planning, and the planning keyword bank.
WEIGHTS = {"tier": 0.35, "incongruity": 0.25, "contradiction": 0.20, "salience": 0.15, "visibility": 0.05}
RELEASE_BUCKETS, PLAN_BUCKETS = (0.30, 0.60), (0.18, 0.45)
RELEASE_PRIORS = {"tier_a": 0.15, "tier_b": 0.50, "tier_c": 0.85}
PLAN_PRIORS = {"tier_c": 0.90, "tier_b": 0.55, "tier_a": 0.15}
SHIFT_WEIGHTS = {"semantic": 0.50, "role": 0.30, "impact": 0.20}
VISIBILITY_WEIGHTS, FULL_MASK = {"mask": 0.65, "grounding": 0.35}, 0.15
SALIENCE_WEIGHTS, MANY_RELATIONS, FULL_SIZE = {"mention": 0.40, "relations": 0.25, "size": 0.20, "category": 0.15}, 3.0, 0.10
BONUS_CATEGORIES = {0.20: ["person", "face", "logo", "text", "sign"], 0.15: ["vehicle", "flag", "weapon"]}
BLENDS, SIZE_STEPS, HIDDEN = {"salience": (0.65, 0.35), "visibility": (0.70, 0.30)}, {
    "dominant": 0.15, "moderate": 0.05, "small": -0.05, "tiny": -0.15
}, 0.4
CONFIDENCE_WEIGHTS = {"realism": 0.45, "localizability": 0.35, "editability": 0.20}
FALLBACKS = {"low": ("attribute_change", 0.1, 0.1, 0.1, 0.1), "medium": ("replace", 0.5, 0.4, 0.4, 0.4), "high": ("remove", 0.8, 0.7, 0.6, 0.7)}
TIER_GAP, LEAST_SALIENCE, SALIENCE_GATE = 0.05, 0.15, 0.25
SEVERITIES = ["low", "medium", "high"]
TIER_WORDS = {
    "tier_a": [
        "cup",
        "mug",
        "bottle",
        "bag",
        "backpack",
        "umbrella",
        "book",
        "notebook",
        "microphone",
        "paper",
        "phone",
        "laptop",
        "camera",
        "chair",
        "table",
        "helmet",
        "hat",
        "sign",
        "poster",
        "banner",
        "car",
        "bus",
        "van",
        "tie",
        "shirt", "jacket", "glasses",
    ],
    "tier_b": [
        "beer", "alcohol", "wine", "cigarette", "vape", "cctv", "camera rig", "drone", "syringe", "pill",
        "police tape", "riot gear", "uniform", "surveillance", "mask", "flag", "cash", "suitcase", "fuel can",
        "military truck"
    ],
    "tier_c": [
        "gun", "rifle", "pistol", "weapon", "knife", "bomb", "grenade", "handcuff", "blood", "fire", "flames",
        "corpse", "body bag", "explosive", "molotov", "missile", "tank", "soldier", "armed", "hostage"
    ],
}
HINTED_OPERATIONS = {
    "person": ["replace", "remove", "attribute_change"],
    "face": ["attribute_change", "replace"],
    "logo": ["replace", "remove"],
    "sign": ["replace", "attribute_change", "remove"],
    "text": ["replace", "attribute_change", "remove"],
    "vehicle": ["replace", "attribute_change", "remove"],
    "weapon": ["replace", "remove", "insert"],
}


@dataclass(frozen=True)
class SeverityModel:
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    priors: dict = field(default_factory=lambda: dict(RELEASE_PRIORS))
    low_max: float = RELEASE_BUCKETS[0]
    medium_max: float = RELEASE_BUCKETS[1]
    none_max: float | None = None
    calibration: tuple = ()


def calibration_points(given) -> tuple:
    """Sorted pairs in [0, 1] from pairs, objects (raw, calibrated), or an object with points; empty if there are none."""
    items = given.get("points", given.get("calibration", [])) if isinstance(given, dict) else given
    out = []
    for p in items if isinstance(items, list) else []:
        x, y = (p.get("raw"), p.get("calibrated")) if isinstance(p, dict) else p if isinstance(p, (list, tuple)) and len(p) == 2 else (None, None)
        if isinstance(x, (int, float)) and isinstance(y, (int, float)):
            out.append((min(max(float(x), 0.0), 1.0), min(max(float(y), 0.0), 1.0)))
    return tuple(sorted(out))


def severity_model(text: str) -> SeverityModel:
    """A model from JSON; what it doesn't name keeps its default, and weights aren't scaled anew."""
    given, base = json.loads(text), SeverityModel()
    named = {"tier": "tier_obj", "incongruity": "ctx_incongruity", "contradiction": "nli_contradiction"}
    weights = {k: float(given.get("weights", {}).get(named.get(k, k), v)) for k, v in base.weights.items()}
    limits = given.get("thresholds", {})
    return SeverityModel(
        weights, base.priors | {k: float(v) for k, v in given.get("tier_priors", {}).items()},
        float(limits.get("low_max", base.low_max)), float(limits.get("medium_max", base.medium_max)),
        limits.get("none_max"), calibration_points(given.get("calibration", []))
    )


def bucket(score: Column, limits: tuple[float, float] = RELEASE_BUCKETS) -> Column:
    return F.when(score <= limits[0], "low").when(score <= limits[1], "medium").otherwise("high")


def severity_rank(severity: Column) -> Column:
    """0, 1, 2; -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("int") - 1


def semantic_shift(semantic: Column, role: Column, impact: Column, strict: bool = False) -> Column:
    c = strict_clamp if strict else clamp
    w = SHIFT_WEIGHTS
    return c(w["semantic"] * c(semantic) + w["role"] * c(role) + w["impact"] * c(impact))


def contradiction(given: Column, direction: Column) -> Column:
    """The given value; where it is 0 or missing, what the named direction stands for."""
    d = F.lower(F.trim(safe_str(direction)))
    return F.when(clamp(given) > 0, clamp(given)).when(d == "contradiction", 1.0).when(d == "neutral", 0.5).otherwise(0.0)


def tier_prior(given: Column, proxy: Column, name: Column, priors: dict[str, float] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (priors or RELEASE_PRIORS).items() for x in kv])
    return clamp(F.coalesce(given, proxy, F.element_at(known, name), F.lit(0.50)))


def severity_score(
    tier: Column, incongruity: Column, contradicted: Column, salience: Column, visibility: Column,
    weights: dict[str, float] | None = None
) -> Column:
    w = weights or WEIGHTS
    return clamp(
        w["tier"] * clamp(tier) + w["incongruity"] * clamp(incongruity) + w["contradiction"] * clamp(contradicted) + w["salience"] * clamp(salience) + w["visibility"] * (1.0 - clamp(visibility))
    )


def calibrated(score: Column, points: tuple) -> Column:
    """Linear between points, constant beyond the ends; the clamped score itself without points."""
    x = clamp(score)
    if not points:
        return x
    out = F.when(x <= points[0][0], F.lit(points[0][1])).when(x >= points[-1][0], F.lit(points[-1][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when((x >= x0) & (x <= x1), F.lit(y1) if x1 == x0 else clamp(y0 + (x - x0) / (x1 - x0) * (y1 - y0)))
    return out.otherwise(x)


def visibility_proxy(mask_ratio: Column, grounding: Column) -> Column:
    w = VISIBILITY_WEIGHTS
    return clamp(w["mask"] * clamp(clamp(mask_ratio) / FULL_MASK) + w["grounding"] * clamp(grounding))


def salience_terms(relations: Column, mask_ratio: Column, category: Column, headline: Column, summary: Column, anchor: Column) -> Column:
    """Struct mention, relation_term, size_term, category_bonus and the proxy."""
    blob = lower_squeezed(F.concat_ws(" ", headline, summary))
    mention = let(
        F.struct(blob.alias("blob"), lower_squeezed(anchor).alias("named")),
        lambda x: F.when((x["named"] != "") & x["blob"].contains(x["named"]), 1.0).otherwise(0.0)
    )
    related, sized = clamp(relations / F.lit(MANY_RELATIONS)), clamp(F.coalesce(mask_ratio, F.lit(0.0)) / FULL_SIZE)
    bonus = let(
        lower_squeezed(category),
        lambda cat: reduce(lambda w, kv: w.when(has_any(cat, kv[1]), kv[0]), BONUS_CATEGORIES.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    )
    w = SALIENCE_WEIGHTS
    parts = F.struct(mention.alias("mention"), related.alias("relation_term"), sized.alias("size_term"), bonus.alias("category_bonus"))
    proxy = lambda p: clamp(
        w["mention"] * p["mention"] + w["relations"] * p["relation_term"] + w["size"] * p["size_term"] + w["category"] * p["category_bonus"]
    )
    return let(
        parts,
        lambda p: F.struct(*[p[n].alias(n) for n in ("mention", "relation_term", "size_term", "category_bonus")], proxy(p).alias("proxy"))
    )


def planned_score(tier: Column, shift: Column, contradicted: Column, salience: Column, visibility: Column, blended: Column) -> Column:
    """The severity score with the tier's term scaled by salience."""
    return severity_score(clamp(tier) * clamp(blended / SALIENCE_GATE), shift, contradicted, salience, visibility)


def blended(salience: Column, visibility: Column, centrality: Column, editability: Column, visible: Column, size: Column) -> Column:
    """Struct salience and visibility, of proxies and what grounding has seen."""
    (s0, s1), (v0, v1) = BLENDS["salience"], BLENDS["visibility"]
    sal, vis = clamp(s0 * salience + s1 * strict_clamp(centrality)), clamp(v0 * visibility + v1 * strict_clamp(editability))
    step = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SIZE_STEPS.items() for x in kv]), lower_squeezed(size)), F.lit(0.0))
    return F.struct(
        clamp(sal + step).alias("salience"),
        F.when(F.coalesce(visible, F.lit(True)), vis).otherwise(clamp(vis * HIDDEN)).alias("visibility")
    )


def confidence(realism: Column, localizability: Column, editability: Column) -> Column:
    w = CONFIDENCE_WEIGHTS
    return clamp(w["realism"] * clamp(realism) + w["localizability"] * clamp(localizability) + w["editability"] * clamp(editability))


def object_tier(anchor: Column, category: Column, bank: dict[str, list[str]] | None = None) -> Column:
    """Struct tier, prior and reason: the first keyword of the highest tier that occurs, else by category."""
    words = {tier: [w for w in found if w] for tier, found in (bank or TIER_WORDS).items()}
    answer = lambda t, p, why: F.struct(F.lit(t).alias("tier"), F.lit(p).alias("prior"), why.alias("reason"))

    def of(hay: Column) -> Column:
        out = F.when(F.lit(False), answer("", 0.0, F.lit("")))
        for tier, prior in PLAN_PRIORS.items():
            if words.get(tier):
                hit = F.get(F.filter(F.array(*map(F.lit, words[tier])), lambda w: hay.contains(w)), F.lit(0))
                out = out.when(has_any(hay, words[tier]), answer(tier, prior, hit))
        out = out.when(has_any(hay, ["person", "face", "logo", "sign", "text"]), answer("tier_b", 0.50, F.lit("category_fallback")))
        return out.otherwise(answer("tier_a", 0.20, F.lit("default_fallback")))

    return let(lower_squeezed(F.concat(safe_str(anchor), F.lit(" | "), safe_str(category))), of)


def allowed_operations(category: Column, anchor: Column, mask_ratio: Column) -> Column:
    def of(x: Column) -> Column:
        hints = [
            F.when(x["c"].contains(h) | x["a"].contains(h), F.array(*map(F.lit, ops))).otherwise(F.array().cast("array<string>")) for h,
            ops in HINTED_OPERATIONS.items()
        ]
        base, known = F.array(F.lit("replace"), F.lit("remove"), F.lit("attribute_change")), list(HINTED_OPERATIONS)
        return F.when(has_any(x["c"], known) | has_any(x["a"], known), F.array_distinct(F.concat(base, *hints))).otherwise(base)

    ops = let(F.struct(lower_squeezed(category).alias("c"), lower_squeezed(anchor).alias("a")), of)
    return F.when(F.coalesce(mask_ratio, F.lit(0.0)) > 0.02, F.array_remove(ops, "insert")).otherwise(ops)


def size_hint(mask_ratio: Column) -> Column:
    return F.when(mask_ratio > 0.10, "large").when(mask_ratio > 0.03, "medium").otherwise("small")


def size_band(mask_ratio: Column) -> Column:
    return F.when(mask_ratio < 0.05, "small").when(mask_ratio < 0.25, "medium").when(mask_ratio.isNotNull(), "large")


def grounding_hint(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def text_operation(severity: Column, operation: Column) -> Column:
    return F.when(severity == "low", "stance_shift").when(
        operation == "attribute_change", "claim_alteration"
    ).when(severity == "high", "narrative_reframe").when(operation == "remove", "claim_alteration").otherwise("attribution_change")


def fallback_candidate(severity: str, anchor: Column, allowed: Column) -> Column:
    """A neutral candidate for a severity that has none left."""
    wanted, *level = FALLBACKS[severity]
    operation = F.when(F.array_contains(allowed, wanted) | (F.size(allowed) == 0), wanted).otherwise(F.get(allowed, F.lit(0)))
    shown = F.substring(anchor, 1, 60)
    values = zip(("semantic_shift", "role_shift", "contradiction_potential", "public_impact"), level, strict=True)
    return F.struct(
        operation.alias("operation"), F.when(shown == "", "anchor").otherwise(shown).alias("edited_anchor"),
        *[F.lit(v).alias(k) for k, v in values], F.lit(0.5).alias("realism"),
        F.lit(0.5).alias("localizability"), F.lit(True).alias("is_fallback")
    )
