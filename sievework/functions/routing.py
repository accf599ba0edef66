"""Routing of requested operations by what is edited and by mask statistics, as ordered decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import has_any, has_phrase, lower_joined

# Keywords of anchors and area limits.
FACE = [
    "face", "expression", "eye", "eyes", "eyebrow", "eyebrows", "mouth", "smile", "frown", "nose", "chin",
    "forehead", "skin", "complexion", "beard", "moustache", "mustache", "hair colour", "hair color", "lip",
    "lips"
]
PERSON = [
    "person",
    "man",
    "woman",
    "boy",
    "girl",
    "human",
    "subject",
    "individual",
    "people",
    "adult",
    "child",
    "pedestrian",
    "worker",
    "soldier",
    "police",
    "officer",
    "officer uniform",
    "face",
    "head",
    "torso",
    "body",
    "arm",
    "hand",
    "leg", "foot", "helmet", "cap", "hat", "shirt", "jacket", "vest", "uniform",
]
ATTACHED = [
    "shirt", "jacket", "vest", "uniform", "cap", "hat", "helmet", "badge", "patch", "strap", "backpack",
    "bag", "watch", "glove", "glasses", "belt", "radio", "bodycam", "device", "shoulder", "chest", "torso",
    "arm", "hand"
]
IDENTITY = ["face", "head", "hair", "eye", "eyes", "nose", "mouth", "beard", "mustache", "moustache", "skin", "expression", "forehead", "chin", "ear"]
SAFE_REMOVE = [
    "logo", "sign", "poster", "graffiti", "sticker", "text", "marking", "label", "symbol", "wall object",
    "small object", "cone", "bin", "box"
]
SWAPS = ["man ", "woman ", "person ", "police", "officer", "soldier", "figure", "individual", "military", "guard"]
WHOLE = ["person", "man", "woman", "officer", "soldier", "individual", "subject"]
REPLACE_AREA, PERSON_REPLACE_AREA, SCENE_REPLACE_AREA = 0.28, 0.14, 0.40
REMOVE_AREA, ATTACHED_REMOVE_AREA, SCENE_REMOVE_AREA, FALLBACK_AREA, FALLBACK_PERSON_AREA = 0.26, 0.07, 0.30, 0.28, 0.12
STRENGTHS = {"attribute_change": 0.42, "attribute_change_face": 0.24, "replace_small": 0.46, "replace_medium": 0.54, "insert": 0.84, "fill": 0.82}
CHANGED_FLOOR, DELTA_FLOOR = {"low": 0.010, "medium": 0.018, "high": 0.030}, {"low": 3.0, "medium": 5.0, "high": 8.0}
REALISM = 0.45
COMPACTNESS, ASPECTS, BORDER_AREA, SMALL_AREA, MEDIUM_AREA = 0.10, (0.20, 4.5), 0.45, 0.06, 0.12
PADS, NEAR_PADS, NEAR_FACTOR = (0.10, 0.12, 0.14), (0.14, 0.18), 0.85
#: Factors of the attempts' strengths, and of each kind of attempt the largest strength, guidance, steps and feather.
FACTORS = {"low": [1.0, 1.15], "medium": [1.10, 1.25, 1.40], "high": [1.25, 1.45, 1.65], "fresh": [1.0, 1.08, 1.16], "replace": [1.0, 1.12, 1.24]}
SCHEDULES = {"attribute_change": (0.92, 8.0, 42), "fresh": (0.98, 12.0, 52), "replace": (0.95, 8.0, 42)}
FEATHERS = {"face": 3, "attribute_change": 5, "fresh": 6, "replace": 5}
RESULT = [
    "sample_id",
    "anchor_id",
    "requested_operation",
    "effective_operation",
    "route_reason",
    "severity",
    "candidate_index",
    "tier",
    "planning_score",
    "edit_instruction",
    "edited_anchor",
    "fill_clause",
    "visual_prompt",
    "image_path",
    "union_mask_path",
    "bbox_xyxy",
    "output_path",
    "lama_intermediate",
    "realism_score",
    "masked_mean_delta",
    "masked_changed_ratio",
    "accepted",
    "reject_reason",
    "error",
    "duration_s",
    "rewritten_caption",
    "nli_direction",
    "text_edit_operation", "modality",
]


def anchor_meta(anchor: Column, fill: Column, visual: Column, instruction: Column) -> Column:
    """Struct of eight flags of what an edit touches."""
    text, named, filled = lower_joined(anchor, fill, visual, instruction), F.trim(
        F.lower(F.coalesce(anchor, F.lit("")))
    ), F.trim(F.lower(F.coalesce(fill, F.lit(""))))
    face, person, attached = has_phrase(named, FACE), has_phrase(text, PERSON), has_phrase(text, ATTACHED)
    identity = face | has_phrase(text, IDENTITY)
    swap = F.lit(False)
    for p in SWAPS:
        swap = swap | filled.startswith(p)
    return F.struct(
        face.alias("face_edit"),
        person.alias("person_like"),
        (person & has_any(named, WHOLE)).alias("whole_person"),
        attached.alias("body_attached"),
        identity.alias("identity_sensitive"),
        has_phrase(text, SAFE_REMOVE).alias("safe_remove"),
        swap.alias("role_swap"),
        (person & (attached | identity | has_any(text, ["vest", "shirt", "uniform"]))).alias("hidden_structure"),
    )


def route(operation: Column, meta: Column, area: Column, aspect: Column, compactness: Column, borders: Column, empty: Column) -> Column:
    """Struct effective and reason: the first rule that applies to the requested operation. The order of the rules, their
    limits and their answers are fixed values."""
    op = F.lower(operation)
    near = meta["person_like"] | meta["body_attached"]
    remove, replace = op == "remove", op == "replace"
    rules = [
        (empty, "skip", "empty_mask"),
        (op == "attribute_change", "attribute_change", "requested_attribute_change"),
        (op == "fill", "fill", "requested_fill"),
        (op == "insert", "insert", "requested_insert"),
        (remove & meta["hidden_structure"] & near, "attribute_change", "remove_reveals_hidden_structure_rerouted"),
        (remove & meta["hidden_structure"] & (area <= SCENE_REMOVE_AREA), "remove", "scene_remove_despite_hidden_structure"),
        (remove & meta["hidden_structure"], "skip", "remove_reveals_hidden_structure"),
        (remove & meta["body_attached"] & (area > ATTACHED_REMOVE_AREA), "attribute_change", "body_attached_remove_unstable_rerouted"),
        (remove & (compactness < COMPACTNESS), "skip", "remove_irregular_mask"),
        (remove & near & (area > REMOVE_AREA), "attribute_change", "person_remove_too_large_rerouted"),
        (remove & near, "remove", "safe_person_remove"),
        (remove & (area > SCENE_REMOVE_AREA), "skip", "remove_too_large"),
        (remove, "remove", "safe_remove"),
        (replace & meta["role_swap"] & near, "attribute_change", "role_swap_rerouted_to_local_attribute_change"),
        (replace & meta["whole_person"], "attribute_change", "whole_person_replace_disallowed"),
        (replace & ((aspect > ASPECTS[1]) | (aspect < ASPECTS[0])), "skip", "replace_strip_like_region"),
        (replace & (compactness < COMPACTNESS), "skip", "replace_irregular_mask"),
        (replace & meta["identity_sensitive"], "attribute_change", "identity_sensitive_replace_rerouted"),
        (replace & near & (area > PERSON_REPLACE_AREA), "attribute_change", "person_like_replace_too_large_rerouted"),
        (replace & near, "replace", "safe_person_local_replace"),
        (replace & (borders >= 3) & (area > BORDER_AREA), "skip", "replace_border_touching_extreme"),
        (replace & (area > SCENE_REPLACE_AREA), "skip", "replace_too_large"),
        (replace & (borders >= 2), "replace", "replace_border_touching_allowed"),
        (replace & (area > REPLACE_AREA), "replace", "safe_large_scene_replace"),
        (replace, "replace", "safe_replace"),
    ]
    answer = lambda effective, reason: F.struct(F.lit(effective).alias("effective"), reason.alias("reason"))
    out = F.when(F.lit(False), answer("", F.lit("")))
    for hit, effective, reason in rules:
        out = out.when(hit, answer(effective, F.lit(reason)))
    return out.otherwise(answer("skip", F.concat(F.lit("unknown_operation_"), op)))


def replace_strength(area: Column, near_person: Column) -> Column:
    """Struct strength and pad of a replacement."""
    pair = lambda s, p: F.struct(F.lit(s).alias("strength"), F.lit(p).alias("pad"))
    small, medium = STRENGTHS["replace_small"], STRENGTHS["replace_medium"]
    return (
        F.when(
            near_person & (area <= SMALL_AREA), pair(small * NEAR_FACTOR, NEAR_PADS[0])
        ).when(near_person, pair(medium * NEAR_FACTOR, NEAR_PADS[1]))
        .when(area <= SMALL_AREA, pair(small, PADS[0])).when(area <= MEDIUM_AREA, pair(small, PADS[1])).otherwise(pair(medium, PADS[2]))
    )


def attempts(effective: Column, severity: Column, face: Column, area: Column, near_person: Column) -> Column:
    """Parameters of up to three attempts: array of struct strength, guidance, steps, feather."""

    def plan(kind: str, base: Column, factors: str, feather: Column) -> Column:
        most, guidance, steps = SCHEDULES[kind]
        one = lambda i, m: F.struct(
            F.least(F.lit(most), base * m).alias("strength"), F.lit(guidance + 0.5 * i).alias("guidance"),
            F.lit(steps + 4 * i).alias("steps"), feather.cast("int").alias("feather")
        )
        return F.array(*[one(i, m) for i, m in enumerate(FACTORS[factors])])

    soft, light = F.when(
        face, STRENGTHS["attribute_change_face"]
    ).otherwise(STRENGTHS["attribute_change"]), F.when(face, FEATHERS["face"]).otherwise(FEATHERS["attribute_change"])
    change = lambda factors: plan("attribute_change", soft, factors, light)
    fresh = lambda op: plan("fresh", F.lit(STRENGTHS[op]), "fresh", F.lit(FEATHERS["fresh"]))
    none = F.array().cast("array<struct<strength:double,guidance:double,steps:int,feather:int>>")
    changed = F.when(severity == "low", change("low")).when(severity == "medium", change("medium")).otherwise(change("high"))
    swapped = plan("replace", replace_strength(area, near_person)["strength"], "replace", F.lit(FEATHERS["replace"]))
    return F.when(
        effective == "attribute_change", changed
    ).when(effective == "fill", fresh("fill")).when(effective == "insert", fresh("insert")).when(effective == "replace", swapped).otherwise(none)


def fallback_allowed(area: Column, meta: Column) -> Column:
    """Whether a failed removal may be filled instead."""
    return (area <= FALLBACK_AREA) & ~(meta["person_like"] & ~meta["safe_remove"] & (area > FALLBACK_PERSON_AREA))


def is_visible(severity: Column, mean_delta: Column, changed: Column) -> Column:
    floor = lambda table, other: F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), severity), F.lit(other)
    )
    return (mean_delta >= floor(DELTA_FLOOR, 4.0)) & (changed >= floor(CHANGED_FLOOR, 0.01))


def job_seed(*parts: Column) -> Column:
    """The first 32 bits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def outcome(effective: Column, error: Column, visible: Column, realism: Column, least: float = REALISM) -> Column:
    """Struct accepted and reject_reason of an executed job; a missing realism score passes."""
    score = F.coalesce(realism, F.lit(1.0))
    reason = F.when(
        F.coalesce(error, F.lit("")) != "", "error"
    ).when(effective == "skip", "skipped").when(~visible, "edit_not_visible").when(score < least, "low_realism")
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reject_reason"))


def output_name(
    sample: Column, anchor: Column, requested: Column, effective: Column, severity: Column, index: Column,
    suffix: str = "", folder: str = ""
) -> Column:
    """Path of an edited image below the images' root."""
    clean = lambda c: F.replace(F.trim(F.lower(F.when(c != "", c).otherwise("unknown"))), F.lit(" "), F.lit("_"))
    name = F.concat(
        anchor, F.lit("_req-"), clean(requested), F.lit("_eff-"), clean(effective), F.lit("_"), severity,
        F.lit("_"), index.cast("string"), F.lit(f"{suffix}.png")
    )
    return F.concat(sample, F.lit(f"/{folder}"), name)


def reject_name(sample: Column, anchor: Column, requested: Column, effective: Column, severity: Column, index: Column) -> Column:
    """Path of an image that was edited and refused."""
    return output_name(sample, anchor, requested, effective, severity, index, folder="rejects/")


def result_rows(done: DataFrame) -> DataFrame:
    """The 29 columns of edit results, from jobs with what their execution recorded; columns that done lacks are null."""
    given = lambda n: F.col(n) if n in done.columns else F.lit(None).cast("string")
    worded = F.coalesce(given("rewritten_caption"), F.lit("")) != ""
    made = {"duration_s": F.bround(given("duration_s").cast("double"), 3), "modality": F.when(worded, "image_text").otherwise("image_only")}
    return done.select(*[made.get(n, given(n)).alias(n) for n in RESULT])
