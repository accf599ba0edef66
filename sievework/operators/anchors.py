"""Anchors of images: cleaning of extracted ones, flattening of manifests, detections, candidates and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import geometry, scoring, text
from sievework.functions.coerce import STRINGS, clean_string_list, distinct_by, let, nonempty, rooted, safe_str
from sievework.operators import gates, relational

RELATION = "array<struct<type:string,target_anchor_id:string>>"
ANCHOR = (
    "anchor_id string, span string, semantic_tags_raw array<string>, semantic_tags array<string>, functional_role string, localization struct<level:string,region_hint:string>, attributes array<string>, "
    f"relations {RELATION}, visibility string, salience string, confidence string"
)


def _allowed(c: Column, values: list[str], default: str) -> Column:
    return F.when(c.isin(values), c).otherwise(let(F.lower(text.squeeze(c)), lambda t: F.when(t.isin(values), t).otherwise(default)))


def sanitized(a: Column, i: Column) -> Column:
    """A cleaned anchor, numbered by place, with its old name and normal span; null if its span is generic."""
    named = lambda c, default: F.coalesce(let(text.squeeze(c), nonempty), default)
    clean = lambda tags, span: F.struct(
        named(a["anchor_id"], F.concat(F.lit("a"), (i + 1).cast("string"))).alias("old_id"),
        span.alias("normal"),
        text.squeeze(a["span"]).alias("span"),
        tags["raw"].alias("semantic_tags_raw"),
        tags["tags"].alias("semantic_tags"),
        text.functional_role(a["functional_role"], a["span"], tags["tags"]).alias("functional_role"),
        F.struct(
            named(a["localization"]["level"], F.lit("object")).alias("level"),
            _allowed(a["localization"]["region_hint"], text.REGION_HINTS, "center").alias("region_hint")
        ).alias("localization"),
        clean_string_list(a["attributes"]).alias("attributes"), F.coalesce(a["relations"], F.array().cast(RELATION)).alias("relations"),
        _allowed(a["visibility"], text.VISIBILITIES, "partial").alias("visibility"),
        _allowed(a["salience"], text.LEVELS, "medium").alias("salience"),
        _allowed(a["confidence"], text.LEVELS, "medium").alias("confidence"),
    )
    tagged = lambda span: let(text.semantic_tags(a["semantic_tags_raw"], a["semantic_tags"], a["span"]), lambda tags: clean(tags, span))
    return let(text.normal_span(a["span"]), lambda span: F.when(~text.generic(span), tagged(span)))


def postprocessed(anchors: Column) -> Column:
    """Cleaned anchors, the first of each span, renumbered a1, a2, ...; relations follow the new numbers.
    A relation to an anchor that went keeps its name, and so may meet a renumbered one: as in the data this reads."""
    kept = distinct_by(F.filter(F.transform(anchors, sanitized), lambda a: a.isNotNull()), lambda a: a["normal"])
    numbered = F.transform(kept, lambda a, i: a.withField("anchor_id", F.concat(F.lit("a"), (i + 1).cast("string"))))

    def related(all_: Column) -> Column:
        return let(F.transform(all_, lambda a: a["anchor_id"]), lambda ids: moved_all(all_, ids))

    def moved_all(all_: Column, ids: Column) -> Column:
        # of equal old names the last counts
        renamed = lambda t: F.coalesce(
            F.try_element_at(F.transform(F.filter(all_, lambda b: b["old_id"] == t), lambda b: b["anchor_id"]), F.lit(-1)),
            t
        )
        moved = lambda a: F.transform(
            a["relations"],
            lambda r: F.struct(r["type"].alias("type"), renamed(r["target_anchor_id"]).alias("target_anchor_id"))
        )
        same = lambda a, names: [a[n].alias(n) for n in names]
        return F.transform(
            all_,
            lambda a: F.struct(
                *same(a, ("anchor_id", "span", "semantic_tags_raw", "semantic_tags", "functional_role", "localization", "attributes")),
                text.relations(moved(a), ids).alias("relations"),
                *same(a, ("visibility", "salience", "confidence"))
            )
        )

    return let(numbered, related)


def _made(span: Column, tag: Column, role: Column, visibility: str) -> Column:
    return F.struct(
        F.lit("").alias("anchor_id"),
        text.squeeze(span).alias("span"),
        F.array(tag).alias("semantic_tags_raw"),
        F.array(tag).alias("semantic_tags"),
        role.alias("functional_role"),
        F.struct(F.lit("object").alias("level"), F.lit("center").alias("region_hint")).alias("localization"),
        F.array().cast(STRINGS).alias("attributes"),
        F.array().cast(RELATION).alias("relations"),
        F.lit(visibility).alias("visibility"),
        F.lit("medium").alias("salience"),
        F.lit("medium").alias("confidence"),
    )


def _fresh(spans: Column, known: Column) -> Column:
    """Distinct spans that aren't generic and aren't known."""
    return F.transform(_new(spans, lambda s: s, known), lambda p: p["x"])


def _new(items: Column, span, known: Column | None = None) -> Column:
    """Structs of the normal span t and the item x: of items whose span isn't generic nor known, the first of each span."""
    fresh = lambda t, held: ~text.generic(t) if held is None else ~text.generic(t) & ~F.array_contains(held, t)
    paired = F.transform(items, lambda x: F.struct(text.normal_span(span(x)).alias("t"), x.alias("x")))
    of = lambda held: distinct_by(F.filter(paired, lambda p: fresh(p["t"], held)), lambda p: p["t"])
    return of(None) if known is None else let(known, of)


def _spans(anchors: Column) -> Column:
    return F.transform(anchors, lambda a: text.normal_span(a["span"]))


def with_visible_text(anchors: Column, items: Column, visible: Column) -> Column:
    """Anchors and those of visible texts that no span names yet."""
    units = let(clean_string_list(items), lambda given: F.when(F.size(given) > 0, given).otherwise(text.visible_units(visible)))
    more = F.transform(_fresh(units, _spans(anchors)), lambda s: _made(s, F.lit("sign_text"), F.lit("text element"), "full"))
    return postprocessed(F.concat(anchors, more))


def without_weak(anchors: Column, supported: list[Column], visible: Column) -> Column:
    """Anchors without the small, unsure ones that no list of the caption names."""
    named = F.transform(F.concat(*[clean_string_list(c) for c in supported], text.visible_units(visible)), text.normal_span)
    return postprocessed(
        let(
            named,
            lambda known: F.filter(
                anchors,
                lambda a: ~text.is_weak(a["visibility"], a["confidence"]) | F.array_contains(known, text.normal_span(a["span"]))
            )
        )
    )


def with_missed(anchors: Column, missed: Column) -> Column:
    """Anchors and the missed ones of new spans. missed: array of the anchors' struct."""
    fresh = F.transform(
        _new(missed, lambda m: m["span"], _spans(anchors)),
        lambda p: p["x"].withField("relations", F.array().cast(RELATION)).withField("anchor_id", F.lit(""))
    )
    return postprocessed(F.concat(anchors, fresh))


def from_caption(notable: Column, candidates: Column, regions: Column, items: Column, visible: Column) -> Column:
    """Anchors made of a caption's lists, in order, up to 8, 10, 12 and 14 in all after the notable ones."""
    tagged = lambda spans, most, role: F.transform(
        F.coalesce(spans, F.array().cast(STRINGS)),
        lambda s: F.struct(s.alias("s"), F.lit(most).alias("most"), F.lit(role).alias("role"))
    )
    scene, writing = "visible scene element", "text element"
    rows = F.concat(
        tagged(notable, 1 << 30, scene), tagged(candidates, 8, scene), tagged(regions, 10, "scene region"),
        tagged(items, 12, writing), tagged(text.visible_units(visible), 14, writing)
    )
    usable = F.transform(_new(rows, lambda r: r["s"]), lambda p: p["x"])
    taken = let(
        usable,
        lambda u: F.aggregate(u, F.slice(u, 1, 0), lambda acc, r: F.when(F.size(acc) < r["most"], F.concat(acc, F.array(r))).otherwise(acc))
    )
    return postprocessed(F.transform(taken, lambda r: _made(r["s"], text.span_tag(r["s"]), r["role"], "partial")))


def payload_errors(anchors: Column, least: int = 1) -> Column:
    """Codes of what is wrong with extracted anchors."""
    ids = F.transform(anchors, lambda a: a["anchor_id"])
    return gates.reasons(
        (anchors.isNull(), "anchors_not_a_list"),
        (F.size(anchors) < least, "too_few_anchors"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_anchor_ids"),
        (F.exists(anchors, lambda a: safe_str(a["anchor_id"]) == ""), "missing_anchor_id"),
        (F.exists(anchors, lambda a: safe_str(a["span"]) == ""), "missing_span"),
    )


def flattened(manifests: DataFrame, root: str = "") -> DataFrame:
    """One row of 31 columns for each anchor of a manifest (schema in FIXTURES), with its validity and duplicate group."""
    rows = manifests.select(
        "sample_id", "image_path", "headline", "summary",
        F.col("caption.image_caption_literal").alias("literal_caption"),
        F.col("anchors_meta.grounded_context_caption").alias("grounded_context_caption"), "relations",
        F.posexplode("anchors").alias("pos", "a")
    ).where("a is not null")
    a = F.col("a")
    named = F.coalesce(
        nonempty(safe_str(a["anchor_text"])),
        safe_str(a["span"]) if "span" in manifests.schema["anchors"].dataType.elementType.names else F.lit("")
    )
    area = a["union_mask_stats"]["width"] * a["union_mask_stats"]["height"]
    det, low = a["best_detection"], lambda c: F.lower(F.trim(safe_str(c)))
    ratio = F.when(area > 0, a["union_mask_stats"]["foreground_area_px"] / area)
    flat = rows.select(
        *[safe_str(F.col(c)).alias(c) for c in ("sample_id", "image_path", "headline", "summary", "literal_caption", "grounded_context_caption")],
        "pos",
        F.coalesce(nonempty(safe_str(a["anchor_id"])), F.concat(F.lit("a"), (F.col("pos") + 1).cast("string"))).alias("anchor_id"),
        named.alias("anchor_text"),
        F.coalesce(nonempty(low(a["anchor_norm"])), low(named)).alias("anchor_norm"),
        F.lower(safe_str(a["category"])).alias("category"),
        F.coalesce(a["semantic_tags"], F.array().cast(STRINGS)).alias("semantic_tags"),
        *[safe_str(a[c]).alias(c) for c in ("functional_role", "attributes_text", "status", "grounding_status")],
        rooted(a["union_mask_path"], root).alias("union_mask_path"),
        a["union_mask_stats"]["foreground_area_px"].alias("mask_area_px"),
        F.when(area > 0, area).alias("image_area_px"),
        ratio.alias("mask_ratio"),
        scoring.size_band(ratio).alias("size_band"),
        det["box_xyxy"].alias("bbox_xyxy"),
        det["score"].alias("grounding_score"),
        det["precision_score"].alias("precision_score"),
        det["qwen_verify_score"].alias("qwen_verify_score"),
        F.coalesce(F.size(a["detections"]), F.lit(0)).alias("num_detections"), "relations",
    )
    counted = flat.withColumn("relation_count", relational.relation_count(F.col("relations"), F.col("anchor_id"))).drop("relations")
    reason = gates.technical_reason(
        *[F.col(c) for c in ("status", "grounding_status", "union_mask_path", "mask_ratio", "grounding_score", "qwen_verify_score", "anchor_text")]
    )
    judged = counted.withColumn("technical_reject_reason", reason).withColumn("technical_valid", F.col("technical_reject_reason").isNull())
    group = F.concat_ws("::", "sample_id", "anchor_norm", F.coalesce("union_mask_path", F.lit("NO_MASK")))
    return judged.withColumns({"dedup_group": group, "is_duplicate": F.lit(False), "keep_for_step2": F.col("technical_valid")})


def editable(manifests: DataFrame, root: str = "") -> DataFrame:
    """flattened() with duplicates marked: by grounding, verification and area, then place."""
    return relational.mark_duplicates(
        flattened(manifests, root), "dedup_group", ["grounding_score", "qwen_verify_score", "mask_area_px"],
        "pos"
    ).drop("pos")


def built_manifests(extracted: DataFrame, segmented: DataFrame) -> DataFrame:
    """Manifests of segmented documents joined to their extraction records on id."""
    s = segmented.select(
        F.col("id").alias("sample_id"), "image_path", "headline", "summary", "grounded_context_caption",
        "anchors", F.col("relation_anchors").alias("relations")
    )
    e = extracted.select(F.col("id").alias("sample_id"), "caption", "context")
    best = lambda ds: F.get(relational.best_k(ds, [("score", True)], 1), F.lit(0))
    with_best = F.transform("anchors", lambda a: a.withField("best_detection", best(a["detections"])))
    return s.join(e, "sample_id", "left").withColumn("anchors", with_best).withColumn(
        "anchors_meta", F.struct(F.col("grounded_context_caption").alias("grounded_context_caption"))
    ).drop("grounded_context_caption")


def selected_detections(
    anchors: DataFrame, detections: DataFrame, mode: str = "high", limit: float = 0.7, one: int = 1,
    many: int = 4, keep_bad: bool = False
) -> DataFrame:
    """Detections chosen for each anchor: its queries' recorded boxes, checked, suppressed and cut to its limit.
    anchors: sample_id, anchor_id, phrase, category, multi, width, height. detections: sample_id, query, box, score.
    With verify_match and verify_score recorded, only matches stay, the surest first. keep_bad: an anchor whose boxes
    are all refused keeps its best one."""
    asked = anchors.select("*", F.posexplode(text.candidate_queries(F.col("phrase"), F.col("category"))).alias("query_rank", "query"))
    found = asked.join(detections, ["sample_id", "query"])
    checked = found.withColumn(
        "eval",
        geometry.evaluated(F.col("box"), F.col("score"), F.col("category"), F.col("multi"), F.col("width"), F.col("height"), mode)
    ).select("*", "eval.*").drop("eval")
    keys = ["sample_id", "anchor_id"]
    w = W.partitionBy(*keys)
    best = w.orderBy(F.desc("precision_score"), F.desc("score"), "query_rank")
    passed = F.size("rejection_reasons") == 0
    flagged = checked.withColumns({"accepted": passed, "_any": F.bool_or(passed).over(w), "_first": F.row_number().over(best) == 1})
    pool = flagged.where(F.col("accepted") | (F.lit(keep_bad) & ~F.col("_any") & F.col("_first"))).drop("_any", "_first")
    kept = geometry.nms(pool, keys, "box", "precision_score", limit, ["query_rank", "box"])
    allowed = text.query_limit(F.col("category"), F.col("multi"), one, many)
    ranked = kept.withColumns({"limit": allowed, "_n": F.row_number().over(best)}).where(F.col("_n") <= 3 * F.col("limit"))
    if "verify_match" in detections.columns:
        ranked = ranked.where("verify_match").withColumn(
            "_n",
            F.row_number().over(w.orderBy(F.desc("verify_score"), F.desc("precision_score"), F.desc("score"), "query_rank"))
        )
    return ranked.where(F.col("_n") <= F.col("limit")).drop("_n", "limit")


def planning_context(anchors: DataFrame, manifests: DataFrame, bank: dict[str, list[str]] | None = None) -> DataFrame:
    """Anchors with headline and summary of their manifest, tier, proxies and allowed operations; early status or null."""
    m = manifests.select("sample_id", F.col("headline").alias("_h"), F.col("summary").alias("_s"))
    rows = anchors.drop("headline", "summary").join(m, "sample_id", "left").withColumnsRenamed({"_h": "headline", "_s": "summary"})
    c = F.col
    ratio = F.coalesce(c("mask_ratio"), F.lit(0.0))
    tier = scoring.object_tier(c("anchor_text"), c("category"), bank)
    terms = scoring.salience_terms(
        F.coalesce(c("relation_count"), F.lit(0)), ratio, c("category"), safe_str(c("headline")),
        safe_str(c("summary")), c("anchor_text")
    )
    out = rows.withColumns(
        {
            "_t": tier, "salience_terms": terms,
            "visibility_proxy": scoring.visibility_proxy(ratio, c("grounding_score")),
            "allowed_operations": scoring.allowed_operations(c("category"), c("anchor_text"), ratio)
        }
    )
    out = out.withColumns(
        {"tier_name": c("_t.tier"), "tier_prior": c("_t.prior"), "tier_reason": c("_t.reason"), "salience_proxy": c("salience_terms.proxy")}
    ).drop("_t")
    early = F.when(c("salience_proxy") < scoring.LEAST_SALIENCE, "skipped_low_salience").when(
        (safe_str(c("union_mask_path")) == "") & c("bbox_xyxy").isNull(), "skipped_no_mask"
    ).when(safe_str(c("image_path")) == "", "missing_image")
    return out.withColumn("early_status", early)


CANDIDATE_FIELDS = (
    "operation", "edited_anchor", "edit_instruction", "semantic_shift", "role_shift",
    "contradiction_potential", "public_impact", "realism", "localizability"
)


def scored_candidates(rows: DataFrame) -> DataFrame:
    """Candidates by job and severity, scored, each fingerprint once (low first), best first, with ordering warnings.
    rows: sample_id, anchor_id, severity, pos, candidate struct, tier_prior, salience_proxy, visibility_proxy, centrality,
    editability, visible, apparent_size."""
    c, keys = F.col, ["sample_id", "anchor_id"]
    rank = scoring.severity_rank(c("severity"))
    cand = lambda f: c(f"candidate.{f}")
    once = relational.dedupe_across(
        rows.where(rank >= 0), keys,
        text.fingerprint(cand("operation"), cand("edited_anchor"), safe_str(cand("edit_instruction"))), rank,
        "pos"
    )
    mixed = once.withColumn(
        "_b",
        scoring.blended(c("salience_proxy"), c("visibility_proxy"), c("centrality"), c("editability"), c("visible"), safe_str(c("apparent_size")))
    )
    delta = scoring.semantic_shift(cand("semantic_shift"), cand("role_shift"), cand("public_impact"))
    raw = scoring.planned_score(c("tier_prior"), delta, cand("contradiction_potential"), c("_b.salience"), c("_b.visibility"), c("_b.salience"))
    four = lambda x: F.bround(x, 4)
    scored = mixed.withColumns({
        "delta_sem_plan": four(delta),
        "planned_score_raw": four(raw),
        "planned_bucket": scoring.bucket(raw, scoring.PLAN_BUCKETS),
        "planner_confidence": four(scoring.confidence(cand("realism"), cand("localizability"), c("editability"))),
        "blended_salience": four(c("_b.salience")), "blended_visibility": four(c("_b.visibility")),
    }).drop("_b")
    place = F.row_number().over(W.partitionBy(*keys, "severity").orderBy(F.desc("planned_score_raw"), F.desc("planner_confidence"), "pos")) - 1
    ordered = scored.withColumn("candidate_index", place)
    best = relational.ordering_warnings(
        ordered.where("candidate_index = 0").select(*keys, "severity", rank.alias("_rank"), "planned_score_raw"),
        keys, "_rank", "planned_score_raw", scoring.TIER_GAP
    )
    return ordered.join(best.select(*keys, "severity", "tier_ordering_warning"), [*keys, "severity"])


def edit_jobs(candidates: DataFrame, most: int = 2) -> DataFrame:
    """Jobs of a plan's candidates: the first of each edited anchor, of a score that its severity needs, at most `most`
    of a severity, numbered from 0; raw_index keeps the place among all. candidates: sample_id, anchor_id, severity, pos,
    operation, edited_anchor, edit_instruction, planned_score_raw, mask_ratio, occlusion."""
    c, keys = F.col, ["sample_id", "anchor_id", "severity"]
    first = F.row_number().over(W.partitionBy(*keys, F.trim(F.lower(safe_str(c("edited_anchor"))))).orderBy("pos")) == 1
    occluded = F.lower(safe_str(c("occlusion"))).rlike("covered|occluded|hidden|partial")
    floor = F.when(c("severity") == "low", 0.20).when(c("severity") == "medium", 0.15).otherwise(0.0)
    usable = candidates.where(scoring.severity_rank(c("severity")) >= 0).withColumn("_first", first).where("_first").drop("_first")
    usable = usable.where(
        (F.coalesce(c("planned_score_raw"), F.lit(0.0)) >= floor) & ~(
            (c("severity") == "low") & occluded & (F.coalesce(c("mask_ratio"), F.lit(1.0)) > 0.15)
        )
    )
    numbered = usable.withColumn("candidate_index", F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1).where(c("candidate_index") < most)
    return numbered.withColumns(
        {
            "fill_clause": text.fill_clause(safe_str(c("edit_instruction")), any_case=False),
            "visual_prompt": text.visual_clause(safe_str(c("edit_instruction")))
        }
    ).withColumnRenamed("pos", "raw_index")


