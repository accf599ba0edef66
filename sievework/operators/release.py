"""Release build: results, plans, anchors and manifests become kept and quarantined examples, balanced, split and counted."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scoring, text
from sievework.functions.coerce import clamp, distinct_by, first_nonempty, let, nonempty, safe_str
from sievework.operators import gates, relational

# Modalities, and how a made headline names the edited anchor.
SYNTHETIC = {"remove": " without ", "attribute_change": " after change to ", "replace": " featuring "}
MODALITIES = ["pristine", "image_only", "text_only", "image_text"]


@dataclass(frozen=True)
class BuildConfig:
    require_accepted: bool = False
    realism_min: float = 0.35
    changed_min: float = 0.0025
    changed_max: float = 0.95
    delta_min: float = 1.5
    exclude_sensitive: bool = True
    require_valid: bool = False
    text_min: int = 3
    text_max: int = 80
    lexical_min: float = 0.01
    cross_mode: bool = True
    joint_as_text: bool = False
    synthesize: bool = False
    visual_confidence: float = 0.85
    hard_reject: bool = False
    balance: bool = False
    balance_kinds: bool = False
    max_pristine: int | None = None
    seed: int = 13
    splits: tuple = (0.8, 0.1, 0.1)
    model: scoring.SeverityModel = field(default_factory=scoring.SeverityModel)


def modality(c: Column) -> Column:
    m = text.words_only(c)
    return F.when(m.isin(MODALITIES), m).when(m == "imagetext", "image_text").otherwise("image_only")


def pair_id(
    sample: Column, anchor: Column, kind: Column, requested: Column, effective: Column, asked: Column,
    final: Column, index: Column, headline: Column, image: Column
) -> Column:
    """A readable id with ten digits of the SHA-1 of all ten fields."""
    seed = F.concat_ws("|", sample, anchor, kind, requested, effective, asked, final, index.cast("string"), text.squeeze(headline), image)
    named = lambda *cs: first_nonempty(cs)
    return F.concat_ws(
        "__", sample, anchor, kind, named(effective, requested, F.lit("unknown")), named(asked, F.lit("na")),
        named(final, F.lit("na")), index.cast("string"), F.substring(relational.stable_hash(seed), 1, 10)
    )


def original(manifest: Column, plan: Column) -> Column:
    return first_nonempty([safe_str(manifest), safe_str(plan)])


def payload(rewrites: Column, mode: str) -> Column:
    """A mode's rewrite; fields that it lacks come from its raw JSON text. rewrites: map of struct with rewritten_headline,
    text_edit_operation, nli_direction, rewrite_rationale, error, raw_rewrite_output."""
    fields = ("rewritten_headline", "text_edit_operation", "nli_direction", "rewrite_rationale", "error")
    spoken = lambda raw: F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))
    value = lambda x, f: F.coalesce(x["p"][f], F.try_variant_get(x["v"], f"$.{f}", "string"), F.lit(""))
    both = let(F.try_element_at(rewrites, F.lit(mode)), lambda p: F.struct(p.alias("p"), spoken(p["raw_rewrite_output"]).alias("v")))
    return let(both, lambda x: F.when(x["p"].isNotNull(), F.struct(*[value(x, f).alias(f) for f in fields])))


def _usable(rewrites: Column, mode: str, source: str) -> Column:
    """A mode's rewrite with its source, if it has a headline."""
    return let(payload(rewrites, mode), lambda p: F.when(p["rewritten_headline"] != "", p.withField("source", F.lit(source))))


def rewrite(rewrites: Column, preferred: str, cross: bool = True) -> Column:
    """Struct of the preferred mode's rewrite, else the other mode's, with its source; null where neither has a headline."""
    other = {"joint": "text_only", "text_only": "joint"}[preferred]
    own = _usable(rewrites, preferred, preferred)
    return F.coalesce(own, _usable(rewrites, other, f"{other}_fallback")) if cross else own


def synthesized(headline: Column, candidate: Column) -> Column:
    """A headline made from the original and a candidate, where a build asks for it; empty without an original."""
    base, op = text.squeeze(headline), text.words_only(safe_str(candidate["operation"]))
    anchor, said = text.squeeze(safe_str(candidate["edited_anchor"])), text.squeeze(safe_str(candidate["edit_instruction"]))
    link = reduce(lambda w, kv: w.when(op == kv[0], kv[1]), SYNTHETIC.items(), F.when(F.lit(False), "")).otherwise(" involving ")
    return F.when(base == "", "").when(anchor != "", F.concat(base, link, anchor)).when(said != "", F.concat(base, F.lit(": "), said)).otherwise("")


def variants(rewrites: Column, cfg: BuildConfig, headline: Column | None = None, candidate: Column | None = None) -> Column:
    """Text-only rewrites of a candidate, each headline once; without one a made one, if asked for; else one empty variant."""
    joint = [_usable(rewrites, "joint", "joint_as_text_only")] if cfg.joint_as_text else []
    found = F.array_compact(F.array(rewrite(rewrites, "text_only", cfg.cross_mode), *joint))
    none = F.struct(
        *[F.lit("").alias(f) for f in ("rewritten_headline", "text_edit_operation", "nli_direction", "rewrite_rationale", "error")],
        F.lit("missing").alias("source")
    )
    once = distinct_by(found, lambda v: text.words_only(v["rewritten_headline"]))
    instead = none
    if cfg.synthesize and headline is not None:
        made = none.withField("text_edit_operation", safe_str(candidate["operation"])).withField(
            "rewrite_rationale", F.lit("synthetic_fallback_from_builder")
        ).withField("source", F.lit("synthetic"))
        instead = let(synthesized(headline, candidate), lambda h: F.when(h != "", made.withField("rewritten_headline", h)).otherwise(none))
    return let(once, lambda o: F.when(F.size(o) > 0, o).otherwise(F.array(instead)))


def components(candidate: Column, plan: Column, tier: Column, direction: Column, model: scoring.SeverityModel) -> Column:
    """Struct T_obj, I_ctx, C_nli, Sal, Vis; zeros are derived anew. plan: struct of tier_prior, proxy_tier_prior,
    tier_name, salience_proxy, visibility_proxy, blended_salience, blended_visibility, has_proxies."""
    name = text.words_only(first_nonempty([safe_str(tier), safe_str(plan["tier_name"])]))
    given = clamp(candidate["delta_sem_plan"])
    shift = F.when(
        given == 0.0,
        scoring.semantic_shift(candidate["semantic_shift"], candidate["role_shift"], candidate["public_impact"])
    ).otherwise(given)
    proxied = F.coalesce(plan["has_proxies"], F.lit(False))
    return F.struct(
        scoring.tier_prior(plan["tier_prior"], plan["proxy_tier_prior"], name, model.priors).alias("T_obj"),
        shift.alias("I_ctx"),
        scoring.contradiction(candidate["contradiction_potential"], direction).alias("C_nli"),
        clamp(F.when(proxied, plan["blended_salience"]).otherwise(plan["salience_proxy"])).alias("Sal"),
        clamp(F.when(proxied, plan["blended_visibility"]).otherwise(plan["visibility_proxy"])).alias("Vis"),
    )


def _scored(rows: DataFrame, cfg: BuildConfig) -> DataFrame:
    """rows with parts (components) get raw, score and severity_label."""
    m, p = cfg.model, F.col("parts")
    raw = scoring.severity_score(p["T_obj"], p["I_ctx"], p["C_nli"], p["Sal"], p["Vis"], m.weights)
    scored = rows.withColumn("severity_score_raw", raw).withColumn("severity_score", scoring.calibrated(F.col("severity_score_raw"), m.calibration))
    return scored.withColumn("severity_label", scoring.bucket(F.col("severity_score"), (m.low_max, m.medium_max)))


def _finished(rows: DataFrame, cfg: BuildConfig) -> DataFrame:
    """Adds the last gate, joins reasons and rounds scores."""
    floor = [] if cfg.model.none_max is None else [(F.col("severity_score") < cfg.model.none_max, "severity_below_meaningful_impact")]
    why = F.concat(F.col("_reasons"), gates.reasons(*floor)) if floor else F.col("_reasons")
    six = lambda c: F.bround(c, 6)
    out = rows.withColumn("filter_reason", gates.filter_reason(why)).withColumns({c: six(F.col(c)) for c in ("severity_score_raw", "severity_score")})
    return out.withColumn(
        "severity_components",
        F.struct(*[six(F.col(f"parts.{k}")).alias(k) for k in ("T_obj", "I_ctx", "C_nli", "Sal", "Vis")])
    ).drop("_reasons", "parts")


def edited_examples(looked_up: DataFrame, images: DataFrame | None, cfg: BuildConfig) -> DataFrame:
    """Examples of executed edits, with filter_reason. looked_up: relational.lookups() of results; plans have candidates
    (map of severity to array of candidate structs), sensitive and the fields that components() reads.
    images: origin, image_reason, visual_reasons of edited images, null reasons for good ones."""
    c = F.col
    rows = looked_up.withColumn("candidate_index", F.coalesce(c("candidate_index").cast("int"), F.lit(0)))
    rows = rows.withColumns({
        "kind": modality(c("modality")), "candidate": F.get(F.try_element_at(c("plan.candidates"), safe_str(c("severity"))), c("candidate_index")),
        "headline_original": original(c("manifest.headline"), c("plan.headline")),
        "summary_original": original(c("manifest.summary"), c("plan.summary")),
        "image_edited": first_nonempty([safe_str(c("output_path")), safe_str(c("image_path"))]),
    })
    rows = rows.withColumn("_rw", rewrite(c("candidate.headline_rewrite"), "joint", cfg.cross_mode))
    made = [F.when(c("kind") == "image_text", synthesized(c("headline_original"), c("candidate"))).otherwise("")] if cfg.synthesize else []
    rows = rows.withColumn(
        "_said",
        first_nonempty([safe_str(c("rewritten_caption")), safe_str(c("_rw.rewritten_headline")), *made, c("headline_original")])
    )
    if images is not None:
        rows = rows.join(images.select(c("origin").alias("image_edited"), "image_reason", "visual_reasons"), "image_edited", "left")
    else:
        rows = rows.withColumns({"image_reason": F.lit(None).cast("string"), "visual_reasons": F.lit(None).cast("array<string>")})
    worded = c("kind").isin("text_only", "image_text")
    said = gates.text_reason(c("_said"), c("headline_original"), cfg.text_min, cfg.text_max, cfg.lexical_min)
    own = gates.text_reason(c("headline_original"), None, cfg.text_min, cfg.text_max)
    row = {n: c(n) for n in ("masked_changed_ratio", "masked_mean_delta", "accepted", "error", "realism_score")} | {
        "sensitive": c("plan.sensitive"), "anchor_valid": c("anchor.technical_valid"),
        "anchor_reason": c("anchor.technical_reject_reason")
    }
    seen = F.coalesce(c("visual_reasons"), F.array().cast("array<string>"))
    visual = F.transform(seen, lambda r: F.concat(F.lit("visual:"), F.substring(text.words_only(r), 1, 64)))
    pictured = c("kind").isin("image_only", "image_text")
    rules = [
        *gates.edit_reasons(row, cfg), (c("image_reason").isNotNull(), c("image_reason")),
        (pictured & (F.size(seen) > 0), "visual_defect_detected")
    ]
    worded_rules = [(worded, gates.broken(said)), (~worded, F.concat(F.lit("orig_"), gates.broken(own)))]
    rows = rows.withColumn(
        "_reasons",
        F.concat(gates.reasons(*rules), F.when(pictured, visual).otherwise(F.array().cast("array<string>")), gates.reasons(*worded_rules))
    )
    rows = _scored(
        rows.withColumn(
            "parts",
            components(
                c("candidate"), c("plan"), c("tier"),
                first_nonempty([safe_str(c("nli_direction")), safe_str(c("_rw.nli_direction"))]), cfg.model
            )
        ),
        cfg
    )
    asked, effective = safe_str(c("requested_operation")), first_nonempty([safe_str(c("effective_operation")), safe_str(c("requested_operation"))])
    headline, image = F.when(worded, c("_said")).otherwise(c("headline_original")), F.when(pictured, c("image_edited")).otherwise(safe_str(c("image_path")))
    quality = F.struct(
        clamp(c("realism_score")).alias("realism_score"),
        F.bround(F.coalesce(c("masked_changed_ratio"), F.lit(0.0)), 6).alias("masked_changed_ratio"),
        F.bround(F.coalesce(c("masked_mean_delta"), F.lit(0.0)), 6).alias("masked_mean_delta")
    )
    return _finished(rows, cfg).select(
        pair_id(
            c("sample_id"), c("anchor_id"), c("kind"), asked, effective, safe_str(c("severity")),
            c("severity_label"), c("candidate_index"), headline, image
        ).alias("pair_id"),
        "sample_id",
        "anchor_id",
        F.lit("manipulated").alias("authenticity_label"),
        F.lit(False).alias("is_pristine"),
        c("kind").alias("modality"),
        "severity_label",
        "severity_score_raw",
        "severity_score",
        "severity_components",
        safe_str(c("severity")).alias("requested_generation_severity"),
        asked.alias("edit_type_requested"),
        effective.alias("edit_type_effective"),
        "headline_original",
        headline.alias("headline_edited"),
        "summary_original",
        c("summary_original").alias("summary_edited"),
        safe_str(c("image_path")).alias("image_original"),
        image.alias("image_edited"),
        explanation(
            c("candidate"), c("_rw"),
            {
                n: c(n) for n in (
                    "edited_anchor", "fill_clause", "edit_instruction", "route_reason", "text_edit_operation",
                    "nli_direction"
                ) if n in looked_up.columns
            }
        ).alias("explanation"),
        quality.alias("quality"),
        F.struct(
            c("manifest").isNotNull().alias("manifest_present"),
            c("anchor").isNotNull().alias("anchor_row_present"),
            c("plan").isNotNull().alias("planner_row_present"), F.lit(True).alias("edit_result_present"),
            F.coalesce(c("plan.sensitive"), F.lit(False)).alias("sensitive_flagged"),
            c("candidate_index").cast("int").alias("candidate_index")
        ).alias("provenance"),
        "filter_reason",
        *(["result_order"] if "result_order" in looked_up.columns else []),
    )


def explanation(candidate: Column, said: Column | None, row: dict[str, Column]) -> Column:
    """Eight fields of what was edited and why: of the result row first, then of candidate or rewrite."""
    own = lambda n: safe_str(row[n]) if n in row else F.lit("")
    told = lambda n: safe_str(said[n]) if said is not None else F.lit("")
    return F.struct(
        first_nonempty([own("edited_anchor"), safe_str(candidate["edited_anchor"])]).alias("edited_anchor"),
        own("fill_clause").alias("fill_clause"),
        first_nonempty([own("edit_instruction"), safe_str(candidate["edit_instruction"])]).alias("edit_instruction"),
        own("route_reason").alias("route_reason"),
        safe_str(candidate["rationale"]).alias("rationale"),
        told("rewrite_rationale").alias("rewrite_rationale"),
        first_nonempty([told("text_edit_operation"), own("text_edit_operation")]).alias("text_edit_operation"),
        first_nonempty([told("nli_direction"), own("nli_direction")]).alias("nli_direction"),
    )


def text_examples(plans: DataFrame, anchors: DataFrame, manifests: DataFrame, cfg: BuildConfig) -> DataFrame:
    """Examples of recorded text-only rewrites: every plan, severity, candidate and variant, with filter_reason."""
    c = F.col
    looked = plans.select("sample_id", "anchor_id", F.struct(*plans.columns).alias("plan"))
    pack = lambda df, keys, name: df.select(*keys, F.struct(*df.columns).alias(name))
    looked = looked.join(
        pack(anchors, ["sample_id", "anchor_id"], "anchor"), ["sample_id", "anchor_id"], "left"
    ).join(pack(manifests, ["sample_id"], "manifest"), "sample_id", "left")
    rows = looked.select("*", F.explode("plan.candidates").alias("severity", "_cs")).select(
        "*", F.posexplode("_cs").alias("candidate_index", "candidate")
    ).drop("_cs").where("candidate is not null")
    rows = rows.withColumn("headline_original", original(c("manifest.headline"), c("plan.headline")))
    rows = rows.select(
        "*",
        F.posexplode(variants(c("candidate.headline_rewrite"), cfg, c("headline_original"), c("candidate"))).alias("variant", "_rw")
    )
    rows = rows.withColumns(
        {
            "summary_original": original(c("manifest.summary"), c("plan.summary")),
            "image_original": first_nonempty([safe_str(c("plan.image_path")), safe_str(c("manifest.image_path"))]),
            "_said": c("_rw.rewritten_headline")
        }
    )
    said = gates.text_reason(c("_said"), c("headline_original"), cfg.text_min, cfg.text_max, cfg.lexical_min)
    invalid = F.concat(F.lit("anchor_invalid:"), F.coalesce(nonempty(safe_str(c("anchor.technical_reject_reason"))), F.lit("unknown")))
    why = gates.reasons(
        (c("_said") == "", "missing_text_only_rewrite"),
        (c("_rw.error") != "", "rewrite_error"),
        (F.lit(cfg.exclude_sensitive) & F.coalesce(c("plan.sensitive"), F.lit(False)), "sensitive_flagged"),
        (F.lit(cfg.require_valid) & (c("anchor.technical_valid") == F.lit(False)), invalid),
        (c("image_original") == "", "missing_image"),
        (F.lit(True), gates.broken(said)),
    )
    rows = _scored(
        rows.withColumn("_reasons", why).withColumn(
            "parts",
            components(c("candidate"), c("plan"), c("plan.tier_name"), c("_rw.nli_direction"), cfg.model)
        ),
        cfg
    )
    op = safe_str(c("candidate.operation"))
    return _finished(rows, cfg).select(
        pair_id(
            c("sample_id"), c("anchor_id"), F.lit("text_only"), op, op, c("severity"), c("severity_label"),
            c("candidate_index") * 10 + c("variant"), c("_said"), c("image_original")
        ).alias("pair_id"),
        "sample_id",
        "anchor_id",
        F.lit("manipulated").alias("authenticity_label"),
        F.lit(False).alias("is_pristine"),
        F.lit("text_only").alias("modality"),
        "severity_label",
        "severity_score_raw",
        "severity_score",
        "severity_components",
        c("severity").alias("requested_generation_severity"),
        op.alias("edit_type_requested"),
        op.alias("edit_type_effective"),
        "headline_original",
        first_nonempty([c("_said"), c("headline_original")]).alias("headline_edited"),
        "summary_original",
        c("summary_original").alias("summary_edited"),
        "image_original",
        c("image_original").alias("image_edited"),
        explanation(c("candidate"), c("_rw"), {}).alias("explanation"),
        F.struct(
            c("manifest").isNotNull().alias("manifest_present"),
            c("anchor").isNotNull().alias("anchor_row_present"), F.lit(True).alias("planner_row_present"),
            F.lit(False).alias("edit_result_present"),
            F.coalesce(c("plan.sensitive"), F.lit(False)).alias("sensitive_flagged"),
            c("candidate_index").cast("int").alias("candidate_index"),
            c("variant").alias("rewrite_variant_index"), c("_rw.source").alias("rewrite_source")
        ).alias("provenance"),
        "filter_reason",
    )


def pristine_examples(manifests: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Manifests whose image and text pass. images: origin and image_reason."""
    c = F.col
    said = first_nonempty([safe_str(c("headline")), safe_str(c("summary")), safe_str(c("caption.image_caption_literal"))])
    rows = manifests.where(gates.text_reason(said) == "ok")
    if images is not None:
        rows = rows.join(images.where("image_reason is null").select(c("origin").alias("image_path")), "image_path", "left_semi")
    h, s, i = safe_str(c("headline")), safe_str(c("summary")), safe_str(c("image_path"))
    return rows.select(
        F.concat("sample_id", F.lit("__pristine")).alias("pair_id"),
        "sample_id",
        F.lit("pristine").alias("authenticity_label"),
        F.lit(True).alias("is_pristine"),
        F.lit("pristine").alias("modality"),
        h.alias("headline_original"),
        h.alias("headline_edited"),
        s.alias("summary_original"),
        s.alias("summary_edited"),
        i.alias("image_original"),
        i.alias("image_edited"),
        F.lit("passed").alias("filter_reason"),
    )


def release(
    pristine: DataFrame, edited: DataFrame, texts: DataFrame, cfg: BuildConfig,
    order: tuple = ("result_order",)
) -> tuple[DataFrame, DataFrame]:
    """(examples and quarantine, both with split): unions, the best of each id, optional balance and cap. Of equal scores
    the first counts: edited images before texts, then by order (columns of edited, where it has them; else all columns)."""
    score = F.coalesce(F.col("quality.realism_score"), F.lit(0.0)) if "quality" in edited.columns else F.lit(0.0)
    numbered = lambda df, n: df.withColumn(
        "_order",
        F.struct(
            F.lit(n).alias("n"),
            *[F.col(c).cast("string").alias(f"o{i}") if c in df.columns else F.lit(None).cast("string").alias(f"o{i}") for i, c in enumerate(order)],
            F.to_json(F.struct("*")).alias("row")
        )
    )
    every = numbered(edited, 0).unionByName(numbered(texts, 1), allowMissingColumns=True).withColumn("_score", score)
    kept, refused = (relational.dedupe_best(d, "pair_id", "_score", "_order").drop("_score", "_order") for d in gates.kept_and_quarantined(every))
    if cfg.balance:
        kept = relational.balance(kept, ["modality", "severity_label"], "pair_id", cfg.seed, "edit_type_effective" if cfg.balance_kinds else None)
    if cfg.max_pristine is not None:
        pristine = relational.sample(pristine, cfg.max_pristine, cfg.seed, "pair_id")
    both = pristine.unionByName(kept, allowMissingColumns=True)
    split = relational.split_of(F.col("sample_id"), *cfg.splits[:2])
    return both.drop("result_order").withColumn("split", split), refused.drop("result_order").withColumn("split", split)


def counted(df: DataFrame, value: Column, name: str) -> DataFrame:
    """counter, value and n of the values that aren't null or empty."""
    return df.select(
        F.lit(name).alias("counter"), value.cast("string").alias("value")
    ).where("value is not null and value <> ''").groupBy("counter", "value").agg(F.count(F.lit(1)).alias("n"))


def stats(examples: DataFrame, quarantine: DataFrame) -> DataFrame:
    """counter, value, n: all counters of a release in one scan of each table."""
    c = F.col
    arrow = lambda a, b, sep="->": F.when(
        (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), F.concat(a, F.lit(sep), b)
    )
    values = {
        "modality": c("modality"),
        "severity": c("severity_label"),
        "requested_severity": c("requested_generation_severity"),
        "edit_type": c("edit_type_effective"),
        "split": c("split"),
        "requested_to_final": arrow(c("requested_generation_severity"), c("severity_label")),
        "requested_to_effective": arrow(c("edit_type_requested"), c("edit_type_effective")),
        "modality_severity": arrow(c("modality"), c("severity_label"), "|"),
    }
    long = examples.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), v.alias("value")) for k, v in values.items()])).alias("x")
    ).select("x.*").where("value is not null and value <> ''")
    why = quarantine.select(F.lit("quarantine_reason").alias("counter"), F.explode(F.split("filter_reason", ";")).alias("value")).where("value <> ''")
    return long.unionAll(why).groupBy("counter", "value").agg(F.count(F.lit(1)).alias("n"))


def score_summary(examples: DataFrame) -> DataFrame:
    s = F.col("severity_score")
    return examples.agg(
        F.count(F.lit(1)).alias("num_examples"), F.bround(F.avg(s), 6).alias("mean"),
        F.bround(F.min(s), 6).alias("min"), F.bround(F.max(s), 6).alias("max")
    )
