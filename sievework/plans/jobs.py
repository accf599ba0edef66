"""Whole jobs from files to files: extraction, grounding, flattening, planning, editing and the release.

A job is a dataclass of its settings with run(spark), which reads, applies the operators, writes and returns its report as
one row (DataFrame). settings(kind, arguments) makes one from a command line. Model outputs are inputs: JSON lines of what
was recorded. A row that fails gets a status, never an exception. Where the output holds rows already, a job stops unless
it is told to resume, which leaves out what is written, or to overwrite.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import MISSING, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import jsonops, routing, scoring, text
from sievework.functions.coerce import let, nonempty, safe_str
from sievework.operators import anchors, gates, relational, release, reports
from sievework.sources import scans, sinks

c = F.col
BOX = "array<double>"
MANIFEST = f"""image_path string, headline string, summary string, caption struct<image_caption_literal:string>, context struct<article_context_rewrite:string>, anchors_meta struct<grounded_context_caption:string>,
anchors array<struct<anchor_id:string,anchor_text:string,anchor_norm:string,category:string,semantic_tags:array<string>,functional_role:string,attributes_text:string,status:string,grounding_status:string,union_mask_path:string,
union_mask_stats:struct<width:double,height:double,foreground_area_px:double>,best_detection:struct<score:double,precision_score:double,qwen_verify_score:double,box_xyxy:{BOX}>,detections:array<struct<score:double>>,span:string>>,
relations array<struct<subject_anchor_id:string,object_anchor_id:string>>"""
EDITABLE = f"""sample_id string, image_path string, anchor_id string, anchor_text string, anchor_norm string, category string, semantic_tags array<string>, functional_role string, union_mask_path string, mask_ratio double, size_band string,
bbox_xyxy {BOX}, grounding_score double, relation_count int, technical_valid boolean, technical_reject_reason string, is_duplicate boolean, keep_for_step2 boolean"""
REWRITE = "struct<rewritten_headline:string,text_edit_operation:string,nli_direction:string,rewrite_rationale:string,error:string,raw_rewrite_output:string>"
ANSWERED = "operation:string,edited_anchor:string,edit_instruction:string,rationale:string,semantic_shift:double,role_shift:double,contradiction_potential:double,public_impact:double,realism:double,localizability:double"
DERIVED = "struct<delta_sem_plan:double,planned_score_raw:double,planned_bucket_from_formula:string,planner_confidence:double,blended_salience:double,blended_visibility:double,is_fallback:boolean,tier_ordering_warning:boolean>"
CANDIDATE = f"struct<{ANSWERED},headline_rewrite:map<string,{REWRITE}>,derived:{DERIVED}>"
SEEN = "visual_grounding struct<visible:boolean,apparent_size:string,occlusion_notes:string>, anchor_interpretation struct<anchor_centrality:double,local_editability:double>"
PLAN = f"""sample_id string, anchor_id string, image_path string, status string, planner_input struct<tier_name:string,tier_prior:double,salience_proxy:double,visibility_proxy:double,union_mask_path:string,bbox_xyxy:{BOX},mask_ratio:double,headline:string,summary:string>,
planner_output struct<severity_candidates:map<string,array<{CANDIDATE}>>,visual_grounding:struct<occlusion_notes:string>>, sensitive_content_flag struct<flagged:boolean>"""
RESULT = f"""sample_id string, anchor_id string, requested_operation string, effective_operation string, route_reason string, severity string, candidate_index int, tier string, planning_score double, edit_instruction string, edited_anchor string, fill_clause string,
image_path string, union_mask_path string, bbox_xyxy {BOX}, output_path string, realism_score double, masked_mean_delta double, masked_changed_ratio double, accepted boolean, reject_reason string, error string, duration_s double, rewritten_caption string,
nli_direction string, text_edit_operation string, modality string"""
PAIR, JOB = ["sample_id", "anchor_id"], ["sample_id", "anchor_id", "requested_operation", "severity", "candidate_index"]


def settings(kind: type, arguments: Sequence[str] | None = None):
    """A job of a kind from arguments: --name value for its fields, --name alone for switches."""
    parser = argparse.ArgumentParser(description=(kind.__doc__ or "").split("\n")[0])
    for f in fields(kind):
        name, needed = "--" + f.name.replace("_", "-"), f.default is MISSING
        if f.type == "bool":
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(
                name, type={"int": int, "float": float}.get(f.type.split(" ")[0], str),
                default=None if needed else f.default, required=needed
            )
    return kind(**vars(parser.parse_args(arguments)))


def started_at() -> Column:
    """The time at which a job's query starts, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def _may_write(spark: SparkSession, path: str, keys: list[str], resume: bool, overwrite: bool) -> None:
    if resume and overwrite:
        raise ValueError("resume and overwrite exclude each other")
    if not (resume or overwrite) and sinks.written(spark, path, keys) is not None:
        raise FileExistsError(f"{path} holds rows; resume or overwrite")


def _rows(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    return scans.typed(scans.jsonl(spark, path, strict), schema).drop("file", "ord")


def _last_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last row of each sample and anchor."""
    return scans.last_wins(scans.typed(scans.jsonl(spark, path), schema), PAIR, ["file", "ord"]).drop("file", "ord")


def _left(jobs: DataFrame, path: str, keys: list[str], resume: bool) -> DataFrame:
    done = sinks.written(jobs.sparkSession, path, keys) if resume else None
    if done is None:
        return jobs
    named = jobs.withColumns({f"_k_{k}": c(k).cast("string") for k in keys})
    return relational.resume(named, done.select(*[c(k).alias(f"_k_{k}") for k in keys]), [f"_k_{k}" for k in keys]).drop(*[f"_k_{k}" for k in keys])


def _first(jobs: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n in order, where a job is told to do no more."""
    return jobs if n is None else relational.ranked(jobs, order).where(c("rank0") < n).drop("rank0")


@dataclass(frozen=True)
class Extract:
    """Articles of a CSV and recorded answers become extraction records.

    answers: JSON lines of images (name of the file), caption, context, anchors and missed, each what the model said."""

    csv: str
    images_dir: str
    answers: str
    output: str
    start_row: int = 0
    end_row: int | None = None
    resume: bool = False
    overwrite: bool = False

    def run(self, spark: SparkSession) -> DataFrame:
        _may_write(spark, self.output, ["id"], self.resume, self.overwrite)
        rows = scans.articles(spark, self.csv, self.start_row, self.end_row).withColumn("id", F.format_string("%06d", c("row_index") + 1))
        rows = _left(rows, self.output, ["id"], self.resume)
        there = spark.read.format("binaryFile").load(self.images_dir).select(
            F.element_at(F.split("path", "/"), -1).alias("images")
        ).withColumn("_there", F.lit(True))
        answers = _rows(
            spark, self.answers,
            "images string, caption string, context string, anchors string, missed string"
        ).dropDuplicates(["images"])
        rows = rows.join(there, "images", "left").join(answers, "images", "left")
        parsed = rows.withColumns({f"_{k}": F.try_parse_json(jsonops.extracted(c(k))) for k in ("caption", "context", "anchors", "missed")})
        named = parsed.withColumn(
            "_a",
            F.from_json(F.to_json("_anchors"), f"grounded_context_caption string, anchors array<struct<{_nested(anchors.ANCHOR)}>>")
        ).withColumn("_m", F.from_json(F.to_json("_missed"), f"missed_anchors array<struct<{_nested(anchors.ANCHOR)}>>"))
        named = named.withColumn(
            "_c",
            F.from_json(
                F.to_json("_caption"),
                "image_caption_literal string, visible_text string, notable_objects array<string>, visible_text_items array<string>, visible_regions array<string>, candidate_objects_all array<string>"
            )
        )
        none = F.array().cast(f"array<struct<{_nested(anchors.ANCHOR)}>>")
        seen, lists = c("_c.visible_text"), [
            c(f"_c.{k}") for k in ("notable_objects", "candidate_objects_all", "visible_regions", "visible_text_items")
        ]
        # one step a column, so that none is worked out again in the next
        steps = {
            "_1": anchors.postprocessed(F.coalesce(c("_a.anchors"), none)),
            "_2": anchors.with_missed(c("_1"), F.coalesce(c("_m.missed_anchors"), none)),
            "_3": anchors.with_visible_text(c("_2"), lists[3], safe_str(seen)),
            "_4": anchors.without_weak(c("_3"), lists, safe_str(seen)),
            "_5": F.when(F.size("_4") > 0, c("_4")).otherwise(anchors.from_caption(*lists, safe_str(seen))),
        }
        for name, step in steps.items():
            named = named.withColumn(name, step)
        found = F.struct(safe_str(c("_a.grounded_context_caption")).alias("grounded_context_caption"), c("_5").alias("anchors"))
        errors = gates.reasons(
            (c("_there").isNull(), F.concat(F.lit("missing_image:"), "images")),
            (c("_there"), F.concat(F.lit("caption_failed:"), jsonops.caption_error(c("_caption")))),
            (c("_there"), F.concat(F.lit("context_failed:"), jsonops.context_error(c("_context")))),
            (c("_there") & c("_missed").isNotNull(), F.concat(F.lit("missed_anchors_failed:"), jsonops.missed_error(c("_missed")))),
            (c("_there"), F.concat(F.lit("anchors_failed:"), jsonops.anchors_error(F.parse_json(F.to_json(found))))),
        )
        told = named.withColumn("errors", errors).withColumn(
            "outputs",
            F.struct(
                c("_c").alias("caption"),
                F.from_json(F.to_json("_context"), "article_context_rewrite string").alias("context"),
                found.alias("anchors")
            )
        )
        failed = F.exists("errors", lambda e: e.startswith("anchors_failed") | e.startswith("caption_failed") | e.startswith("context_failed"))
        records = told.select(
            "id",
            "row_index",
            F.struct("title", "summary", "published", "url", "images").alias("csv_fields"),
            F.when(c("_there").isNull(), "missing_image").when(failed, "failed").otherwise("ok").alias("status"),
            "errors",
            "outputs",
            started_at().alias("created_at"),
        )
        sinks.append(records, self.output, ["id"], self.overwrite)
        return reports.record_counts(spark.read.schema("id string, status string").json(self.output))


def _nested(schema: str) -> str:
    """A list of columns as the fields of a struct."""
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


@dataclass(frozen=True)
class Ground:
    """Extraction records and recorded boxes become boxes of each sample's anchors.

    detections: JSON lines of sample_id, query, box, score and, where verified, verify_match and verify_score. sizes: JSON
    lines of sample_id, width and height of the images."""

    records: str
    detections: str
    sizes: str
    output: str
    mode: str = "high"
    one: int = 1
    many: int = 4
    keep_bad: bool = False

    def run(self, spark: SparkSession) -> DataFrame:
        rows = scans.jsonl(spark, self.records)
        schema = f"id string, status string, outputs struct<anchors:struct<anchors:array<struct<{_nested(anchors.ANCHOR)}>>>>"
        rows = scans.first_records(scans.typed(rows, schema), "id").where(scans.eligible(c("status"), c("outputs.anchors.anchors")).isNull())
        each = rows.select(c("id").alias("sample_id"), F.explode("outputs.anchors.anchors").alias("a")).select(
            "sample_id", c("a.anchor_id").alias("anchor_id"), c("a.span").alias("phrase"),
            text.category_of_tags(c("a.semantic_tags"), c("a.span")).alias("category")
        )
        each = each.withColumn(
            "multi", text.is_plural_phrase(c("phrase"), c("category"))
        ).withColumn("non_groundable", text.is_non_groundable(c("phrase")))
        sizes = _rows(spark, self.sizes, "sample_id string, width int, height int").dropDuplicates(["sample_id"])
        wanted = each.where("not non_groundable").join(sizes, "sample_id")
        told = _rows(spark, self.detections, f"sample_id string, query string, box {BOX}, score double, verify_match boolean, verify_score double")
        boxes = anchors.selected_detections(
            wanted, told.withColumn("verify_match", F.coalesce("verify_match", F.lit(True))), self.mode,
            one=self.one, many=self.many, keep_bad=self.keep_bad
        )
        held = boxes.groupBy(*PAIR).agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-c("score")).alias("order"), c("box").alias("box_xyxy"), "score", "precision_score",
                        c("query").alias("grounding_query"), "rejection_reasons", "accepted"
                    )
                )
            ).alias("detections")
        )
        found = each.join(held, PAIR, "left").withColumn(
            "detections",
            F.transform(F.coalesce("detections", F.array().cast(held.schema["detections"].dataType)), lambda d: d.dropFields("order"))
        )
        refused = F.size(F.filter("detections", lambda d: ~d["accepted"])) > 0
        status = F.when(c("non_groundable"), "non_groundable").when(F.size("detections") > 0, "ok").otherwise("no_box")
        out = found.withColumns({"status": status, "fallback_used": refused})
        samples = out.groupBy(c("sample_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("anchor_id", "phrase", "category", "status", "fallback_used", "detections"))).alias("anchors")
        )
        sinks.json_lines(samples).json(self.output)
        return reports.status_counts(spark.read.schema(samples.schema).json(self.output).select(F.explode("anchors").alias("a")).select("a.*"))


@dataclass(frozen=True)
class Flatten:
    """Manifests become rows of anchors with their validity, duplicates marked."""

    manifests: str
    output: str
    root: str = ""

    def run(self, spark: SparkSession) -> DataFrame:
        rows = scans.typed(scans.manifests(spark, self.manifests, numeric=False), MANIFEST)
        sinks.write_jsonl(anchors.editable(rows, self.root), self.output)
        return reports.anchor_counts(spark.read.schema("keep_for_step2 boolean, is_duplicate boolean").json(self.output))


@dataclass(frozen=True)
class Plan:
    """Anchors worth an edit, with recorded answers of the planner, become plans of scored candidates.

    answers: JSON lines of sample_id, anchor_id and raw, the text that the model gave."""

    editable: str
    manifests: str
    answers: str
    output: str
    tier_bank: str | None = None
    sample_ids: str | None = None
    anchor_ids: str | None = None
    num_shards: int = 1
    shard_id: int = 0
    max_samples: int | None = None
    max_anchors: int | None = None
    include_invalid: bool = False
    resume: bool = False
    overwrite: bool = False

    def run(self, spark: SparkSession) -> DataFrame:
        _may_write(spark, self.output, PAIR, self.resume, self.overwrite)
        rows = _rows(spark, self.editable, EDITABLE, strict=True)
        ids = rows.select("sample_id").where("sample_id <> ''").distinct() if self.include_invalid else relational.eligible_groups(
            rows, "sample_id", "keep_for_step2"
        )
        ids = relational.only(ids, scans.id_list(spark, self.sample_ids), "sample_id") if self.sample_ids else ids
        ids = relational.shard(ids, "sample_id", self.num_shards, self.shard_id) if self.num_shards > 1 else ids
        jobs = relational.only(rows, _first(ids, self.max_samples, ["sample_id"]).withColumnRenamed("sample_id", "id"), "sample_id")
        jobs = jobs if self.include_invalid else jobs.where("keep_for_step2")
        jobs = relational.only(jobs, scans.id_list(spark, self.anchor_ids), "anchor_id") if self.anchor_ids else jobs
        jobs = _left(_first(jobs, self.max_anchors, PAIR), self.output, PAIR, self.resume)
        held = scans.typed(scans.manifests(spark, self.manifests), "headline string, summary string").select("sample_id", "headline", "summary")
        context = anchors.planning_context(jobs, held, scans.tier_bank(spark, self.tier_bank) if self.tier_bank else None)
        told = _rows(spark, self.answers, "sample_id string, anchor_id string, raw string").dropDuplicates(PAIR)
        asked = context.join(told, PAIR, "left").withColumn("_said", jsonops.extracted(c("raw")))
        asked = asked.withColumn("_p", F.from_json("_said", f"{SEEN}, severity_candidates map<string,array<struct<{ANSWERED}>>>"))
        status = F.coalesce(c("early_status"), F.when(c("_said").isNull(), "error"), F.lit("ok"))
        asked = asked.withColumn("status", status)
        cands = asked.where("status = 'ok'").select(
            *PAIR,
            "tier_prior",
            "salience_proxy",
            "visibility_proxy",
            *[
                F.coalesce(c(f"_p.anchor_interpretation.{k}"), F.lit(0.0)).alias(n) for k,
                n in (("anchor_centrality", "centrality"), ("local_editability", "editability"))
            ],
            F.coalesce(c("_p.visual_grounding.visible"), F.lit(True)).alias("visible"),
            safe_str(c("_p.visual_grounding.apparent_size")).alias("apparent_size"),
            F.explode("_p.severity_candidates").alias("severity", "_cs"),
        ).select("*", F.posexplode("_cs").alias("pos", "candidate")).drop("_cs")
        none = F.lit(None)
        scored = anchors.scored_candidates(cands)
        as_derived = F.struct(
            "delta_sem_plan", "planned_score_raw", c("planned_bucket").alias("planned_bucket_from_formula"),
            "planner_confidence", "blended_salience", "blended_visibility", F.lit(False).alias("is_fallback"),
            "tier_ordering_warning"
        )
        full = F.struct("candidate.*", none.cast(f"map<string,{REWRITE}>").alias("headline_rewrite"), as_derived.alias("derived")).cast(CANDIDATE)
        lists = scored.groupBy(*PAIR, "severity").agg(
            F.array_sort(
                F.collect_list(F.struct("candidate_index", full.alias("x"))),
                lambda a, b: a["candidate_index"] - b["candidate_index"]
            ).alias("l")
        ).select(*PAIR, "severity", F.transform("l", lambda r: r["x"]).alias("l"))
        planned = lists.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct("severity", "l"))).alias("held"))
        out = asked.join(planned, PAIR, "left")
        out = out.withColumn(
            "_sev",
            F.when(c("status") == "ok", _with_fallbacks(F.coalesce("held", F.create_map().cast(f"map<string,array<{CANDIDATE}>>")), out))
        )
        flat = F.flatten(
            F.transform(
                F.map_entries("_sev"),
                lambda e: F.transform(
                    e["value"],
                    lambda x, i: F.struct(
                        e["key"].alias("severity"), i.alias("candidate_index"),
                        x["edited_anchor"].alias("edited_anchor"),
                        x["edit_instruction"].alias("edit_instruction")
                    )
                )
            )
        )
        plans = out.withColumn("sensitive_content_flag", gates.sensitive_flag(F.concat_ws(" ", "headline", "summary", "anchor_text"), flat)).select(
            *PAIR, "anchor_text", "anchor_norm", "image_path", "status",
            F.struct(
                "tier_name", "tier_prior", "tier_reason", "salience_proxy", "visibility_proxy",
                "salience_terms", "allowed_operations", "union_mask_path", "bbox_xyxy", "mask_ratio",
                "headline", "summary", "category"
            ).alias("planner_input"),
            F.struct(
                c("_sev").alias("severity_candidates"), c("_p.visual_grounding").alias("visual_grounding"),
                c("_p.anchor_interpretation").alias("anchor_interpretation")
            ).alias("planner_output"),
            "sensitive_content_flag",
            c("raw").alias("raw_model_output"),
        )
        sinks.append(plans, self.output, PAIR, self.overwrite)
        return spark.read.schema("status string").json(self.output).agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(c("status") == s).alias(s) for s in ("ok", "error", "skipped_low_salience", "skipped_no_mask", "missing_image")]
        )


def _with_fallbacks(held: Column, rows: DataFrame) -> Column:
    """The candidates of each severity, a neutral one where there is none."""
    zero = F.struct(
        *[F.lit(0.0).alias(k) for k in ("delta_sem_plan", "planned_score_raw")],
        F.lit("low").alias("planned_bucket_from_formula"), F.lit(0.0).alias("planner_confidence"),
        c("salience_proxy").alias("blended_salience"), c("visibility_proxy").alias("blended_visibility"),
        F.lit(True).alias("is_fallback"), F.lit(False).alias("tier_ordering_warning")
    )

    def one(severity: str) -> Column:
        def filled(f: Column) -> Column:
            delta = scoring.semantic_shift(f["semantic_shift"], f["role_shift"], f["public_impact"])
            raw = scoring.planned_score(
                c("tier_prior"), delta, f["contradiction_potential"], c("salience_proxy"),
                c("visibility_proxy"), c("salience_proxy")
            )
            derived = zero.withField("delta_sem_plan", F.bround(delta, 4)).withField("planned_score_raw", F.bround(raw, 4)).withField(
                "planned_bucket_from_formula", scoring.bucket(raw, scoring.PLAN_BUCKETS)
            )
            given = {
                "edit_instruction": F.lit(""), "rationale": F.lit(""),
                "headline_rewrite": F.lit(None).cast(f"map<string,{REWRITE}>"), "derived": derived
            }
            names = [x.split(":")[0] for x in ANSWERED.split(",")]
            return F.array(
                F.struct(*[given.get(n, f[n] if n not in given else None).alias(n) for n in [*names, "headline_rewrite", "derived"]]).cast(CANDIDATE)
            )

        made = let(scoring.fallback_candidate(severity, safe_str(c("anchor_text")), c("allowed_operations")), filled)
        return F.coalesce(F.when(F.size(F.try_element_at(held, F.lit(severity))) > 0, F.try_element_at(held, F.lit(severity))), made)

    return F.create_map(*[x for s in scoring.SEVERITIES for x in (F.lit(s), one(s))])


@dataclass(frozen=True)
class Edit:
    """Plans become edit jobs, are routed, and meet what their execution recorded.

    masks: JSON lines of sample_id, anchor_id and mask statistics. recorded: JSON lines of the job's keys with realism_score,
    masked_mean_delta, masked_changed_ratio, error and duration_s. max_candidates: of a severity."""

    plans: str
    anchors: str
    masks: str
    recorded: str
    output: str
    images_root: str = ""
    severity: str | None = None
    max_candidates: int = 2
    max_jobs: int | None = None
    realism: float = routing.REALISM
    resume: bool = False
    overwrite: bool = False

    def jobs(self, spark: SparkSession) -> DataFrame:
        plans = _rows(spark, self.plans, PLAN).where(~F.coalesce("status", F.lit("")).isin("error", "skipped_low_salience"))
        index = _last_rows(
            spark, self.anchors,
            f"sample_id string, anchor_id string, union_mask_path string, bbox_xyxy {BOX}"
        ).select(*PAIR, c("union_mask_path").alias("_mask"), c("bbox_xyxy").alias("_box"))
        rows = plans.join(index, PAIR, "left").withColumns(
            {
                "union_mask_path": F.coalesce(nonempty(c("planner_input.union_mask_path")), nonempty(c("_mask"))),
                "bbox_xyxy": F.coalesce(c("planner_input.bbox_xyxy"), c("_box"))
            }
        )
        rows = rows.where((F.coalesce("image_path", F.lit("")) != "") & (c("union_mask_path").isNotNull() | c("bbox_xyxy").isNotNull()))
        each = rows.select(
            "*", F.explode("planner_output.severity_candidates").alias("severity", "_cs")
        ).select("*", F.posexplode("_cs").alias("pos", "x")).where("x IS NOT NULL")
        said = F.coalesce(F.try_element_at("x.headline_rewrite", F.lit("joint")), F.try_element_at("x.headline_rewrite", F.lit("text_only")))
        flat = each.withColumn("_said", said).select(
            *PAIR,
            "severity",
            "pos",
            "image_path",
            "union_mask_path",
            "bbox_xyxy",
            c("x.operation").alias("requested_operation"),
            safe_str(c("x.edited_anchor")).alias("edited_anchor"),
            safe_str(c("x.edit_instruction")).alias("edit_instruction"),
            c("x.derived.planned_score_raw").alias("planned_score_raw"),
            c("planner_input.mask_ratio").alias("mask_ratio"),
            safe_str(c("planner_output.visual_grounding.occlusion_notes")).alias("occlusion"),
            F.coalesce(nonempty(c("planner_input.tier_name")), F.lit("tier_a")).alias("tier"),
            c("_said.rewritten_headline").alias("rewritten_caption"),
            c("_said.nli_direction").alias("nli_direction"),
            c("_said.text_edit_operation").alias("text_edit_operation"),
        )
        jobs = anchors.edit_jobs(flat, self.max_candidates).withColumnRenamed("planned_score_raw", "planning_score")
        return jobs.where(c("severity") == self.severity) if self.severity else jobs

    def run(self, spark: SparkSession) -> DataFrame:
        _may_write(spark, self.output, JOB, self.resume, self.overwrite)
        jobs = _first(_left(self.jobs(spark), self.output, JOB, self.resume), self.max_jobs, JOB)
        stats = _rows(
            spark, self.masks,
            "sample_id string, anchor_id string, area_ratio double, bbox_aspect_ratio double, compactness double, touches_border int, is_empty boolean"
        ).dropDuplicates(PAIR)
        done = _rows(
            spark, self.recorded,
            "sample_id string, anchor_id string, severity string, candidate_index int, realism_score double, masked_mean_delta double, masked_changed_ratio double, error string, duration_s double"
        ).dropDuplicates([*PAIR, "severity", "candidate_index"])
        rows = jobs.join(stats, PAIR, "left").join(done, [*PAIR, "severity", "candidate_index"], "left")
        rows = rows.withColumn("meta", routing.anchor_meta(c("edited_anchor"), c("fill_clause"), c("visual_prompt"), c("edit_instruction")))
        way = routing.route(
            c("requested_operation"), c("meta"), c("area_ratio"), c("bbox_aspect_ratio"), c("compactness"),
            c("touches_border"), F.coalesce("is_empty", F.lit(True))
        )
        rows = rows.withColumn("way", way).withColumns({"effective_operation": c("way.effective"), "route_reason": c("way.reason")})
        visible = routing.is_visible(c("severity"), F.coalesce("masked_mean_delta", F.lit(0.0)), F.coalesce("masked_changed_ratio", F.lit(0.0)))
        rows = rows.withColumn(
            "end",
            routing.outcome(c("effective_operation"), c("error"), visible, c("realism_score"), self.realism)
        ).withColumns({"accepted": c("end.accepted"), "reject_reason": c("end.reject_reason")})
        names = [c(n) for n in ("sample_id", "anchor_id", "requested_operation", "effective_operation", "severity", "candidate_index")]
        path = F.when(c("effective_operation") != "skip", F.when(c("accepted"), routing.output_name(*names)).otherwise(routing.reject_name(*names)))
        sinks.append(routing.result_rows(rows.withColumn("output_path", F.concat(F.lit(self.images_root), path))), self.output, JOB, self.overwrite)
        return spark.read.schema("severity string, accepted boolean").json(self.output).agg(
            F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"),
            *[F.count_if(c("severity") == s).alias(s) for s in scoring.SEVERITIES]
        )


@dataclass(frozen=True)
class Release:
    """Manifests, anchors, plans and edit results become a release: examples by split, quarantine, flat files, statistics and card."""

    manifests: str
    output: str
    results: str
    plans: str | None = None
    anchors: str | None = None
    severity_model: str | None = None
    calibration: str | None = None
    require_accepted: bool = False
    require_valid: bool = False
    exclude_sensitive: bool = True
    joint_as_text: bool = False
    cross_mode: bool = True
    synthesize: bool = False
    balance: bool = False
    balance_kinds: bool = False
    max_pristine: int | None = None
    realism_min: float = 0.35
    seed: int = 13

    def config(self, spark: SparkSession) -> release.BuildConfig:
        whole = lambda path: spark.read.option("wholetext", True).text(path).first()["value"]
        model = scoring.severity_model(whole(self.severity_model)) if self.severity_model else scoring.SeverityModel()
        if self.calibration:
            model = scoring.SeverityModel(
                model.weights, model.priors, model.low_max, model.medium_max, model.none_max,
                scoring.calibration_points(json.loads(whole(self.calibration)))
            )
        given = {f.name: getattr(self, f.name) for f in fields(release.BuildConfig) if hasattr(self, f.name)}
        return release.BuildConfig(**given, model=model)

    def run(self, spark: SparkSession) -> DataFrame:
        cfg = self.config(spark)
        manifests = scans.typed(scans.manifests(spark, self.manifests), MANIFEST)
        none = lambda schema: spark.createDataFrame([], schema)
        plans = _last_rows(spark, self.plans, PLAN) if self.plans else none(PLAN)
        plans = plans.select(
            *PAIR,
            "image_path",
            c("planner_input.headline").alias("headline"),
            c("planner_input.summary").alias("summary"),
            c("sensitive_content_flag.flagged").alias("sensitive"),
            c("planner_input.tier_prior").alias("tier_prior"),
            F.lit(None).cast("double").alias("proxy_tier_prior"),
            c("planner_input.tier_name").alias("tier_name"),
            c("planner_input.salience_proxy").alias("salience_proxy"),
            c("planner_input.visibility_proxy").alias("visibility_proxy"),
            F.lit(None).cast("double").alias("blended_salience"),
            F.lit(None).cast("double").alias("blended_visibility"),
            F.lit(False).alias("has_proxies"),
            F.transform_values(
                "planner_output.severity_candidates",
                lambda _, xs: F.transform(
                    xs,
                    lambda x: F.struct(
                        x["operation"].alias("operation"), x["edited_anchor"].alias("edited_anchor"),
                        x["edit_instruction"].alias("edit_instruction"), x["rationale"].alias("rationale"),
                        x["derived"]["delta_sem_plan"].alias("delta_sem_plan"),
                        *[x[k].alias(k) for k in ("semantic_shift", "role_shift", "public_impact", "contradiction_potential", "headline_rewrite")]
                    )
                )
            ).alias("candidates"),
        )
        valid = "sample_id string, anchor_id string, technical_valid boolean, technical_reject_reason string"
        held = _last_rows(spark, self.anchors, valid) if self.anchors else none(valid)
        results = scans.typed(scans.jsonl(spark, self.results), RESULT).withColumn(
            "result_order", F.concat_ws("/", "file", F.lpad(c("ord").cast("string"), 20, "0"))
        ).drop("file", "ord")
        edited = release.edited_examples(relational.lookups(results, plans, held, manifests), None, cfg)
        texts, pristine = release.text_examples(plans, held, manifests, cfg), release.pristine_examples(manifests)
        kept, refused = release.release(pristine, edited, texts, cfg)
        sinks.write_jsonl(kept, f"{self.output}/examples")
        sinks.write_jsonl(refused, f"{self.output}/quarantine")
        # what is written is read, so that nothing is worked out again for the other files and the counts
        kept, refused = spark.read.schema(kept.schema).json(f"{self.output}/examples"), spark.read.schema(refused.schema).json(f"{self.output}/quarantine")
        counts: dict = {}
        for r in release.stats(kept, refused).collect():
            counts.setdefault(r["counter"], {})[r["value"]] = r["n"]
        sinks.write_csv(kept, f"{self.output}/flat")
        sinks.write_csv(kept, f"{self.output}/flat_rich", rich=True)
        sinks.write_splits(kept, f"{self.output}/splits")
        sinks.write_text(spark, f"{self.output}/stats", json.dumps(counts, sort_keys=True))
        sinks.write_text(spark, f"{self.output}/card", sinks.data_card(counts, {f.name: getattr(self, f.name) for f in fields(self)}))
        return reports.joined(
            kept.agg(F.count(F.lit(1)).alias("examples"), F.count_if("is_pristine").alias("pristine")),
            refused.agg(F.count(F.lit(1)).alias("quarantined"))
        )


JOBS = {kind.__name__.lower(): kind for kind in (Extract, Ground, Flatten, Plan, Edit, Release)}


def main(arguments: Sequence[str]) -> dict:
    """Runs the job named first with the settings that follow; its report."""
    spark = SparkSession.builder.getOrCreate()
    return settings(JOBS[arguments[0]], arguments[1:]).run(spark).first().asDict()


if __name__ == "__main__":
    import sys

    print(json.dumps(main(sys.argv[1:])))
