"""Writers: JSON lines with explicit nulls, CSV, folders by split, append with resume, and a data card."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

FLAT = [
    "pair_id",
    "sample_id",
    "anchor_id",
    "split",
    "authenticity_label",
    "modality",
    "requested_generation_severity",
    "severity_label",
    "severity_score",
    "severity_score_raw",
    "edit_type_requested",
    "edit_type_effective",
    "image_original",
    "image_edited", "headline_original", "headline_edited", "mask_path",
]
EXPLAINED = [
    "edited_anchor", "fill_clause", "edit_instruction", "route_reason", "rationale", "rewrite_rationale",
    "text_edit_operation", "nli_direction"
]
COMPONENTS = ["T_obj", "I_ctx", "C_nli", "Sal", "Vis"]
QUALITY = ["realism_score", "masked_changed_ratio", "masked_mean_delta"]
VISUAL = ["mode", "checked", "acceptable", "confidence"]
PROVENANCE = ["candidate_index", "manifest_present", "planner_row_present", "edit_result_present", "sensitive_flagged"]


def flat_rows(examples: DataFrame, rich: bool = False) -> DataFrame:
    """17 columns of nested examples, or 45; lists as JSON text. Fields that examples lack are null."""

    def at(path: str, kind: str = "string"):
        try:
            examples.select(path)
        except Exception:
            return F.lit(None).cast(kind)
        return F.col(path)

    cols = [at(c).alias(c) for c in FLAT]
    if rich:
        cols += [F.to_json(at("bbox_xyxy", "array<double>")).alias("bbox_xyxy")]
        for parent, names in (("explanation", EXPLAINED), ("severity_components", COMPONENTS), ("quality", QUALITY)):
            cols += [at(f"{parent}.{n}").alias(n) for n in names]
        cols += [at(f"quality.visual_qc.{n}").alias(f"visual_qc_{n}") for n in VISUAL]
        cols += [
            F.to_json(at("quality.visual_qc.reasons", "array<string>")).alias("visual_qc_reasons"),
            at("quality.filter_reason").alias("filter_reason")
        ]
        cols += [at(f"provenance.{n}").alias(n) for n in PROVENANCE]
    return examples.select(*cols)


def json_lines(df: DataFrame, mode: str = "overwrite") -> DataFrameWriter:
    return df.write.mode(mode).option("ignoreNullFields", False)


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).json(path)


def write_csv(df: DataFrame, path: str, rich: bool = False) -> None:
    flat_rows(df, rich).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    json_lines(df).partitionBy("split").json(path)


def written(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The keys of the rows below path; nothing where nothing is written yet."""
    try:
        return spark.read.schema(", ".join(f"`{k}` string" for k in keys)).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append(df: DataFrame, path: str, keys: list[str] | None = None, overwrite: bool = False) -> None:
    """New result rows beside older ones. With keys, rows whose keys (as text) are written already are left out, so that a
    job that is run again, after an end or a failure, doubles none. overwrite: older rows go."""
    done = written(df.sparkSession, path, keys) if keys and not overwrite else None
    if done is not None:
        asked = [F.coalesce(F.col(k).cast("string"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"_done_{k}"), F.lit(""))) for k in keys]
        df = df.join(done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]), reduce(lambda a, b: a & b, asked), "left_anti")
    json_lines(df, "overwrite" if overwrite else "append").json(path)


def write_masks(df: DataFrame, path: str, name: str = "name", data: str = "png") -> DataFrame:
    """Files of a binary column below path, each under the name beside it; the names that were written, as rows."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:///{path}")
        for p in parts:
            for file, content in zip(p[name], p[data], strict=True):
                store.create_dir(f"{root}/{file}".rpartition("/")[0])
                with store.open_output_stream(f"{root}/{file}") as out:
                    out.write(content)
            yield p[[name]]

    return df.select(name, data).mapInPandas(run, f"`{name}` string")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def data_card(stats: dict, config: dict) -> str:
    lines = ["# Dataset card", "", "## Configuration", ""] + [f"- {k}: {v}" for k, v in sorted(config.items())]
    return "\n".join([*lines, "", "## Statistics", "", "```json", json.dumps(stats, indent=2, ensure_ascii=False, sort_keys=True), "```", ""])


def write_release(examples: DataFrame, quarantine: DataFrame, stats: dict, config: dict, path: str) -> None:
    spark = examples.sparkSession
    write_jsonl(examples, f"{path}/examples")
    write_jsonl(quarantine, f"{path}/quarantine")
    write_csv(examples, f"{path}/flat")
    write_csv(examples, f"{path}/flat_rich", rich=True)
    write_splits(examples, f"{path}/splits")
    write_text(spark, f"{path}/stats", json.dumps(stats, ensure_ascii=False))
    write_text(spark, f"{path}/card", data_card(stats, config))
