"""Scans of CSV, JSON and JSON lines, lenient or strict. Rows carry their file and line where order decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.coerce import is_object, nonempty, rooted
from sievework.operators.relational import ranked

ALIASES = {
    "title": ["title"], "summary": ["summary", "description"], "published": ["published", "date"],
    "url": ["url"], "images": ["images", "image", "img"]
}


def newest(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """The path of the latest file of a folder; ties go to the larger path. Raises FileNotFoundError without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    got = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
    if got is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return got["path"]


def articles(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows of a CSV with a header, all strings, by row_index from 0: title, summary, published, url, images.
    The index counts rows in file order; a slice keeps indexes in [start, end)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    # ids grow in file order; their ranks are row numbers
    indexed = ranked(raw.withColumn("_at", F.monotonically_increasing_id()), ["_at"]).withColumn("row_index", F.col("rank0").cast("int"))
    kept = indexed.where((F.col("row_index") >= start) & (F.lit(True) if end is None else F.col("row_index") < end))
    pick = lambda names: F.trim(F.coalesce(*[nonempty(F.col(f"`{n}`")) for n in names if n in raw.columns], F.lit("")))
    return kept.select("row_index", *[pick(names).alias(c) for c, names in ALIASES.items()])


def json_objects(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False, strict: bool = False) -> DataFrame:
    """file, name and VARIANT of each file that holds an object. Lenient: other files give no row. Strict: a file that
    doesn't parse or holds no object raises."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        (F.parse_json("value") if strict else F.try_parse_json("value")).alias("v")
    )
    rows = rows.where(~F.col("name").endswith(".tmp"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no JSON object in "), F.col("file"))).cast("boolean")
        return rows.where(F.when(is_object(F.col("v")), F.lit(True)).otherwise(wrong))
    return rows.where(is_object(F.col("v")))


def manifests(spark: SparkSession, folder: str, numeric: bool = False) -> DataFrame:
    """sample_id and VARIANT of the manifests of a folder; of one id, the last file counts. numeric: only names of digits."""
    rows = json_objects(spark, folder).where(F.col("name") != "index.json")
    rows = rows.where(F.col("name").rlike(r"^\d+\.json$")) if numeric else rows
    named = rows.withColumn("sample_id", F.coalesce(F.try_variant_get("v", "$.sample_id", "string"), F.lit(""))).where("sample_id <> ''")
    return named.groupBy("sample_id").agg(F.max_by("v", "file").alias("v"))


def grounding_files(spark: SparkSession, folder: str) -> DataFrame:
    return json_objects(spark, folder, "boxes.json", recursive=True)


def jsonl(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """file, ord (order within the file) and VARIANT of each line that holds an object.
    Lenient: other lines are skipped. Strict: a line that doesn't parse raises; values that aren't objects are skipped."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("ord"),
        F.trim("value").alias("line")
    ).where("line <> ''")
    parse = F.parse_json("line") if strict else F.try_parse_json("line")
    return lines.select("file", "ord", parse.alias("v")).where(is_object(F.col("v")))


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """Fields of VARIANT objects by a schema; what doesn't fit is null."""
    return rows.select(*[c for c in rows.columns if c != "v"], F.from_json(F.to_json("v"), schema).alias("_o")).select("*", "_o.*").drop("_o")


def last_wins(rows: DataFrame, keys: list[str], order: list[str], blank: bool = False) -> DataFrame:
    """One row for each key: the last by order. blank: whether empty keys count; otherwise rows with one are left out."""
    kept = rows if blank else rows.where(" AND ".join(f"coalesce(`{k}`, '') <> ''" for k in keys))
    w = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_records(rows: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """The first row of each id by order; rows without an id all stay."""
    w = W.partitionBy(key).orderBy(*(order or ["file", "ord"]))
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return rows.withColumn("_n", F.row_number().over(w)).where(blank | (F.col("_n") == 1)).drop("_n")


def records(payloads: DataFrame, record_schema: str) -> DataFrame:
    """file, pos and fields of the records of payloads {meta, records}; a payload without records raises."""
    given = F.try_variant_get("v", "$.records", "variant")
    checked = F.when(given.isNull(), F.raise_error(F.concat(F.lit("no records in "), F.col("file")))).otherwise(F.to_json(given))
    rows = payloads.select(
        "file",
        F.coalesce(F.try_variant_get("v", "$.meta.images_dir", "string"), F.lit("")).alias("images_dir"),
        F.posexplode(F.from_json(checked.cast("string"), f"array<struct<{record_schema}>>")).alias("pos", "r")
    )
    return rows.select("file", "images_dir", "pos", "r.*")


#: Folder of the images of payloads that name none, below the root.
IMAGES = "data/pristine_images/images/images"


def grounding_records(payloads: DataFrame, root: str = "") -> DataFrame:
    """Extraction records of payloads (file, VARIANT v) for grounding: file, pos, id, status, csv_fields and outputs as
    VARIANT objects (empty where they aren't objects), and the path of the image, '' without a name for one. Of one id
    the first by file and place counts; records without an id all stay; items that aren't objects are left out, and
    files whose payload has no records."""
    said = lambda v, path: F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    inner = lambda name: F.coalesce(
        F.when(is_object(F.try_variant_get("r", f"$.{name}", "variant")), F.try_variant_get("r", f"$.{name}", "variant")),
        F.parse_json(F.lit("{}"))
    )
    folder = F.when(is_object(F.try_variant_get("v", "$.meta", "variant")), said(F.col("v"), "$.meta.images_dir")).otherwise("")
    rows = payloads.select(
        "file",
        F.coalesce(rooted(folder, root) if root else nonempty(folder), F.lit(f"{root.rstrip('/')}/{IMAGES}" if root else IMAGES)).alias("_folder"),
        F.posexplode(F.try_variant_get("v", "$.records", "array<variant>")).alias("pos", "r")
    )
    rows = rows.where(is_object(F.col("r"))).select(
        "file", "pos", "_folder", said(F.col("r"), "$.id").alias("id"),
        F.lower(said(F.col("r"), "$.status")).alias("status"), inner("csv_fields").alias("csv_fields"),
        inner("outputs").alias("outputs")
    )
    name = F.trim(F.coalesce(*[nonempty(F.try_variant_get("csv_fields", f"$.{k}", "string")) for k in ALIASES["images"]], F.lit("")))
    placed = rows.withColumn(
        "resolved_image_path",
        F.when(name == "", "").otherwise(F.concat(F.regexp_replace("_folder", "/+$", ""), F.lit("/"), name))
    ).drop("_folder")
    return first_records(placed, "id", ["file", "pos"])


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def tier_bank(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Keyword bank of three tiers from one JSON object: configuration, read on the driver."""
    got = spark.read.option("multiLine", True).schema("tier_a array<string>, tier_b array<string>, tier_c array<string>").json(path).first()
    return {t: [" ".join(w.split()).lower() for w in (got[t] or [])] for t in ("tier_a", "tier_b", "tier_c")}


def eligible(status: Column, anchors: Column) -> Column:
    """Cause for which a record is skipped, null if it isn't."""
    return F.when(
        F.lower(F.trim(F.coalesce(status, F.lit("")))) != "ok", "status_not_ok"
    ).when(anchors.isNull(), "no_anchors").when(F.size(anchors) == 0, "empty_anchors")
