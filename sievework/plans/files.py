"""Queries that write tables as files and read them back with the library's scans and sinks, and their SQL.

Files go to the folder that all executors share, below a new name for each call, and are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import relational, reports
from sievework.plans import builds
from sievework.plans.catalogue import CLAMP, GATED, WORDS, query, split_sql, table
from sievework.sources import scans, sinks
from sievework.streaming import gates as streams

c = F.col


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode a temporary one, if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the files are then the cluster's to expire
        return


@query(
    "SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1"
)
def q_jsonl_last_wins(spark, sf_dir):
    """JSON lines with explicit nulls, read leniently, by key with the last line winning."""
    path = folder(spark, "jsonl")
    sinks.write_jsonl(
        table(spark, sf_dir, "orders").select(
            "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice",
            F.lit(None).cast("string").alias("nothing")
        ),
        path
    )
    rows = scans.typed(scans.jsonl(spark, path), "o_custkey bigint, o_orderkey bigint, o_orderpriority string, o_totalprice double, nothing string")
    return scans.last_wins(rows, ["o_custkey"], ["o_orderkey"], blank=True).where("nothing IS NULL").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"
    )


@query("SELECT count(*) AS rows, sum(event_id)::BIGINT AS ids, count(DISTINCT event_type) AS kinds FROM events")
def q_jsonl_strict(spark, sf_dir):
    path = folder(spark, "strict")
    sinks.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type"), path)
    rows = scans.typed(scans.jsonl(spark, path, strict=True), "event_id bigint, event_type string")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"), F.countDistinct("event_type").alias("kinds"))


@query(
    "SELECT p_name AS title, 'about ' || p_type AS summary, '' AS published, p_brand AS url, p_partkey || '.png' AS images, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL"
)
def q_articles(spark, sf_dir):
    """The newest CSV of a folder, by aliases of its columns; rows number what stands in the file."""
    path = folder(spark, "csv")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), "p_name").alias("title"),
        F.concat(F.lit("about "), "p_type").alias("description"), c("p_brand").alias("url"),
        F.concat(c("p_partkey").cast("string"), F.lit(".png")).alias("img"), "p_partkey"
    )
    parts.where("p_partkey % 3 = 0").drop("p_partkey").coalesce(1).write.option("header", True).csv(f"{path}/old")
    parts.where("p_partkey % 3 <> 0").drop("p_partkey").repartition(1).write.option("header", True).csv(f"{path}/new")
    newest = scans.newest(spark, f"{path}/new")
    rows = scans.articles(spark, newest)
    return rows.where(c("row_index") >= 0).groupBy("title", "summary", "published", "url", "images").agg(F.countDistinct("row_index").alias("n"))


@query("SELECT page_id::VARCHAR AS sample_id, url AS headline, page_id % 2 = 0 AS latest FROM pages")
def q_manifest_files(spark, sf_dir):
    """A JSON file for each page, some with a later one of the same id; files that hold no object, and index files, give none."""
    path = folder(spark, "manifests")
    pages = table(spark, sf_dir, "pages").select(c("page_id").cast("string").alias("sample_id"), c("url").alias("headline"))
    named = lambda df, kind, latest: df.select(
        F.concat(F.lit(kind), "sample_id", F.lit(".json")).alias("name"),
        F.to_json(F.struct("sample_id", "headline", F.lit(latest).alias("latest"))).alias("text")
    )
    odd = spark.createDataFrame([("index.json", '{"sample_id": "i"}'), ("broken.json", "{"), ("list.json", "[1]")], "name string, text string")
    files = named(pages, "a", False).unionAll(named(pages.where("cast(sample_id AS bigint) % 2 = 0"), "b", True)).unionAll(odd)
    sinks.write_masks(files.withColumn("png", F.encode("text", "UTF-8")), path).count()
    rows = scans.typed(scans.manifests(spark, path), "headline string, latest boolean")
    return rows.select("sample_id", "headline", "latest")


@query(
    "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'd/' || doc_id || '.png' END AS image, CASE WHEN doc_id % 3 = 0 THEN 'status_not_ok' WHEN doc_id % 4 = 0 THEN 'empty_anchors' END AS skipped FROM documents"
)
def q_grounding_records(spark, sf_dir):
    """Extraction payloads of a hundred ids each, read as records for grounding; of repeated ids the first file's counts."""
    path = folder(spark, "payloads")
    docs = table(spark, sf_dir, "documents")
    outputs = F.struct(F.when(c("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("anchors"))
    record = F.struct(
        F.concat(F.lit(" "), c("doc_id").cast("string")).alias("id"),
        F.when(c("doc_id") % 3 == 0, "failed").otherwise(" OK").alias("status"),
        F.struct(F.when(c("doc_id") % 5 != 0, F.concat(c("doc_id").cast("string"), F.lit(".png"))).otherwise("").alias("image")).alias("csv_fields"),
        outputs.alias("outputs")
    )
    groups = docs.groupBy(F.floor(c("doc_id") / 100).alias("g")).agg(F.collect_list(record).alias("records"))
    body = F.to_json(F.struct(F.struct(F.lit("d/").alias("images_dir")).alias("meta"), "records"))
    later = F.to_json(F.struct(F.struct(F.lit("other").alias("images_dir")).alias("meta"), F.slice("records", 1, 3).alias("records")))
    both = groups.select(F.concat(F.lit("a"), c("g").cast("string"), F.lit(".json")).alias("name"), body.alias("text")).unionAll(
        groups.select(F.concat(F.lit("b"), c("g").cast("string"), F.lit(".json")).alias("name"), later.alias("text"))
    )
    sinks.write_masks(both.withColumn("png", F.encode("text", "UTF-8")), path).count()
    rows = scans.grounding_records(scans.json_objects(spark, path))
    held = F.from_json(F.to_json(F.try_variant_get("outputs", "$.anchors", "variant")), "array<string>")
    return rows.select("id", "status", c("resolved_image_path").alias("image"), scans.eligible(c("status"), held).alias("skipped"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1")
def q_id_files(spark, sf_dir):
    path = folder(spark, "ids")
    table(spark, sf_dir, "customer").where("c_custkey % 4 = 1").select(
        F.concat(F.lit(" "), c("c_custkey").cast("string"), F.lit("  "))
    ).unionAll(spark.createDataFrame([("",)], "v string")).write.text(path)
    wanted = scans.id_list(spark, path).select(c("id").cast("bigint").alias("id"))
    return relational.only(table(spark, sf_dir, "customer"), wanted, "c_custkey").select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM orders")
def q_append_resume(spark, sf_dir):
    """A job that is run twice over the same rows, the first time over a half, doubles none."""
    path = folder(spark, "results")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("second").alias("run"))
    sinks.append(rows.where("o_orderkey % 2 = 0").withColumn("run", F.lit("first")), path, ["o_orderkey"])
    for _ in range(2):
        sinks.append(rows, path, ["o_orderkey"])
    return spark.read.schema("o_orderkey bigint, run string").json(path)


@query(f"SELECT {split_sql('doc_id::VARCHAR')} AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY ALL")
def q_split_folders(spark, sf_dir):
    path = folder(spark, "splits")
    sinks.write_splits(table(spark, sf_dir, "documents").select("doc_id", relational.split_of(c("doc_id").cast("string")).alias("split")), path)
    return spark.read.schema("doc_id bigint, split string").json(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")
    )


_NULL = ", ".join(
    f"CAST(NULL AS VARCHAR) AS {n}" for n in (
        "anchor_id", "split", "authenticity_label", "modality", "requested_generation_severity",
        "edit_type_requested", "edit_type_effective", "image_original", "image_edited", "headline_edited",
        "mask_path"
    )
)


@query(
    f"SELECT o_orderkey::VARCHAR AS pair_id, c_custkey::VARCHAR AS sample_id, o_totalprice::VARCHAR AS severity_score, o_orderpriority AS severity_label, c_name AS headline_original, CAST(NULL AS VARCHAR) AS severity_score_raw, {_NULL} FROM orders JOIN customer ON o_custkey = c_custkey"
)
def q_flat_csv(spark, sf_dir):
    """The flat file of nested examples, read back: 17 columns, nulls as empty fields."""
    path = folder(spark, "flat")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    sinks.write_csv(
        rows.select(
            c("o_orderkey").cast("string").alias("pair_id"), c("c_custkey").cast("string").alias("sample_id"),
            c("o_totalprice").alias("severity_score"), c("o_orderpriority").alias("severity_label"),
            c("c_name").alias("headline_original")
        ),
        path
    )
    got = spark.read.option("header", True).csv(path)
    return got.withColumn("severity_score", c("severity_score").cast("double").cast("decimal(20,2)").cast("double").cast("string"))


@query(f"SELECT doc_id, reason, {split_sql('doc_id::VARCHAR')} AS split FROM ({GATED.replace('400', '80')})")
def q_stream_gate(spark, sf_dir):
    """The gate on a stream that reads the table and ends with it."""
    path = folder(spark, "stream")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.parquet(f"{path}/in")
    rows = streams.read(spark, f"{path}/in", "doc_id bigint, text string")
    streams.start(streams.gated(rows).select("doc_id", "reason", "split"), f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "reason", "split")


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def q_stream_once(spark, sf_dir):
    """Repeats of a key in a stream are dropped while its state is kept; what is later is the batch's own first row."""
    path = folder(spark, "once")
    table(spark, sf_dir, "events").select(c("ts").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(f"{path}/in")
    rows = streams.read(
        spark, f"{path}/in", "ts timestamp, user_id bigint, event_type string"
    ).withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    streams.start(streams.once(rows, "key", "ts", "100000 days").select("user_id", "event_type"), f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("user_id", "event_type", F.lit(True).alias("seen"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark, sf_dir):
    """Counts of a stream by the hour, in full."""
    path = folder(spark, "windows")
    table(spark, sf_dir, "events").select(c("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(f"{path}/in")
    counts = streams.windowed_counts(streams.read(spark, f"{path}/in", "ts timestamp, event_type string"), "ts", "event_type")
    streams.start(counts, f"{path}/out", f"{path}/log", mode="complete").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(builds._BUILD + """ SELECT true AS made, count(*) AS total, count(*) FILTER (WHERE modality = 'image_text') AS texts FROM v""")
def q_example_counts(spark, sf_dir):
    from sievework.operators import release

    got = release.edited_examples(relational.lookups(*builds.build_inputs(spark, sf_dir)), None, release.BuildConfig())
    return got.agg(F.lit(True).alias("made"), F.count(F.lit(1)).alias("total"), F.count_if(c("modality") == "image_text").alias("texts"))


@query(
    """WITH f AS (SELECT l_quantity * 200 / 10000.0 AS mr, l_discount * 10 AS gs, l_linestatus FROM lineitem) SELECT count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O' AND mr BETWEEN 0.002 AND 0.6 AND gs >= 0.35) AS valid FROM f"""
)
def q_anchor_counts(spark, sf_dir):
    from sievework.operators import anchors
    from sievework.plans.catalogue import order_manifests

    return reports.anchor_counts(anchors.flattened(order_manifests(spark, sf_dir))).select("total", c("kept").alias("valid"))


@query("""SELECT count(*) AS anchors, count(*) FILTER (WHERE l_linestatus = 'O' AND l_tax > 0.01) AS ok, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag = 'A') AS no_box, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag <> 'A') AS sam_failed, count(*) FILTER (WHERE l_linenumber = 1) AS fallback,
count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS both_ok, count(*) FILTER (WHERE l_linestatus <> 'O' OR l_returnflag = 'R') AS non_groundable FROM lineitem""")
def q_sample_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    open_ = c("l_linestatus") == "O"
    held = lines.select(
        F.when(open_, "ok").when(c("l_returnflag") == "A", "no_box").otherwise("sam_failed").alias("status"),
        F.when(c("l_tax") > 0.01, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("detections"),
        (c("l_linenumber") == 1).alias("fallback_used")
    )
    related = lines.select(
        F.when(open_, "ok").otherwise("non_groundable").alias("subject_status"),
        F.when(c("l_returnflag") == "N", "ok").when(c("l_returnflag") == "R", "non_groundable").otherwise("missing").alias("object_status")
    )
    return reports.joined(reports.status_counts(held), reports.relation_counts(related)).select(
        "anchors", "ok", "no_box", "sam_failed", "fallback", "both_ok", "non_groundable"
    )
