"""Queries opN_<name> over the whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import chat_format, decontaminate, license_scan, near_dedup, oracles, quality_classifier, quality_rules, secrets, sentencepiece_codec, sharding, warc
from sievework.llm.common import read

SHARDS = [f"shard-{i:04d}" for i in range(64)]
SLOTS = 8_191


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan(docs, repo=F.concat_ws("/", "source", "lang"), owner="source")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = listed(F.filter("secrets", lambda s: s["base"]))
    live = F.size(F.filter("secrets", lambda s: s["live"])).cast("long")
    most = lambda n: F.coalesce(F.array_max(F.transform("secrets", lambda s: s[n])), F.lit(0)).cast("long").alias(f"most_{n}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
        listed("secrets").alias("spans"), live.alias("n_live"), "n_copied", most("owners"), most("repos")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, {said} AS text UNION ALL SELECT -1L, 1L, 'assistant', {said}")
    chats = chat_format.format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = chats.select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])), ",")
    return license_scan.scan(read(spark, sf_dir, "documents")).withColumn("spans", spans)


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    written = warc.write(pages)
    return written.read(written.find(pages, "url", "page_id")).drop("url")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.bround("host_rate", 6).alias("host_rate"),
        "host_suspect"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_secrets, op2_decontaminate, op3_near_dedup, op4_chat_format, op5_quality_classifier,
            op6_license_scan, license_phrases, op7_warc, op8_quality_rules, op9_sentencepiece, op10_sharding
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": oracles.secret_spans(),
        "op4_chat_format": oracles.chats(),
        "license_phrases": oracles.license_phrases(),
        "op7_warc": oracles.WARC_SQL,
        "op8_quality_rules": oracles.rules(),
        "op10_sharding": oracles.sharding(SHARDS, SLOTS),
    }
