"""Dedupe, ranking, balancing, sharding, splitting and joins over keys. Order always comes from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.coerce import clamp, nonempty


def stable_hash(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def hash_share(key: Column) -> Column:
    """A number in [0, 1] that depends on the key only."""
    return F.conv(F.substring(stable_hash(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def split_of(key: Column, train: float = 0.8, val: float = 0.1) -> Column:
    share = hash_share(key)
    return F.when(share < train, "train").when(share < train + val, "val").otherwise("test")


def shard(df: DataFrame, key: str, shards: int, index: int) -> DataFrame:
    """Rows whose rank by key falls on a shard. Ranks need a global order: counts of range partitions, then ranks inside."""
    if not 0 <= index < shards:
        raise ValueError("shard index out of range")
    return ranked(df, [key]).where((F.col("rank0") % shards) == index).drop("rank0")


def ranked(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with rank0, its place in a global order, without moving all rows to one task."""
    spark = df.sparkSession
    parts = parts or max(2, spark.sparkContext.defaultParallelism)
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    inner = sorted_.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    # one row for each partition
    sizes = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return inner.join(F.broadcast(before), "_p").withColumn("rank0", F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def first_in_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_best(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The row of the best score for each key; no score counts as 0, and the first row wins ties."""
    return first_in_group(df, [key], [clamp(F.col(score)).desc(), F.col(order)])


def mark_duplicates(
    df: DataFrame, group: str, ranks: list[str], order: str, valid: str = "technical_valid",
    reason: str = "technical_reject_reason", keep: str = "keep_for_step2"
) -> DataFrame:
    """is_duplicate on all but the best row of a group (ranks falling, nulls as -1, then order); duplicates are invalid."""
    by = [F.coalesce(F.col(c), F.lit(-1)).desc() for c in ranks] + [F.col(order)]
    dup = F.row_number().over(W.partitionBy(group).orderBy(*by)) > 1
    marked = df.withColumn("is_duplicate", dup)
    return marked.withColumns(
        {
            valid: F.col(valid) & ~F.col("is_duplicate"),
            reason: F.when(F.col("is_duplicate"), "duplicate").otherwise(F.col(reason)),
            keep: F.col(keep) & ~F.col("is_duplicate")
        }
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_k(items: Column, less: list[tuple], k: int | Column) -> Column:
    """The k first of an array of structs by fields (name, descending), ties in array order."""
    n = F.size(items)
    tagged = F.transform(
        items,
        lambda x, i: F.struct(*[(-x[f] if d else x[f]).alias(f"k{j}") for j, (f, d) in enumerate(less)], i.alias("i"), x.alias("x"))
    )
    return F.transform(F.slice(F.array_sort(tagged), F.lit(1), F.least(n, k if isinstance(k, Column) else F.lit(k))), lambda t: t["x"])


def sample_order(seed: int, key: Column) -> Column:
    """A shuffled order that depends on seed and key only."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


#: Parts of the shuffled order that a cell is counted in.
SLICES = 1 << 12


def _slice(seed: int, key: Column) -> Column:
    """The part of the shuffled order that a key falls in: its first three hexadecimal digits."""
    return F.conv(F.substring(sample_order(seed, key), 1, 3), 16, 10).cast("int")


def first_of_cells(df: DataFrame, cells: list[str], key: str, seed: int, most: DataFrame | Column | int) -> DataFrame:
    """The first `most` rows of each cell in shuffled order (most: a number, a scalar, or cells and _most of each).

    Slices of the order are counted for each cell, at most SLICES rows of a cell. Rows of slices that end within the
    bound all stay, those of slices that begin beyond it go; only rows of the one slice in between are ranked. So no
    task sorts a cell, and the rows that stay aren't shuffled for ranking."""
    marked = df.withColumn("_slice", _slice(seed, F.col(key)))
    counts = marked.groupBy(*cells, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*cells).orderBy("_slice")
    counts = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    counts = _null_safe(counts, most, cells) if isinstance(most, DataFrame) else counts.withColumn("_most", F.lit(most))
    # of each cell, the slice in which the bound falls, and the rows before that slice
    cut = counts.where(F.col("_upto") > F.col("_most")).groupBy(*cells).agg(
        F.min(F.struct("_slice", (F.col("_upto") - F.col("_c")).alias("before"), "_most")).alias("_cut")
    )
    placed = _null_safe(marked, cut, cells, "left") if cells else marked.withColumn("_cut", cut.select("_cut").scalar())
    whole = placed.where(F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut._slice")))
    part = placed.where(F.col("_slice") == F.col("_cut._slice"))
    rank = F.row_number().over(W.partitionBy(*cells, "_slice").orderBy(sample_order(seed, F.col(key)), F.col(key)))
    some = part.withColumn("_n", rank).where(F.col("_n") <= F.col("_cut._most") - F.col("_cut.before"))
    return whole.select(*df.columns).unionAll(some.select(*df.columns))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by a shuffled order, or all if there are no more; in no particular order."""
    return first_of_cells(df, [], key, seed, n)


def balance(df: DataFrame, cells: list[str], key: str, seed: int, inner: str | None = None) -> DataFrame:
    """As many rows of each cell as the smallest has. inner: first as many of each inner kind of a cell as its rarest has."""
    if inner:
        names = df.columns
        df = df.withColumn("_kind", F.coalesce(F.when(F.col(inner) != "", F.col(inner)), F.lit("unknown")))
        kinds = df.groupBy(*cells, "_kind").agg(F.count(F.lit(1)).alias("_c"))
        least = _null_safe(kinds, kinds.groupBy(*cells).agg(F.min("_c").alias("_most")), cells).drop("_c")
        df = first_of_cells(df, [*cells, "_kind"], key, seed, least).select(*names)
    return first_of_cells(df, cells, key, seed, df.groupBy(*cells).count().agg(F.min("count")).scalar())


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other = b.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def resume(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs whose key isn't among those done, whatever their outcome; nulls are equal."""
    return _null_safe(jobs, done.select(*keys), keys, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias(key)), key, "left_semi")


def required(df: DataFrame, other: DataFrame, keys: list[str], what: str) -> DataFrame:
    """A left join that raises where the other side has no row."""
    got = df.join(other.withColumn("_found", F.lit(True)), keys, "left")
    checked = F.when(
        F.col("_found").isNull(),
        F.raise_error(F.concat(F.lit(f"no {what} for "), F.concat_ws("/", *keys))).cast("boolean")
    ).otherwise(F.lit(True))
    return got.where(checked).drop("_found")


def lookups(results: DataFrame, plans: DataFrame, anchors: DataFrame, manifests: DataFrame) -> DataFrame:
    """Results with plan and anchor by sample and anchor, and manifest by sample, each as a struct or null."""
    pack = lambda df, keys, name: df.select(*keys, F.struct(*[F.col(c) for c in df.columns]).alias(name))
    both = ["sample_id", "anchor_id"]
    return results.join(pack(plans, both, "plan"), both, "left").join(pack(anchors, both, "anchor"), both, "left").join(
        pack(manifests, ["sample_id"], "manifest"), "sample_id", "left"
    )


def relation_count(relations: Column, anchor_id: Column) -> Column:
    """Edges that touch an anchor; a loop counts once."""
    return F.size(
        F.filter(
            F.coalesce(relations, F.array().cast("array<struct<subject_anchor_id:string,object_anchor_id:string>>")),
            lambda r: (r["subject_anchor_id"] == anchor_id) | (r["object_anchor_id"] == anchor_id)
        )
    )


def relation_edges(anchors: DataFrame, sample: str = "sample_id", anchor: str = "anchor_id", relations: str = "relations") -> DataFrame:
    """Distinct edges between anchors of a sample that both exist, numbered in order of the source anchor and its relations.

    An anchor's targets meet the set of its sample's anchors (those of one image), so that only edges that exist become
    rows. The relations of an anchor move once at most: not at all where the anchors are dealt out by sample."""
    ends = anchors.groupBy(sample).agg(F.collect_set(anchor).alias("_ends"))
    lists = anchors.select(sample, F.col(anchor).alias("subject"), F.col(relations).alias("_asked"))
    # joined by hash, so that the lists aren't sorted; those that name no anchor of the sample go before any is taken apart
    met = lists.join(ends.hint("shuffle_hash"), sample).where(F.arrays_overlap("_asked.target_anchor_id", "_ends"))
    numbered = F.transform("_asked", lambda r, i: F.struct(r["type"].alias("type"), r["target_anchor_id"].alias("to"), i.alias("pos")))
    known = met.select(sample, "subject", F.explode(F.filter(numbered, lambda r: F.array_contains("_ends", r["to"]))).alias("r"))
    firsts = known.groupBy(
        sample, "subject", F.col("r.type").alias("predicate"), F.col("r.to").alias("object")
    ).agg(F.min("r.pos").alias("pos"))
    return firsts.withColumn("relation_index", F.row_number().over(W.partitionBy(sample).orderBy("subject", "pos")) - 1).drop("pos")


def entity_pairs(phrases: DataFrame, anchors: DataFrame, phrase: str, words: str, sample: str = "sample_id") -> DataFrame:
    """Pairs of the distinct phrases (_p) and anchor texts (_t) of a sample that share a word, a head's lemma or all of
    their text, with match_score. No other pair scores above 0."""
    def distinct(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(sample, F.col(column).alias(name)).distinct().withColumn(f"{name}_terms", text.match_terms(F.col(name)))

    def by_term(df: DataFrame, name: str) -> DataFrame:
        t = F.col(f"{name}_terms")
        marks = F.array(F.concat(F.lit("="), t["text"]), F.concat(F.lit("~"), nonempty(t["lemma"])))
        held = F.array_compact(F.concat(t["words"], marks))
        return df.where(t["text"] != "").select(sample, name, F.explode(held).alias("_term"))

    said, held = distinct(phrases, phrase, "_p"), distinct(anchors, words, "_t")
    pairs = by_term(said, "_p").join(by_term(held, "_t"), [sample, "_term"]).select(sample, "_p", "_t").distinct()
    scored = pairs.join(said, [sample, "_p"]).join(held, [sample, "_t"])
    return scored.select(sample, "_p", "_t", text.match_points(F.col("_p_terms"), F.col("_t_terms")).alias("match_score"))


def resolve_entities(
    phrases: DataFrame, anchors: DataFrame, phrase: str, words: str, order: str, sample: str = "sample_id",
    key: str = "phrase_id", least: float = 2.5
) -> DataFrame:
    """Of each phrase, the anchor of its sample with the best match_score, the first of equals, if it reaches least (above 0).

    Each phrase and anchor text of a sample is compared once, however many rows have it, and only with those that it has a
    term in common with."""
    firsts = first_in_group(anchors, [sample, words], [F.col(order)]).withColumnRenamed(words, "_t")
    pairs = entity_pairs(phrases, anchors, phrase, words, sample).where(F.col("match_score") >= least)
    best = first_in_group(pairs.join(firsts, [sample, "_t"]), [sample, "_p"], [F.desc("match_score"), F.col(order)])
    found = phrases.join(best.withColumnRenamed("_p", phrase), [sample, phrase]).withColumnRenamed("_t", words)
    return first_in_group(found, [sample, key], [F.desc("match_score"), F.col(order)]).select(
        *phrases.columns, *[n for n in anchors.columns if n != sample], "match_score"
    )


def eligible_groups(df: DataFrame, key: str, keep: str) -> DataFrame:
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.bool_or(F.coalesce(F.col(keep), F.lit(False))).alias("_any")
    ).where("_any").select(key)


def dedupe_across(df: DataFrame, keys: list[str], fingerprint: Column, rank: Column, order: str) -> DataFrame:
    """Of each fingerprint in a group, the row of the lowest rank, the first of equals."""
    return df.withColumn("_f", fingerprint).transform(lambda d: first_in_group(d, [*keys, "_f"], [rank, F.col(order)])).drop("_f")


def ordering_warnings(best: DataFrame, keys: list[str], rank: str, score: str, gap: float = 0.05) -> DataFrame:
    """tier_ordering_warning where a later rank's best score falls short of the best before it by more than gap."""
    before = F.max(score).over(W.partitionBy(*keys).orderBy(rank).rowsBetween(W.unboundedPreceding, -1))
    return best.withColumn("tier_ordering_warning", F.coalesce(F.col(score) < before - gap, F.lit(False)))
