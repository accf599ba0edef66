"""Queries of the library's own operators over the provided tables, and their SQL.

The tables hold no images or anchors: each operator runs on columns that stand in for its inputs. Every query reads its
tables whole; annotations, builds and files hold further ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import coerce, geometry, jsonops, routing, scoring, text
from sievework.operators import anchors, gates, relational, release

c = F.col
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name without q_, with its SQL."""

    def add(f):
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _registered() -> None:
    from sievework.plans import annotations, builds, files  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _registered()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores. A small table is one file of one or few row groups, so few tasks read it, however much is
    worked out for each row."""
    return df.repartition(max(24, 4 * df.sparkSession.sparkContext.defaultParallelism))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
LOWER = "lower(" + SQUEEZED + ")"
WORDS = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s'']+', ' ', 'g'), '\s+', ' ', 'g'))"
CLAMP = "greatest(0.0, least(1.0, {0}))"


def gate_sql(t: str, most: int) -> str:
    return f"""CASE WHEN {t} = '' THEN 'empty_text' WHEN contains(lower({t}), '[mask]') OR contains(lower({t}), '[fill]') OR contains(lower({t}), '[visual]') THEN 'prompt_markup_left_in_text'
WHEN len(string_split({t}, ' ')) < 3 THEN 'too_short' WHEN len(string_split({t}, ' ')) > {most} THEN 'too_long'
WHEN len(list_filter(list_distinct(string_split({t}, '')), lambda x: contains({t}, repeat(x, 5)))) > 0 THEN 'repeated_chars' ELSE 'ok' END"""


def share_sql(key: str) -> str:
    return f"(('0x' || substr(sha1({key}), 1, 8))::BIGINT / 4294967295.0)"


def split_sql(key: str) -> str:
    return f"CASE WHEN {share_sql(key)} < 0.8 THEN 'train' WHEN {share_sql(key)} < 0.8 + 0.1 THEN 'val' ELSE 'test' END"


GATED = f"SELECT doc_id, {gate_sql('t', 400)} AS reason FROM (SELECT doc_id, {SQUEEZED.format('text')} AS t FROM documents)"


@query(GATED)
def q_text_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.text_reason(c("text"), most=400).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM ({GATED}) WHERE reason <> 'ok' GROUP BY reason")
def q_reason_counts(spark, sf_dir):
    why = gates.text_reason(c("text"), most=400)
    found = table(spark, sf_dir, "documents").select(gates.filter_reason(gates.reasons((F.lit(True), gates.broken(why)))).alias("filter_reason"))
    _, refused = gates.kept_and_quarantined(found)
    return refused.select(F.explode(F.split("filter_reason", ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {split_sql('doc_id::VARCHAR')} AS split FROM documents")
def q_hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", relational.split_of(c("doc_id").cast("string")).alias("split"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 7 = 3")
def q_shard_items(spark, sf_dir):
    return relational.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 3)


_ID = "l_orderkey::VARCHAR, l_partkey::VARCHAR, 'image_only', l_returnflag, l_linestatus, 'low', 'high', l_linenumber::VARCHAR, 'a b', 'x.png'"


@query(
    f"""SELECT l_orderkey, l_partkey, l_linenumber, concat_ws('__', l_orderkey::VARCHAR, l_partkey::VARCHAR, 'image_only', l_linestatus, 'low', 'high', l_linenumber::VARCHAR, substr(sha1(concat_ws('|', {_ID})), 1, 10)) AS pair_id FROM lineitem"""
)
def q_pair_id(spark, sf_dir):
    s = lambda n: c(n).cast("string")
    made = release.pair_id(
        s("l_orderkey"), s("l_partkey"), F.lit("image_only"), c("l_returnflag"), c("l_linestatus"),
        F.lit("low"), F.lit("high"), c("l_linenumber"), F.lit(" a  b"), F.lit("x.png")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", made.alias("pair_id"))


@query(
    "SELECT l_orderkey, l_partkey, l_linenumber, ('0x' || substr(sha256(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_linenumber::VARCHAR)), 1, 8))::BIGINT AS seed FROM lineitem"
)
def q_job_seed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        routing.job_seed(*[c(n).cast("string") for n in ("l_orderkey", "l_partkey", "l_linenumber")]).alias("seed")
    )


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({WORDS.format("coalesce(text, '')")}, ' '), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0.0 ELSE 1.0 - len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS change
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def q_lexical_change(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (c("turn") + 1).alias("turn"), c("text").alias("before"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", text.lexical_change(c("text"), c("before")).alias("change"))


@query(
    f"SELECT doc_id, md5({WORDS.format('text')}) AS words_md5, md5({LOWER.format('text')}) AS lower_md5, md5(trim(lower(concat_ws(' ', lang, text)))) AS joined_md5 FROM documents"
)
def q_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.words_only(c("text"))).alias("words_md5"),
        F.md5(text.lower_squeezed(c("text"))).alias("lower_md5"),
        F.md5(text.lower_joined(c("lang"), c("text"))).alias("joined_md5")
    )


PHRASE = "'  The ' || p_name || ' of a ' || lower(p_type) || ' - ,'"
SPAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + LOWER.format(PHRASE) + r", '^[-–—:;,.\s]+', ''), '[-–—:;,.\s]+$', ''), '\b(the|a|an)\b\s+', '', 'g'), '\s+', ' ', 'g'))"


def phrase():
    return F.concat(F.lit("  The "), "p_name", F.lit(" of a "), F.lower("p_type"), F.lit(" - ,"))


@query(f"SELECT p_partkey, {SPAN} AS span, {SPAN} IN ({sql_list(text.GENERIC_SPANS)[1:-1]}) OR length({SPAN}) <= 2 AS generic FROM part")
def q_span_normalize(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select("p_partkey", text.normal_span(phrase()).alias("span"), text.is_generic_span(phrase()).alias("generic"))


def contains_any_sql(t: str, words: list[str]) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({t}, w))) > 0"


def tag_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {contains_any_sql(t, words)} THEN '{tag}'" for tag, words in text.SPAN_TAGS.items()) + " ELSE 'object' END"


@query(f"SELECT p_partkey, {tag_sql('span')} AS tag FROM (SELECT p_partkey, {SPAN} AS span FROM part)")
def q_infer_tag(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select("p_partkey", text.span_tag(phrase()).alias("tag"))


def tier_sql(t: str, part: str) -> str:
    values = {
        "tier": ("'{0}'", "'tier_b'", "'tier_a'"), "prior": ("{1}", "0.5", "0.2"),
        "reason": ("list_filter({2}, lambda w: contains({3}, w))[1]", "'category_fallback'", "'default_fallback'")
    }[part]
    cases = " ".join(
        f"WHEN {contains_any_sql(t, scoring.TIER_WORDS[k])} THEN {values[0].format(k, p, sql_list(scoring.TIER_WORDS[k]), t)}" for k,
        p in scoring.PLAN_PRIORS.items()
    )
    return f"CASE {cases} WHEN {contains_any_sql(t, ['person', 'face', 'logo', 'sign', 'text'])} THEN {values[1]} ELSE {values[2]} END"


@query(
    f"SELECT p_partkey, {tier_sql('t', 'tier')} AS tier, CAST({tier_sql('t', 'prior')} AS DOUBLE) AS prior, {tier_sql('t', 'reason')} AS reason FROM (SELECT p_partkey, {LOWER.format('p_name' + chr(39).join(['||', ' | ', '||']) + 'p_type')} AS t FROM part)"
)
def q_object_tier(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey", scoring.object_tier(c("p_name"), c("p_type")).alias("t")
    ).select("p_partkey", "t.tier", "t.prior", "t.reason")


LAST = "string_split(p_name, ' ')[-1]"
SINGULAR = "CASE WHEN ends_with({0}, 'ies') AND length({0}) > 4 THEN left({0}, -3) || 'y' WHEN ends_with({0}, 'ses') AND length({0}) > 4 THEN left({0}, -2) WHEN ends_with({0}, 's') AND length({0}) > 3 AND NOT ends_with({0}, 'ss') THEN left({0}, -1) ELSE {0} END"
PLURAL = "CASE WHEN regexp_matches({0}, '[^aeiou]y$') AND length({0}) > 2 THEN left({0}, -1) || 'ies' WHEN ends_with({0}, 's') THEN {0} ELSE {0} || 's' END"


@query(f"""SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, {SINGULAR.format('w')} AS singular, {PLURAL.format('w')} AS plural
FROM (SELECT p_partkey, {LAST} || 's' AS w, substr(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS s FROM part)""")
def q_word_forms(spark, sf_dir):
    word = F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("s"))
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"),
        text.singular(word).alias("singular"), text.plural(word).alias("plural")
    )


@query(f"""WITH a AS (SELECT p_partkey, lower(p_name) || ' in the ' || lower(p_type) || ' scene view' AS t FROM part),
b AS (SELECT p_partkey, t, list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda x: NOT list_contains({sql_list(text.STOPWORDS)}, x)) AS f FROM a),
d AS (SELECT *, list_position(list_transform(f, lambda x: list_contains({sql_list(text.SCENE_TOKENS)}, x)), true) AS s, f[-1] AS h FROM b),
e AS (SELECT *, CASE WHEN coalesce(s, 0) > 0 THEN array_to_string(f[1:s-1], ' ') ELSE array_to_string(f, ' ') END AS k, {SINGULAR.format('h')} AS l FROM d)
SELECT p_partkey, concat_ws('|', t, CASE WHEN k <> '' AND k <> t THEN k END, CASE WHEN h NOT IN (t, k) THEN h END, CASE WHEN l NOT IN (t, k, h) THEN l END) AS queries FROM e""")
def q_candidate_queries(spark, sf_dir):
    t = F.concat(F.lower("p_name"), F.lit(" in the "), F.lower("p_type"), F.lit(" scene view"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.array_join(text.candidate_queries(t, F.lit("object")), "|").alias("queries"))


_NAMED = "text || CASE doc_id % 3 WHEN 0 THEN ' the Refugee  council' WHEN 1 THEN ' on race and religion' ELSE '' END"


@query(
    f"SELECT doc_id, array_to_string(list_filter({sql_list(gates.CONTEXT_TERMS)}, lambda w: contains(t, w)), ',') AS hits FROM (SELECT doc_id, {LOWER.format(_NAMED)} AS t FROM documents) WHERE len(list_filter({sql_list(gates.CONTEXT_TERMS)}, lambda w: contains(t, w))) > 0"
)
def q_sensitive_hits(spark, sf_dir):
    """Texts of the table name no term, so some get one."""
    hits = table(spark, sf_dir, "documents").select("doc_id", gates.term_hits(F.expr(_NAMED), gates.CONTEXT_TERMS).alias("h"))
    return hits.where(F.size("h") > 0).select("doc_id", F.array_join("h", ",").alias("hits"))


@query(f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda x: {SQUEEZED.format('x')}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|')) AS units_md5 FROM a""")
def q_clean_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(F.array_join(coerce.clean_string_list(F.split("text", r"[.\n]")), "|")).alias("units_md5")
    )


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS repaired_md5 FROM conversations")
def q_mojibake(spark, sf_dir):
    broken = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(coerce.repaired_utf8(broken)).alias("repaired_md5"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n noise "), "props", F.lit(" \n```"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(jsonops.parsed(fenced), "$.k", "bigint").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_repair(spark, sf_dir):
    cut = F.concat(F.lit('{"a": [{"k": 1}, '), "props", F.lit(', {"cut'))
    got = jsonops.extracted(cut)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(got), "$.a[1].k", "bigint").alias("k"))


@query(
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
)
def q_keyed_last_wins(spark, sf_dir):
    from sievework.sources.scans import last_wins

    return last_wins(
        table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], blank=True
    ).select("user_id", "event_type", "event_id", "value")


@query(
    "SELECT doc_id, source, lang FROM (SELECT d.*, row_number() OVER (PARTITION BY source, lang ORDER BY greatest(0.0, least(1.0, coalesce(quality, 0)::DOUBLE)) DESC, doc_id) AS n FROM documents d LEFT JOIN labels USING (doc_id)) WHERE n = 1"
)
def q_dedupe_best(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    ).withColumn("cell", F.concat_ws("|", "source", "lang"))
    return relational.dedupe_best(both, "cell", "quality", "doc_id").select("doc_id", "source", "lang")


@query(f"""SELECT doc_id, n > 1 AS is_duplicate, valid AND n = 1 AS technical_valid, CASE WHEN n > 1 THEN 'duplicate' WHEN NOT valid THEN 'short' END AS technical_reject_reason
FROM (SELECT doc_id, n_chars >= 500 AS valid, row_number() OVER (PARTITION BY md5({WORDS.format('text')}) ORDER BY coalesce(quality, -1) DESC, n_chars DESC, doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id))""")
def q_mark_duplicates(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    valid = c("n_chars") >= 500
    rows = both.select(
        "doc_id", "quality", "n_chars", F.md5(text.words_only(c("text"))).alias("g"),
        valid.alias("technical_valid"), F.when(~valid, "short").alias("technical_reject_reason"),
        valid.alias("keep_for_step2")
    )
    return relational.mark_duplicates(rows, "g", ["quality", "n_chars"], "doc_id").select(
        "doc_id", "is_duplicate", "technical_valid", "technical_reject_reason"
    )


SEVERITY = "CASE o_orderstatus WHEN 'O' THEN 'low' WHEN 'P' THEN 'medium' ELSE 'high' END"


def severity():
    return F.when(c("o_orderstatus") == "O", "low").when(c("o_orderstatus") == "P", "medium").otherwise("high")


@query(
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def q_dedupe_across_tiers(spark, sf_dir):
    return relational.dedupe_across(
        table(spark, sf_dir, "orders"), ["o_custkey"], c("o_orderpriority"),
        scoring.severity_rank(severity()), "o_orderkey"
    ).select("o_orderkey")


@query(f"""WITH a AS (SELECT *, {SEVERITY} AS severity, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS f FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS k FROM a WHERE f = 1 AND o_totalprice / 500000.0 >= CASE severity WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.15 ELSE 0.0 END)
SELECT o_orderkey, severity, CAST(k AS INTEGER) AS candidate_index FROM b WHERE k < 2""")
def q_edit_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("sample_id"), F.lit("a1").alias("anchor_id"), severity().alias("severity"),
        c("o_orderkey").alias("pos"), c("o_orderpriority").alias("edited_anchor"),
        F.lit("[FILL] x; [VISUAL] y").alias("edit_instruction"),
        (c("o_totalprice") / 500000.0).alias("planned_score_raw"), F.lit(0.1).alias("mask_ratio"),
        F.lit("").alias("occlusion")
    )
    return anchors.edit_jobs(rows).select(c("raw_index").alias("o_orderkey"), "severity", "candidate_index")


@query(
    """SELECT l_orderkey, l_partkey, l_extendedprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS r FROM lineitem) WHERE r <= 2"""
)
def q_topk_per_group(spark, sf_dir):
    return relational.top_k(
        table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), c("l_partkey")], 2
    ).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query("""WITH b AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank, max(o_totalprice) AS best FROM orders GROUP BY ALL)
SELECT o_custkey, rank, best, coalesce(best < max(best) OVER (PARTITION BY o_custkey ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000, false) AS tier_ordering_warning FROM b""")
def q_candidate_sort_warning(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy(
        "o_custkey", scoring.severity_rank(severity()).alias("rank")
    ).agg(F.max("o_totalprice").alias("best"))
    return relational.ordering_warnings(best, ["o_custkey"], "rank", "best", 1000)


@query("""WITH d AS (SELECT doc_id, lang, quality, sha256('7|' || doc_id::VARCHAR) AS s FROM documents JOIN labels USING (doc_id)), n AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY s, doc_id) AS k, count(*) OVER (PARTITION BY lang, quality) AS m FROM d)
SELECT doc_id, lang, quality FROM n WHERE k <= (SELECT min(m) FROM n)""")
def q_balance_cells(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return relational.balance(both, ["lang", "quality"], "doc_id", 7).select("doc_id", "lang", "quality")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS kind, sha256('5|' || o_orderkey) AS s FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, kind ORDER BY s, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus, kind) AS m FROM o),
b AS (SELECT * FROM a JOIN (SELECT o_orderstatus, min(m) AS least FROM a GROUP BY o_orderstatus) USING (o_orderstatus) WHERE k <= least), d AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY s, o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM b)
SELECT o_orderkey, o_orderstatus, kind FROM d WHERE n <= (SELECT min(c) FROM d)""")
def q_balance_kinds(spark, sf_dir):
    return relational.balance(
        table(spark, sf_dir, "orders").withColumn("kind", c("o_orderpriority")), ["o_orderstatus"],
        "o_orderkey", 5, "kind"
    ).select("o_orderkey", "o_orderstatus", "kind")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q_resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return relational.resume(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def q_id_semi(spark, sf_dir):
    return relational.only(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000"),
        "c_custkey", "o_custkey"
    ).select("c_custkey", "c_name")


def line_anchors(spark, sf_dir) -> DataFrame:
    """Parts of an order as anchors; each points to the two next part numbers."""
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("sample_id"), c("l_partkey").alias("anchor_id"))
    # dealt out by sample before they get their relations, which then don't move
    dealt = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample_id").distinct()
    to = lambda k: F.struct(F.lit("near").alias("type"), (c("anchor_id") + k).alias("target_anchor_id"))
    return dealt.withColumn("relations", F.array(*[to(k) for k in range(1, 201)]))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS sample_id, l_partkey AS anchor_id FROM lineitem)
SELECT s.sample_id, s.anchor_id AS subject, t.anchor_id AS object, 'near' AS predicate, CAST(row_number() OVER (PARTITION BY s.sample_id ORDER BY s.anchor_id, t.anchor_id) - 1 AS INTEGER) AS relation_index
FROM a s JOIN a t ON s.sample_id = t.sample_id AND t.anchor_id BETWEEN s.anchor_id + 1 AND s.anchor_id + 200""")
def q_relation_edges(spark, sf_dir):
    return relational.relation_edges(line_anchors(spark, sf_dir))


@query("""WITH e AS (SELECT l_orderkey AS o, l_partkey AS a, l_suppkey AS b FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS k FROM lineitem)
SELECT d.o AS l_orderkey, d.k AS l_suppkey, CAST(count(*) FILTER (WHERE e.a = d.k OR e.b = d.k) AS INTEGER) AS relation_count FROM d JOIN e ON d.o = e.o GROUP BY d.o, d.k""")
def q_relation_count(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    s = lambda n: c(n).cast("string")
    edges = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(s("l_partkey").alias("subject_anchor_id"), s("l_suppkey").alias("object_anchor_id"))).alias("relations")
    )
    return lines.select("l_orderkey", "l_suppkey").distinct().join(edges, "l_orderkey").select(
        "l_orderkey", "l_suppkey",
        relational.relation_count(c("relations"), s("l_suppkey")).alias("relation_count")
    )


def order_manifests(spark, sf_dir) -> DataFrame:
    """Orders as manifests, their lines as anchors."""
    n = F.lit(None)
    stats = F.struct(F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), (c("l_quantity") * 200).alias("foreground_area_px"))
    best = F.struct(
        (c("l_discount") * 10).alias("score"), c("l_tax").alias("precision_score"),
        n.cast("double").alias("qwen_verify_score"),
        F.array(F.lit(0.0), F.lit(0.0), c("l_quantity"), c("l_quantity")).alias("box_xyxy")
    )
    anchor = F.struct(
        c("l_linenumber").alias("ord"),
        c("l_partkey").alias("part"),
        c("l_suppkey").alias("supp"),
        F.concat(F.lit("l"), c("l_linenumber").cast("string")).alias("anchor_id"),
        F.concat(F.lit("part "), (c("l_partkey") % 3).cast("string")).alias("anchor_text"),
        n.cast("string").alias("anchor_norm"),
        F.lit("Object").alias("category"),
        n.cast("array<string>").alias("semantic_tags"),
        n.cast("string").alias("functional_role"),
        n.cast("string").alias("attributes_text"),
        F.lit("ok").alias("status"),
        F.when(c("l_linestatus") == "O", "ok").otherwise("failed").alias("grounding_status"),
        F.lit("m.png").alias("union_mask_path"),
        stats.alias("union_mask_stats"),
        best.alias("best_detection"),
        n.cast("array<struct<score:double>>").alias("detections"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))
    return lines.select(
        c("l_orderkey").cast("string").alias("sample_id"), F.lit("i.png").alias("image_path"),
        F.lit("h").alias("headline"), F.lit("s").alias("summary"),
        F.struct(F.lit("c").alias("image_caption_literal")).alias("caption"),
        F.struct(F.lit("g").alias("grounded_context_caption")).alias("anchors_meta"), "anchors",
        n.cast("array<struct<subject_anchor_id:string,object_anchor_id:string>>").alias("relations")
    )


_FLAT = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_quantity * 200 / 10000.0 AS mr, l_discount * 10 AS gs FROM lineitem),
q AS (SELECT *, CASE WHEN l_linestatus <> 'O' THEN 'status_not_ok' WHEN mr < 0.002 THEN 'mask_too_small' WHEN mr > 0.6 THEN 'mask_too_large' WHEN gs < 0.35 THEN 'low_grounding_score' END AS why,
row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY gs DESC, l_quantity * 200 DESC, pos) AS n FROM r)"""


@query(_FLAT + """ SELECT l_orderkey::VARCHAR AS sample_id, 'l' || l_linenumber AS anchor_id, 'part ' || (l_partkey % 3) AS anchor_norm, mr AS mask_ratio, CASE WHEN mr < 0.05 THEN 'small' WHEN mr < 0.25 THEN 'medium' ELSE 'large' END AS size_band, gs AS grounding_score,
why IS NULL AND n = 1 AS keep_for_step2, n > 1 AS is_duplicate, CASE WHEN n > 1 THEN 'duplicate' ELSE why END AS technical_reject_reason FROM q""")
def q_flatten_nested(spark, sf_dir):
    return anchors.editable(order_manifests(spark, sf_dir)).select(
        "sample_id", "anchor_id", "anchor_norm", "mask_ratio", "size_band", "grounding_score",
        "keep_for_step2", "is_duplicate", "technical_reject_reason"
    )


@query(_FLAT + " SELECT l_orderkey::VARCHAR AS sample_id FROM q GROUP BY l_orderkey HAVING bool_or(why IS NULL AND n = 1)")
def q_eligible_groups(spark, sf_dir):
    return relational.eligible_groups(anchors.editable(order_manifests(spark, sf_dir)), "sample_id", "keep_for_step2")


def labelled_examples(spark, sf_dir) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select(
        "doc_id", c("lang").alias("modality"),
        F.when(c("quality") == 1, "low").when(c("quality") == 0, "high").alias("severity_label"),
        F.when(c("toxic") == 1, "high").when(c("toxic") == 0, "low").alias("requested_generation_severity"),
        F.lit("replace").alias("edit_type_requested"), c("source").alias("edit_type_effective"),
        relational.split_of(c("doc_id").cast("string")).alias("split"),
        (c("n_chars") / 20000).alias("severity_score")
    )


@query(f"""WITH e AS (SELECT doc_id, text, lang, source, CASE quality WHEN 1 THEN 'low' WHEN 0 THEN 'high' END AS sev, CASE toxic WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS req, {split_sql('doc_id::VARCHAR')} AS split FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT 'modality' AS counter, lang AS value FROM e UNION ALL SELECT 'severity', sev FROM e UNION ALL SELECT 'requested_severity', req FROM e UNION ALL SELECT 'edit_type', source FROM e UNION ALL SELECT 'split', split FROM e
UNION ALL SELECT 'requested_to_final', req || '->' || sev FROM e UNION ALL SELECT 'requested_to_effective', 'replace->' || source FROM e UNION ALL SELECT 'modality_severity', lang || '|' || sev FROM e UNION ALL SELECT 'quarantine_reason', reason FROM ({GATED}) WHERE reason <> 'ok')
SELECT counter, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY counter, value""")
def q_release_stats(spark, sf_dir):
    refused = q_text_gate(spark, sf_dir).where("reason <> 'ok'").select(c("reason").alias("filter_reason"))
    return release.stats(labelled_examples(spark, sf_dir), refused)


@query(
    "SELECT count(*) AS num_examples, round_even(avg(n_chars / 20000), 6) AS mean, round_even(min(n_chars / 20000), 6) AS min, round_even(max(n_chars / 20000), 6) AS max FROM documents"
)
def q_score_summary(spark, sf_dir):
    return release.score_summary(labelled_examples(spark, sf_dir))


@query(f"SELECT {SEVERITY} || '->' || o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL")
def q_transitions(spark, sf_dir):
    return release.counted(table(spark, sf_dir, "orders"), F.concat(severity(), F.lit("->"), "o_orderpriority"), "transition").select("value", "n")


LINE = "l_orderkey, l_partkey, l_linenumber"
SCORE = f"{CLAMP.format(f'0.35 * {CLAMP.format("l_discount * 8")} + 0.25 * {CLAMP.format("l_tax * 10")} + 0.20 * {CLAMP.format("l_quantity / 50")} + 0.15 * {CLAMP.format("l_discount * 10")} + 0.05 * (1.0 - {CLAMP.format("l_tax * 12")})')}"


def line_score():
    return scoring.severity_score(c("l_discount") * 8, c("l_tax") * 10, c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 12)


@query(f"SELECT {LINE}, {SCORE} AS score FROM lineitem")
def q_severity_score(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", line_score().alias("score"))


POINTS = scoring.calibration_points([[0.1, 0.0], [0.4, 0.5], {"raw": 0.7, "calibrated": 0.6}, [0.9, 1.0]])


@query(f"""SELECT {LINE}, CASE WHEN s <= 0.1 THEN 0.0 WHEN s >= 0.9 THEN 1.0 WHEN s <= 0.4 THEN {CLAMP.format('0.0 + (s - 0.1) / (0.4 - 0.1) * 0.5')} WHEN s <= 0.7 THEN {CLAMP.format('0.5 + (s - 0.4) / (0.7 - 0.4) * (0.6 - 0.5)')}
ELSE {CLAMP.format('0.6 + (s - 0.7) / (0.9 - 0.7) * (1.0 - 0.6)')} END AS calibrated FROM (SELECT {LINE}, CAST({SCORE} AS DOUBLE) AS s FROM lineitem)""")
def q_calibrate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        scoring.calibrated(line_score(), POINTS).alias("calibrated")
    )


@query(
    f"SELECT {LINE}, CASE WHEN s <= 0.3 THEN 'low' WHEN s <= 0.6 THEN 'medium' ELSE 'high' END AS release_bucket, CASE WHEN s <= 0.18 THEN 'low' WHEN s <= 0.45 THEN 'medium' ELSE 'high' END AS plan_bucket FROM (SELECT {LINE}, l_tax * 8 AS s FROM lineitem)"
)
def q_bucket(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", scoring.bucket(c("l_tax") * 8).alias("release_bucket"),
        scoring.bucket(c("l_tax") * 8, scoring.PLAN_BUCKETS).alias("plan_bucket")
    )


@query(f"""SELECT {LINE}, {CLAMP.format('0.65 * ' + CLAMP.format(CLAMP.format('l_tax') + ' / 0.15') + ' + 0.35 * ' + CLAMP.format('l_discount * 9'))} AS visibility,
{CLAMP.format('0.40 * (CASE WHEN contains(lower(p_type), lower(p_name)) THEN 1.0 ELSE 0.0 END) + 0.25 * ' + CLAMP.format('l_linenumber / 3.0') + ' + 0.20 * ' + CLAMP.format('l_tax / 0.10') + ' + 0.15 * 0.0')} AS salience
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def q_proxies(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    sal = scoring.salience_terms(c("l_linenumber"), c("l_tax"), F.lit("thing"), c("p_type"), F.lit(""), c("p_name"))
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        scoring.visibility_proxy(c("l_tax"), c("l_discount") * 9).alias("visibility"),
        sal["proxy"].alias("salience")
    )


@query(
    f"""SELECT {LINE}, {CLAMP.format(f'0.35 * {CLAMP.format(CLAMP.format("l_discount * 8") + " * " + CLAMP.format("l_tax / 0.25"))} + 0.25 * {CLAMP.format("l_tax * 10")} + 0.20 * {CLAMP.format("l_quantity / 50")} + 0.15 * {CLAMP.format("l_discount * 10")} + 0.05 * (1.0 - {CLAMP.format("l_tax * 12")})')} AS planned FROM lineitem"""
)
def q_planned_score(spark, sf_dir):
    score = scoring.planned_score(c("l_discount") * 8, c("l_tax") * 10, c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 12, c("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", score.alias("planned"))


@query(f"""WITH j AS (SELECT {LINE}, CASE l_suppkey % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'replace' WHEN 2 THEN 'fill' WHEN 3 THEN 'attribute_change' ELSE 'tint' END AS op, CASE l_partkey % 4 WHEN 0 THEN 'red car' WHEN 1 THEN 'tall man' WHEN 2 THEN 'bag' ELSE 'sign' END AS who,
l_quantity / 100 AS area, l_tax * 60 AS aspect, l_discount * 5 AS compact, l_linenumber % 4 AS borders FROM lineitem), m AS (SELECT *, who = 'tall man' AS person, who = 'bag' AS attached FROM j)
SELECT {LINE}, CASE WHEN op IN ('attribute_change', 'fill') THEN 'requested_' || op WHEN op = 'tint' THEN 'unknown_operation_tint'
WHEN op = 'remove' THEN CASE WHEN attached AND area > 0.07 THEN 'body_attached_remove_unstable_rerouted' WHEN compact < 0.1 THEN 'remove_irregular_mask' WHEN (person OR attached) AND area > 0.26 THEN 'person_remove_too_large_rerouted' WHEN person OR attached THEN 'safe_person_remove' WHEN area > 0.3 THEN 'remove_too_large' ELSE 'safe_remove' END
ELSE CASE WHEN person THEN 'whole_person_replace_disallowed' WHEN aspect > 4.5 OR aspect < 0.2 THEN 'replace_strip_like_region' WHEN compact < 0.1 THEN 'replace_irregular_mask' WHEN attached AND area > 0.14 THEN 'person_like_replace_too_large_rerouted' WHEN attached THEN 'safe_person_local_replace'
WHEN borders >= 3 AND area > 0.45 THEN 'replace_border_touching_extreme' WHEN area > 0.4 THEN 'replace_too_large' WHEN borders >= 2 THEN 'replace_border_touching_allowed' WHEN area > 0.28 THEN 'safe_large_scene_replace' ELSE 'safe_replace' END END AS reason FROM m""")
def q_route_table(spark, sf_dir):
    pick = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    op, who = pick(
        c("l_suppkey"), ["remove", "replace", "fill", "attribute_change", "tint"]
    ), pick(c("l_partkey"), ["red car", "tall man", "bag", "sign"])
    none = F.lit("")
    # the flags are a column of their own, so that each rule reads them instead of working them out again
    jobs = table(spark, sf_dir, "lineitem").withColumns({"op": op, "who": who}).withColumn("meta", routing.anchor_meta(c("who"), none, none, none))
    way = routing.route(c("op"), c("meta"), c("l_quantity") / 100, c("l_tax") * 60, c("l_discount") * 5, c("l_linenumber") % 4, F.lit(False))
    return jobs.select("l_orderkey", "l_partkey", "l_linenumber", way.alias("way")).select("l_orderkey", "l_partkey", "l_linenumber", "way.reason")


def boxes(spark, sf_dir) -> DataFrame:
    """Sixteen boxes of a 100 by 100 image from each vector of 64 numbers, each of four: corner, sides and, by their sum, score."""
    at = lambda i: F.abs(F.get("embedding", (c("k") * 4 + i).cast("int")).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return rows.select(
        "vec_id", "k",
        F.array(at(0) * 200, at(1) * 200, at(0) * 200 + 20 + at(2) * 300, at(1) * 200 + 10 + at(3) * 300).alias("box"),
        F.least(F.lit(1.0), at(0) + at(1) + at(2) + at(3)).alias("score")
    )


_BOX = """v AS (SELECT vec_id, k, abs(embedding[4 * k + 1]::DOUBLE) AS p, abs(embedding[4 * k + 2]::DOUBLE) AS q, abs(embedding[4 * k + 3]::DOUBLE) AS r, abs(embedding[4 * k + 4]::DOUBLE) AS s FROM embeddings, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k)),
b AS (SELECT vec_id, k, p * 200 AS x1, q * 200 AS y1, p * 200 + 20 + r * 300 AS x2, q * 200 + 10 + s * 300 AS y2, least(1.0, p + q + r + s) AS score FROM v)"""


@query(f"""WITH {_BOX}, p AS (SELECT a.vec_id, a.k, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s FROM b a JOIN b c ON a.vec_id = c.vec_id AND c.k = a.k + 1)
SELECT vec_id, k, i / (s - i) AS iou FROM p""")
def q_box_iou(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    next_ = rows.select("vec_id", (c("k") - 1).alias("k"), c("box").alias("other"))
    return rows.join(next_, ["vec_id", "k"]).select("vec_id", "k", geometry.iou(c("box"), c("other")).alias("iou"))


def evaluated_sql(mode: str) -> str:
    """Rules of detections by category and mode, of a 60 by 60 image."""
    m = geometry.PRECISION[mode]
    people, large, scene, group = "cat = 'people'", "cat = 'building'", "cat = 'background'", "(cat = 'people' AND multi)"
    rules = [
        ("low_score", f"score < {m['score']}", 0.2),
        ("scene_level_box", f"cat IN ('people', 'object') AND a >= {m['sensitive']} AND NOT {group}", 0.45),
        ("scene_level_box", f"{group} AND a >= {m['people_group']}", 0.35),
        ("scene_level_box", f"{large} AND a >= {m['large']} AND NOT multi", 0.25),
        ("tiny_box", f"NOT {scene} AND a <= CASE WHEN {large} THEN {m['tiny_large']} ELSE {m['tiny']} END", 0.18),
        ("too_small_for_group", f"multi AND {people} AND a < {m['tiny'] * 8}", 0.2),
        ("full_frame_box", f"NOT {scene} AND w >= 0.98 AND h >= 0.98", 0.4),
        (None, f"NOT {scene} AND (a >= {m['sensitive']} OR (w >= {m['side']} AND h >= {m['side']}))", 0.1),
    ]
    why = ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit, _ in rules if name)
    less = " ".join(f"- CASE WHEN {hit} THEN {cost} ELSE 0.0 END" for _, hit, cost in rules)
    return f"SELECT vec_id, k, '{mode}' AS mode, round_even(a, 6) AS area_ratio, concat_ws(',', {why}) AS reasons, round_even(score {less}, 6) AS precision_score FROM e"


@query(f"""WITH {_BOX}, e AS (SELECT vec_id, k, score, CASE k % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'people' WHEN 2 THEN 'building' ELSE 'background' END AS cat, vec_id % 2 = 0 AS multi, (x2 - x1) * (y2 - y1) / 3600.0 AS a, (x2 - x1) / 60.0 AS w, (y2 - y1) / 60.0 AS h FROM b)
""" + " UNION ALL ".join(map(evaluated_sql, geometry.PRECISION)))  # fmt: skip
def q_evaluate_box(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumns(
        {"cat": F.get(F.array(*map(F.lit, ["object", "people", "building", "background"])), c("k") % 4), "multi": c("vec_id") % 2 == 0}
    )
    each = [
        rows.select(
            "vec_id", "k", F.lit(m).alias("mode"),
            geometry.evaluated(c("box"), c("score"), c("cat"), c("multi"), F.lit(60), F.lit(60), m).alias("e")
        ) for m in geometry.PRECISION
    ]
    return reduce(DataFrame.unionAll, each).select(
        "vec_id", "k", "mode", "e.area_ratio", F.array_join("e.rejection_reasons", ",").alias("reasons"),
        "e.precision_score"
    )


@query(f"""WITH RECURSIVE {_BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS r FROM b),
s AS (SELECT vec_id, r, [{{'k': k, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS held FROM o WHERE r = 1 UNION ALL
SELECT s.vec_id, o.r, CASE WHEN len(list_filter(s.held, lambda h: greatest(0.0, least(h.x2, o.x2) - greatest(h.x1, o.x1)) * greatest(0.0, least(h.y2, o.y2) - greatest(h.y1, o.y1)) / ((h.x2 - h.x1) * (h.y2 - h.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0.0, least(h.x2, o.x2) - greatest(h.x1, o.x1)) * greatest(0.0, least(h.y2, o.y2) - greatest(h.y1, o.y1))) > 0.3)) > 0
THEN s.held ELSE list_append(s.held, {{'k': o.k, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END FROM s JOIN o ON s.vec_id = o.vec_id AND o.r = s.r + 1)
SELECT vec_id, unnest(list_transform(held, lambda h: h.k)) AS k FROM s WHERE r = 16""")
def q_nms(spark, sf_dir):
    return geometry.nms(boxes(spark, sf_dir), ["vec_id"], limit=0.3, order=["k"]).select("vec_id", "k")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE * 25 - list_max(embedding)::DOUBLE * 25)) AS z FROM embeddings), s AS (SELECT vec_id, z[1] / list_sum(z) AS score, list_max(z[2:]) / list_sum(z) AS best_other FROM e)
SELECT vec_id, score, best_other, score >= 0.3 AND score - best_other >= 0.08 AS match FROM s""")
def q_clip_verify(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double") * 25)
    return spread(table(spark, sf_dir, "embeddings")).select(
        "vec_id", geometry.softmax_match(logits, 0).alias("m")
    ).select("vec_id", "m.score", "m.best_other", "m.match")


@query(
    "SELECT o_orderkey::VARCHAR AS pair_id, c_custkey::VARCHAR AS sample_id, o_totalprice AS severity_score, o_orderpriority AS severity_label, c_name AS headline_original FROM orders JOIN customer ON o_custkey = c_custkey"
)
def q_flat_export(spark, sf_dir):
    from sievework.sources.sinks import flat_rows

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    nested = rows.select(
        c("o_orderkey").cast("string").alias("pair_id"), c("c_custkey").cast("string").alias("sample_id"),
        c("o_totalprice").alias("severity_score"), c("o_orderpriority").alias("severity_label"),
        c("c_name").alias("headline_original"),
        F.struct(F.lit("x").alias("edited_anchor")).alias("explanation")
    )
    return flat_rows(nested, rich=True).select("pair_id", "sample_id", "severity_score", "severity_label", "headline_original")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, dedupe, balance, split and count."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    kept = docs.where(gates.text_reason(c("text"), most=5000) == "ok").withColumn("fingerprint", F.md5(text.words_only(c("text"))))
    best = relational.dedupe_best(kept, "fingerprint", "quality", "doc_id")
    even = relational.balance(best, ["lang", "quality"], "doc_id", 7)
    return even.withColumn(
        "split", relational.split_of(c("doc_id").cast("string"))
    ).groupBy("lang", "quality", "split").agg(F.count(F.lit(1)).alias("n"))
