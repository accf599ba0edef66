"""Queries of gates, planning, routing and the release build over the provided tables, and their SQL.

Order lines stand in for anchors and edits: orders are samples, parts are anchors, numbers are recorded measures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import routing, scoring, text
from sievework.operators import anchors, gates, inference, relational, release
from sievework.plans.catalogue import CLAMP, LINE, LOWER, SQUEEZED, contains_any_sql, gate_sql, query, split_sql, spread, sql_list, table

c = F.col


def clamped(x: str) -> str:
    return CLAMP.format(f"coalesce({x}, 0)")


_ARTICLE = "text || CASE doc_id % 4 WHEN 0 THEN ' The Refugee  council' WHEN 1 THEN ' on race and religion' ELSE '' END"
_EDITED = "CASE doc_id % 3 WHEN 0 THEN 'a Sikh guard' ELSE 'a red hat' END"


def hits_sql(t: str, terms: list[str]) -> str:
    return f"list_filter({sql_list(terms)}, lambda w: contains({t}, w))"


@query(f"""WITH a AS (SELECT doc_id, {hits_sql(LOWER.format(_ARTICLE), gates.CONTEXT_TERMS)} AS terms, {hits_sql("lower('put in a gay flag ' || " + _EDITED + ")", gates.EDIT_TERMS)} AS first, {hits_sql("lower('plain ' || " + _EDITED + ")", gates.EDIT_TERMS)} AS second FROM documents)
SELECT doc_id, array_to_string(terms, ',') AS terms, '0=' || array_to_string(first, ',') || CASE WHEN len(second) > 0 THEN '|1=' || array_to_string(second, ',') ELSE '' END AS hits FROM a WHERE len(terms) > 0""")
def q_sensitive_flags(spark, sf_dir):
    edit = lambda i, said: F.struct(
        F.lit("low").alias("severity"), F.lit(i).alias("candidate_index"),
        F.expr(_EDITED).alias("edited_anchor"), F.lit(said).alias("edit_instruction")
    )
    flag = gates.sensitive_flag(F.expr(_ARTICLE.replace("||", "||")), F.array(edit(0, "put in a gay flag"), edit(1, "plain")))
    rows = table(spark, sf_dir, "documents").select("doc_id", flag.alias("f")).where("f.flagged")
    shown = F.transform("f.edit_hits", lambda h: F.concat(h["candidate_index"].cast("string"), F.lit("="), F.array_join(h["matched_terms"], ",")))
    return rows.select("doc_id", F.array_join("f.context_terms_matched", ",").alias("terms"), F.array_join(shown, "|").alias("hits"))


_GATED_EDIT = f"""concat_ws(';', CASE WHEN l_quantity > 40 THEN 'edit_not_accepted' END, CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'edit_error' END, CASE WHEN {clamped('l_discount * 8')} < 0.35 THEN 'low_realism' END, CASE WHEN l_tax < 0.0025 THEN 'changed_ratio_too_low' END,
CASE WHEN l_tax * 15 > 0.95 THEN 'changed_ratio_too_high' END, CASE WHEN l_quantity / 10 < 1.5 THEN 'masked_delta_too_low' END, CASE WHEN l_suppkey % 7 = 0 THEN 'sensitive_flagged' END, CASE WHEN l_partkey % 5 = 0 THEN 'anchor_invalid:' || CASE WHEN l_partkey % 2 = 0 THEN 'small' ELSE 'unknown' END END)"""


@query(
    f"SELECT {LINE}, CASE WHEN r = '' THEN 'passed' ELSE r END AS filter_reason FROM (SELECT {LINE}, {_GATED_EDIT.replace('l_tax < 0.0025', 'l_tax * 15 < 0.0025')} AS r FROM lineitem)"
)
def q_edit_gates(spark, sf_dir):
    row = {
        "accepted": c("l_quantity") <= 40,
        "error": F.when((c("l_linestatus") == "F") & (c("l_linenumber") == 1), "boom").otherwise(""),
        "realism_score": c("l_discount") * 8,
        "masked_changed_ratio": c("l_tax") * 15,
        "masked_mean_delta": c("l_quantity") / 10,
        "sensitive": c("l_suppkey") % 7 == 0,
        "anchor_valid": c("l_partkey") % 5 != 0,
        "anchor_reason": F.when(c("l_partkey") % 2 == 0, "small").otherwise(""),
    }
    why = gates.reasons(*gates.edit_reasons(row, release.BuildConfig(require_accepted=True, require_valid=True)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", gates.filter_reason(why).alias("filter_reason"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, unnest(CASE WHEN l_linestatus = 'O' THEN ['verifier_rejected', 'tiny_' || l_returnflag] ELSE ['tiny_' || l_returnflag] END) AS why, ' note ' || l_suppkey AS note FROM lineitem),
r AS (SELECT k, string_agg(why || ' x' || c, ', ' ORDER BY why) AS said FROM (SELECT k, why, count(*) AS c FROM l GROUP BY k, why) GROUP BY k), v AS (SELECT k, first(trim(note) ORDER BY n, p, s) AS note FROM l WHERE why = 'verifier_rejected' GROUP BY k)
SELECT r.k AS l_orderkey, said || coalesce(' | verifier: ' || note, '') AS rejected FROM r LEFT JOIN v ON r.k = v.k""")
def q_rejections(spark, sf_dir):
    tiny = F.concat(F.lit("tiny_"), "l_returnflag")
    why = F.when(c("l_linestatus") == "O", F.array(F.lit("verifier_rejected"), tiny)).otherwise(F.array(tiny))
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", why.alias("rejection_reasons"),
        F.concat(F.lit(" note "), c("l_suppkey").cast("string")).alias("note")
    )
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return found.select("l_orderkey", gates.rejection_summary(c("lines")).alias("rejected"))


@query("""WITH o AS (SELECT l_orderkey, list(CASE WHEN l_linestatus = 'O' THEN 'no_' || l_returnflag ELSE '' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS w, list('[' || l_linenumber::DOUBLE || ', ' || round_even(l_tax * 10, 1) || ']' ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, list_filter(w, lambda x, i: x <> '' AND list_position(w, x) = i) AS w, b FROM o) SELECT l_orderkey, 'reasons=' || array_to_string(w[1:3], '; ') || ' boxes=' || array_to_string(b[1:2], ', ') AS failed FROM f""")
def q_segment_failures(spark, sf_dir):
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey",
        F.when(c("l_linestatus") == "O", F.concat(F.lit("no_"), "l_returnflag")).otherwise("").alias("why"),
        F.array(c("l_linenumber").cast("double"), c("l_tax") * 10).alias("box")
    )
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return found.select(
        "l_orderkey",
        gates.failure_summary(F.transform("x", lambda r: r["why"]), F.transform("x", lambda r: r["box"])).alias("failed")
    )


_SHIFT = f"{CLAMP.format(f'0.50 * {clamped("l_discount * 12")} + 0.30 * {clamped("l_tax * 10")} + 0.20 * {clamped("l_quantity / 60")}')}"
_SIZES = "CASE l_linenumber % 5 WHEN 0 THEN 0.15 WHEN 1 THEN 0.05 WHEN 2 THEN -0.05 WHEN 3 THEN -0.15 ELSE 0.0 END"
_VIS = f"{CLAMP.format(f'0.70 * {clamped("l_tax * 12")} + 0.30 * {clamped("l_quantity / 50")}')}"


@query(f"""SELECT {LINE}, {_SHIFT} AS shift, CASE WHEN l_tax > 0.02 THEN {clamped('l_tax * 9')} WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.5 ELSE 0.0 END AS contradiction, {CLAMP.format("CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 20 WHEN l_linenumber % 3 = 1 THEN 0.4 WHEN l_linestatus = 'O' THEN 0.85 ELSE 0.5 END")} AS prior,
{CLAMP.format(f"{CLAMP.format(f'0.65 * l_discount * 5 + 0.35 * {clamped('l_quantity / 50')}')} + {_SIZES}")} AS salience, CASE WHEN l_linestatus = 'O' THEN {_VIS} ELSE {CLAMP.format(f'{_VIS} * 0.4')} END AS visibility, {CLAMP.format(f'0.45 * {clamped("l_discount * 12")} + 0.35 * {clamped("l_tax * 12")} + 0.20 * {clamped("l_quantity / 45")}')} AS confidence,
CASE WHEN l_returnflag = 'N' THEN 'stance_shift' WHEN l_linenumber % 3 = 0 THEN 'claim_alteration' WHEN l_returnflag = 'R' THEN 'narrative_reframe' WHEN l_linenumber % 3 = 1 THEN 'claim_alteration' ELSE 'attribution_change' END AS text_op FROM lineitem""")
def q_shift_scores(spark, sf_dir):
    d, t, q, n = c("l_discount"), c("l_tax"), c("l_quantity"), c("l_linenumber")
    none = F.lit(None).cast("double")
    direction = F.when(c("l_returnflag") == "R", " Contradiction").when(c("l_returnflag") == "A", "neutral").otherwise("entailment")
    size = F.get(F.array(*map(F.lit, ["dominant", " Moderate", "small", "tiny", "other"])), n % 5)
    mixed = scoring.blended(d * 5, t * 12, q / 50, q / 50, c("l_linestatus") == "O", size)
    severity = F.when(c("l_returnflag") == "N", "low").when(c("l_returnflag") == "A", "medium").otherwise("high")
    operation = F.get(F.array(*map(F.lit, ["attribute_change", "remove", "replace"])), n % 3)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        scoring.semantic_shift(d * 12, t * 10, q / 60).alias("shift"),
        scoring.contradiction(F.when(t > 0.02, t * 9), direction).alias("contradiction"),
        scoring.tier_prior(
            F.when(n % 3 == 0, d * 20).otherwise(none), F.when(n % 3 == 1, 0.4).otherwise(none),
            F.when(c("l_linestatus") == "O", "tier_c").otherwise("other")
        ).alias("prior"),
        mixed["salience"].alias("salience"),
        mixed["visibility"].alias("visibility"),
        scoring.confidence(d * 12, t * 12, q / 45).alias("confidence"), scoring.text_operation(severity, operation).alias("text_op"),
    )


_AREA, _NEAR = "l_quantity / 300", "l_suppkey % 2 = 0"
_BASE = f"CASE WHEN {_NEAR} AND {_AREA} <= 0.06 THEN 0.46 * 0.85 WHEN {_NEAR} THEN 0.54 * 0.85 WHEN {_AREA} <= 0.12 THEN 0.46 ELSE 0.54 END"
_SOFT = "CASE WHEN l_partkey % 3 = 0 THEN 0.24 ELSE 0.42 END"


@query(f"""WITH j AS (SELECT {LINE}, l_returnflag AS f, l_linenumber % 5 AS o, {_SOFT} AS soft, {_BASE} AS base, CASE WHEN {_NEAR} THEN CASE WHEN {_AREA} <= 0.06 THEN 0.14 ELSE 0.18 END WHEN {_AREA} <= 0.06 THEN 0.10 WHEN {_AREA} <= 0.12 THEN 0.12 ELSE 0.14 END AS pad, l_partkey % 3 = 0 AS face FROM lineitem)
SELECT {LINE}, CASE o WHEN 0 THEN CASE f WHEN 'N' THEN 2 ELSE 3 END WHEN 4 THEN 0 ELSE 3 END AS tries, CAST(CASE o WHEN 0 THEN least(0.92, soft * CASE f WHEN 'N' THEN 1.0 WHEN 'A' THEN 1.10 ELSE 1.25 END) WHEN 1 THEN 0.82 WHEN 2 THEN 0.84 WHEN 3 THEN base END AS DOUBLE) AS first,
CAST(CASE o WHEN 0 THEN least(0.92, soft * CASE f WHEN 'N' THEN 1.15 WHEN 'A' THEN 1.40 ELSE 1.65 END) WHEN 1 THEN least(0.98, 0.82 * 1.16) WHEN 2 THEN least(0.98, 0.84 * 1.16) WHEN 3 THEN least(0.95, base * 1.24) END AS DOUBLE) AS last,
CASE o WHEN 0 THEN CASE f WHEN 'N' THEN 46 ELSE 50 END WHEN 4 THEN NULL WHEN 3 THEN 50 ELSE 60 END AS steps, CASE o WHEN 0 THEN CASE WHEN face THEN 3 ELSE 5 END WHEN 4 THEN NULL WHEN 3 THEN 5 ELSE 6 END AS feather, CAST(pad AS DOUBLE) AS pad FROM j""")
def q_attempts(spark, sf_dir):
    effective = F.get(F.array(*map(F.lit, ["attribute_change", "fill", "insert", "replace", "skip"])), c("l_linenumber") % 5)
    severity = F.when(c("l_returnflag") == "N", "low").when(c("l_returnflag") == "A", "medium").otherwise("high")
    area, near = c("l_quantity") / 300, c("l_suppkey") % 2 == 0
    tries = routing.attempts(effective, severity, c("l_partkey") % 3 == 0, area, near)
    rows = table(spark, sf_dir, "lineitem").withColumns({"t": tries, "pad": routing.replace_strength(area, near)["pad"]})
    end = F.try_element_at("t", F.lit(-1))
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.size("t").alias("tries"),
        F.get("t", F.lit(0))["strength"].alias("first"), end["strength"].alias("last"),
        end["steps"].alias("steps"), end["feather"].alias("feather"), "pad"
    )


_ACCEPT = """CASE WHEN l_linenumber = 7 THEN 'error' WHEN l_suppkey % 9 = 0 THEN 'skipped' WHEN NOT (l_quantity / 5 >= CASE l_returnflag WHEN 'N' THEN 3.0 WHEN 'A' THEN 5.0 ELSE 8.0 END AND l_tax >= CASE l_returnflag WHEN 'N' THEN 0.01 WHEN 'A' THEN 0.018 ELSE 0.03 END) THEN 'edit_not_visible' WHEN l_discount > 0.01 AND l_discount * 10 < 0.45 THEN 'low_realism' END"""
_NAME = "'_req-' || CASE WHEN l_linenumber % 2 = 0 THEN 'attribute_change' ELSE 'unknown' END || '_eff-replace_low_' || l_linenumber || '.png'"


@query(
    f"""SELECT {LINE}, r IS NULL AS accepted, r AS reject_reason, l_orderkey || '/' || l_partkey || {_NAME} AS output, l_orderkey || '/rejects/' || l_partkey || {_NAME} AS refused, l_quantity / 100 <= 0.28 AND NOT (l_suppkey % 2 = 0 AND l_suppkey % 3 <> 0 AND l_quantity / 100 > 0.12) AS fallback FROM (SELECT *, {_ACCEPT} AS r FROM lineitem)"""
)
def q_edit_outcomes(spark, sf_dir):
    severity = F.when(c("l_returnflag") == "N", "low").when(c("l_returnflag") == "A", "medium").otherwise("high")
    visible = routing.is_visible(severity, c("l_quantity") / 5, c("l_tax"))
    end = routing.outcome(
        F.when(c("l_suppkey") % 9 == 0, "skip").otherwise("replace"), F.when(c("l_linenumber") == 7, "boom"),
        visible, F.when(c("l_discount") > 0.01, c("l_discount") * 10)
    )
    meta = F.struct((c("l_suppkey") % 2 == 0).alias("person_like"), (c("l_suppkey") % 3 == 0).alias("safe_remove"))
    named = lambda f: f(
        c("l_orderkey").cast("string"), c("l_partkey").cast("string"),
        F.when(c("l_linenumber") % 2 == 0, " Attribute Change").otherwise(""), F.lit("replace"), F.lit("low"),
        c("l_linenumber")
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("end", end)
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", "end.accepted", "end.reject_reason",
        named(routing.output_name).alias("output"), named(routing.reject_name).alias("refused"),
        routing.fallback_allowed(c("l_quantity") / 100, meta).alias("fallback")
    )


_OPS = "CASE WHEN l_tax > 0.02 THEN {0} ELSE {1} END"


@query(f"""WITH j AS (SELECT {LINE}, p_name, lower(p_type) AS cat, l_tax AS mr, l_discount * 10 AS gs, l_linenumber AS rc, o_orderpriority || ' with ' || CASE WHEN o_orderkey % 2 = 0 THEN p_name ELSE '' END AS headline FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, {CLAMP.format(f'0.40 * (CASE WHEN contains(lower(headline), p_name) THEN 1.0 ELSE 0.0 END) + 0.25 * {clamped("rc / 3.0")} + 0.20 * {clamped("mr / 0.10")} + 0.15 * 0.0')} AS salience FROM j)
SELECT {LINE}, salience, {CLAMP.format(f'0.65 * {clamped("mr / 0.15")} + 0.35 * {clamped("gs")}')} AS visibility, 'tier_a' AS tier, CASE WHEN mr > 0.02 THEN 3 ELSE 3 END AS ops,
CASE WHEN salience < 0.15 THEN 'skipped_low_salience' WHEN rc = 5 THEN 'skipped_no_mask' WHEN rc = 6 THEN 'missing_image' END AS early FROM s""")
def q_planning_context(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    held = rows.select(
        c("l_orderkey").alias("sample_id"),
        c("l_partkey").alias("anchor_id"),
        "l_linenumber",
        c("p_name").alias("anchor_text"),
        F.lower("p_type").alias("category"),
        c("l_tax").alias("mask_ratio"),
        (c("l_discount") * 10).alias("grounding_score"),
        c("l_linenumber").alias("relation_count"),
        F.when(c("l_linenumber") == 5, "").otherwise("m.png").alias("union_mask_path"),
        F.lit(None).cast("array<double>").alias("bbox_xyxy"),
        F.when(c("l_linenumber") == 6, "").otherwise("i.png").alias("image_path"),
        F.lit("old").alias("headline"),
        F.lit("old").alias("summary"),
        "p_name",
    )
    orders = table(spark, sf_dir, "orders")
    named = held.select("sample_id", "anchor_id", "p_name").distinct().join(orders, c("sample_id") == c("o_orderkey")).select(
        "sample_id", "anchor_id",
        F.concat("o_orderpriority", F.lit(" with "), F.when(c("o_orderkey") % 2 == 0, c("p_name")).otherwise("")).alias("headline"),
        F.lit("").alias("summary")
    )
    # a manifest for each line, so that a headline may name the anchor
    key = F.concat_ws("/", "sample_id", "anchor_id")
    out = anchors.planning_context(
        held.withColumns({"order": c("sample_id"), "sample_id": key}),
        named.select(key.alias("sample_id"), "headline", "summary")
    )
    return out.select(
        c("order").alias("l_orderkey"), c("anchor_id").alias("l_partkey"), "l_linenumber",
        c("salience_proxy").alias("salience"), c("visibility_proxy").alias("visibility"),
        c("tier_name").alias("tier"), F.size("allowed_operations").alias("ops"),
        c("early_status").alias("early")
    )


_PLANNED = f"""WITH r AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'N' THEN 'low' WHEN 'A' THEN 'medium' ELSE 'high' END AS severity, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank, CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, l_partkey % 3 AS what, {clamped('l_discount * 9.137')} AS s, {clamped('l_tax * 11.317')} AS t, {clamped('l_quantity / 50.773')} AS q FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY k, what ORDER BY rank, pos) AS n FROM r),
b AS (SELECT *, {CLAMP.format('0.65 * s + 0.35 * q')} AS sal, {CLAMP.format('0.70 * t + 0.30 * q')} AS vis, {CLAMP.format('0.50 * s + 0.30 * t + 0.20 * q')} AS delta FROM f WHERE n = 1),
p AS (SELECT *, {CLAMP.format("0.35 * (0.5 * least(1.0, sal / 0.25)) + 0.25 * delta + 0.20 * t + 0.15 * sal + 0.05 * (1.0 - vis)")} AS raw, {CLAMP.format('0.45 * q + 0.35 * s + 0.20 * q')} AS conf FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY k, severity ORDER BY round_even(raw, 4) DESC, round_even(conf, 4) DESC, pos) - 1 AS place FROM p), m AS (SELECT k, severity, rank, round_even(raw, 4) AS best FROM o WHERE place = 0),
w AS (SELECT *, coalesce(best < max(best) OVER (PARTITION BY k ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.05, false) AS warning FROM m)"""


@query(
    _PLANNED + """ SELECT k AS l_orderkey, severity, CAST(place AS INTEGER) AS candidate_index, round_even(raw, 4) AS planned, round_even(conf, 4) AS confidence, CASE WHEN raw <= 0.18 THEN 'low' WHEN raw <= 0.45 THEN 'medium' ELSE 'high' END AS bucket, warning FROM o JOIN w USING (k, severity)"""
)
def q_scored_candidates(spark, sf_dir):
    d, t, q = F.least(F.lit(1.0), c("l_discount") * 9.137), F.least(F.lit(1.0), c("l_tax") * 11.317), F.least(F.lit(1.0), c("l_quantity") / 50.773)
    candidate = F.struct(
        F.lit("replace").alias("operation"),
        F.concat(F.lit("hat "), (c("l_partkey") % 3).cast("string")).alias("edited_anchor"),
        F.lit("[FILL] x").alias("edit_instruction"), d.alias("semantic_shift"), t.alias("role_shift"),
        t.alias("contradiction_potential"), q.alias("public_impact"), q.alias("realism"),
        d.alias("localizability")
    )
    severity = F.when(c("l_returnflag") == "N", "low").when(c("l_returnflag") == "A", "medium").otherwise("high")
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("sample_id"),
        F.lit("a").alias("anchor_id"),
        severity.alias("severity"),
        F.round(c("l_extendedprice") * 100).cast("long").alias("pos"),
        candidate.alias("candidate"),
        F.lit(0.5).alias("tier_prior"),
        d.alias("salience_proxy"),
        t.alias("visibility_proxy"),
        q.alias("centrality"), q.alias("editability"), F.lit(True).alias("visible"), F.lit("").alias("apparent_size"),
    )
    return anchors.scored_candidates(rows).select(
        c("sample_id").alias("l_orderkey"), "severity", "candidate_index",
        c("planned_score_raw").alias("planned"), c("planner_confidence").alias("confidence"),
        c("planned_bucket").alias("bucket"), c("tier_ordering_warning").alias("warning")
    )


_INTER = "greatest(0.0, least(h.x2, o.x2) - greatest(h.x1, o.x1)) * 30.0"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name AS phrase, string_split(p_name, ' ')[-1] AS head, p_size FROM part), d AS (SELECT id, 0 AS rank, i, phrase AS query, p_size FROM p, (SELECT unnest(range(4)) AS i) UNION ALL SELECT id, 1, i, head, p_size FROM p, (SELECT unnest(range(3)) AS i)),
e AS (SELECT *, CAST(10 * i AS DOUBLE) AS x1, CAST(10 * i + 20 + rank AS DOUBLE) AS x2, 0.2 + ((id * 7 + i * 13 + rank * 29) % 50) / 100.0 AS score FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round_even(score, 6) DESC, rank, x1) AS r FROM e WHERE score >= 0.25), t AS (SELECT id, max(r) AS most FROM o GROUP BY id),
s AS (SELECT id, r, [{{'r': r, 'x1': x1, 'x2': x2}}] AS held FROM o WHERE r = 1 UNION ALL
SELECT s.id, o.r, CASE WHEN len(list_filter(s.held, lambda h: {_INTER} / ((h.x2 - h.x1) * 30.0 + (o.x2 - o.x1) * 30.0 - {_INTER}) > 0.7)) > 0 THEN s.held ELSE list_append(s.held, {{'r': o.r, 'x1': o.x1, 'x2': o.x2}}) END FROM s JOIN o ON s.id = o.id AND o.r = s.r + 1),
k AS (SELECT id, unnest(list_transform(held, lambda h: h.r)) AS r FROM s JOIN t USING (id) WHERE s.r = t.most), n AS (SELECT o.*, row_number() OVER (PARTITION BY id ORDER BY round_even(score, 6) DESC, score DESC, rank) AS n FROM o JOIN k USING (id, r))
SELECT id AS p_partkey, query, x1, score FROM n WHERE n <= CASE WHEN p_size % 2 = 0 THEN 4 ELSE 1 END""")
def q_selected_detections(spark, sf_dir):
    parts = spread(table(spark, sf_dir, "part"))
    asked = parts.select(
        c("p_partkey").alias("sample_id"), F.lit("a").alias("anchor_id"), c("p_name").alias("phrase"),
        F.lit("object").alias("category"), (c("p_size") % 2 == 0).alias("multi"), F.lit(100).alias("width"),
        F.lit(100).alias("height")
    )
    tries = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(i).alias("i")) for r, n in ((0, 4), (1, 3)) for i in range(n)]))
    rows = parts.select(c("p_partkey").alias("sample_id"), "p_name", tries.alias("t")).select("sample_id", "p_name", "t.*")
    x1 = c("i") * 10.0
    query_ = F.when(c("rank") == 0, c("p_name")).otherwise(F.element_at(F.split("p_name", " "), -1))
    score = F.lit(0.2) + ((c("sample_id") * 7 + c("i") * 13 + c("rank") * 29) % 50) / 100.0
    boxes = rows.select(
        "sample_id", query_.alias("query"),
        F.array(x1, F.lit(0.0), x1 + 20 + c("rank"), F.lit(30.0)).alias("box"), score.alias("score")
    )
    got = anchors.selected_detections(asked, boxes)
    return got.select(c("sample_id").alias("p_partkey"), "query", F.get("box", F.lit(0)).alias("x1"), "score")


def line_structs(spark, sf_dir):
    """Results, plans, anchors and manifests: lines are results, those still open are planned, those not returned have anchors, orders that are final have manifests."""
    lines = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("sample_id"), c("l_partkey").alias("anchor_id"), "l_linenumber", "l_linestatus",
        "l_returnflag"
    )
    keys = ["sample_id", "anchor_id"]
    return lines, lines.where("l_linestatus = 'O'").select(*keys).distinct(), lines.where("l_returnflag = 'N'").select(*keys).distinct(), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        c("o_orderkey").alias("sample_id"), "o_orderpriority"
    )


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, bool_or(l_linestatus = 'O') OVER w AS planned, bool_or(l_returnflag = 'N') OVER w AS anchored, o_orderpriority AS priority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' WINDOW w AS (PARTITION BY l_orderkey, l_partkey)"""
)
def q_release_lookup(spark, sf_dir):
    got = relational.lookups(*line_structs(spark, sf_dir))
    return got.select(
        c("sample_id").alias("l_orderkey"), c("anchor_id").alias("l_partkey"), "l_linenumber",
        c("plan").isNotNull().alias("planned"), c("anchor").isNotNull().alias("anchored"),
        c("manifest.o_orderpriority").alias("priority")
    )


@query("SELECT l_orderkey, l_partkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_required_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return relational.required(
        table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"], "order"
    ).select("l_orderkey", "l_partkey", "l_linenumber", "o_orderpriority")


@query("SELECT doc_id FROM documents ORDER BY sha256('13|' || doc_id), doc_id LIMIT 137")
def q_sampled(spark, sf_dir):
    """A limit is the feature: maybe_cap_pristine keeps so many rows."""
    return relational.sample(table(spark, sf_dir, "documents").select("doc_id"), 137, 13, "doc_id")


REWRITE = "struct<rewritten_headline:string,text_edit_operation:string,nli_direction:string,rewrite_rationale:string,error:string,raw_rewrite_output:string>"


def build_inputs(spark, sf_dir):
    """results, plans, anchors and manifests of orders: customers are samples, an order is an anchor with a plan of one candidate."""
    o, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    keys = [c("o_custkey").cast("string").alias("sample_id"), c("o_orderkey").cast("string").alias("anchor_id")]
    none = F.lit(None)
    share = c("o_totalprice") / 617283.7
    said = lambda h, raw=none.cast("string"): F.struct(
        h.alias("rewritten_headline"), none.cast("string").alias("text_edit_operation"),
        F.lit("neutral").alias("nli_direction"), none.cast("string").alias("rewrite_rationale"),
        none.cast("string").alias("error"), raw.alias("raw_rewrite_output")
    ).cast(REWRITE)
    headline = F.concat(F.lit("new words of "), F.lower("o_orderpriority"), F.lit(" here"))
    spoken = F.concat(F.lit('sure {"rewritten_headline": "other words of '), F.lower("o_orderpriority"), F.lit('"}'))
    rewrites = F.when(c("o_orderkey") % 4 == 0, F.create_map(F.lit("joint"), said(headline))).when(
        c("o_orderkey") % 4 == 1, F.create_map(F.lit("text_only"), said(none.cast("string"), spoken))
    ).otherwise(F.create_map(F.lit("joint"), said(F.lit(""))))
    candidate = F.struct(
        F.lit("replace").alias("operation"),
        F.lit("hat").alias("edited_anchor"),
        F.lit("do").alias("edit_instruction"),
        F.lit("why").alias("rationale"),
        F.lit(0.0).alias("delta_sem_plan"),
        share.alias("semantic_shift"),
        share.alias("role_shift"),
        share.alias("public_impact"),
        F.lit(0.0).alias("contradiction_potential"),
        rewrites.alias("headline_rewrite"),
    )
    severity = F.when(c("o_orderstatus") == "O", "low").when(c("o_orderstatus") == "P", "medium").otherwise("high")
    plans = o.select(
        *keys,
        F.lit("p.png").alias("image_path"),
        F.lit("").alias("headline"),
        F.lit("").alias("summary"),
        (c("o_orderkey") % 11 == 0).alias("sensitive"),
        none.cast("double").alias("tier_prior"),
        none.cast("double").alias("proxy_tier_prior"),
        F.when(c("o_orderkey") % 2 == 0, "Tier_C").otherwise("tier_b").alias("tier_name"),
        share.alias("salience_proxy"),
        share.alias("visibility_proxy"),
        share.alias("blended_salience"),
        share.alias("blended_visibility"),
        (c("o_orderkey") % 3 == 0).alias("has_proxies"),
        F.create_map(severity, F.array(candidate)).alias("candidates"),
    )
    held = o.select(
        *keys, (c("o_orderkey") % 5 != 0).alias("technical_valid"),
        F.when(c("o_orderkey") % 5 == 0, "mask_too_small").alias("technical_reject_reason")
    )
    manifests = cust.select(
        c("c_custkey").cast("string").alias("sample_id"), F.lit("p.png").alias("image_path"),
        F.concat(F.lit("old words of "), F.lower("c_mktsegment")).alias("headline"),
        F.lit("sum").alias("summary"), F.struct(F.lit("lit").alias("image_caption_literal")).alias("caption")
    )
    results = o.select(
        *keys,
        F.when(c("o_orderkey") % 2 == 0, "imagetext").otherwise("image_only").alias("modality"),
        severity.alias("severity"),
        F.lit(0).alias("candidate_index"),
        F.lit(True).alias("accepted"),
        F.when(c("o_orderkey") % 13 == 0, "boom").otherwise("").alias("error"),
        (share * 2).alias("realism_score"),
        share.alias("masked_changed_ratio"),
        (share * 20).alias("masked_mean_delta"),
        F.lit("replace").alias("requested_operation"),
        F.lit("replace").alias("effective_operation"),
        F.lit("o.png").alias("output_path"),
        F.lit("p.png").alias("image_path"),
        none.cast("string").alias("rewritten_caption"),
        none.cast("string").alias("nli_direction"),
        F.lit("").alias("tier"),
    )
    return results, plans, held, manifests


_BUILD = f"""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'image_text' ELSE 'image_only' END AS modality, o_totalprice / 617283.7 AS s, CASE o_orderkey % 4 WHEN 0 THEN 'new words of ' || lower(o_orderpriority) || ' here' WHEN 1 THEN 'other words of ' || lower(o_orderpriority) ELSE '' END AS said,
'old words of ' || lower(c_mktsegment) AS old, CASE WHEN o_orderkey % 2 = 0 THEN 0.85 ELSE 0.5 END AS tier FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT *, {CLAMP.format('0.35 * tier + 0.25 * ' + CLAMP.format('0.50 * s + 0.30 * s + 0.20 * s') + " + 0.20 * (CASE WHEN said <> '' THEN 0.5 ELSE 0.0 END) + 0.15 * least(1.0, s) + 0.05 * (1.0 - least(1.0, s))")} AS raw FROM b)"""


@query(_BUILD + f""", r AS (SELECT *, CASE WHEN said = '' THEN old ELSE said END AS headline FROM v), g AS (SELECT *, concat_ws(';', CASE WHEN o_orderkey % 13 = 0 THEN 'edit_error' END, CASE WHEN least(1.0, s * 2) < 0.35 THEN 'low_realism' END, CASE WHEN s < 0.0025 THEN 'changed_ratio_too_low' END, CASE WHEN s > 0.95 THEN 'changed_ratio_too_high' END,
CASE WHEN s * 20 < 1.5 THEN 'masked_delta_too_low' END, CASE WHEN o_orderkey % 11 = 0 THEN 'sensitive_flagged' END, CASE WHEN o_orderkey % 5 = 0 THEN 'anchor_invalid:mask_too_small' END,
CASE WHEN modality = 'image_text' AND {gate_sql('headline', 80)} <> 'ok' THEN {gate_sql('headline', 80)} WHEN modality = 'image_text' AND said = '' THEN 'too_similar_to_original' WHEN modality = 'image_only' AND {gate_sql('old', 80)} <> 'ok' THEN 'orig_' || {gate_sql('old', 80)} END) AS why FROM r)
SELECT o_orderkey::VARCHAR AS anchor_id, modality, round_even(raw, 6) AS severity_score, CASE WHEN raw <= 0.3 THEN 'low' WHEN raw <= 0.6 THEN 'medium' ELSE 'high' END AS severity_label, CASE WHEN modality = 'image_text' THEN headline ELSE old END AS headline_edited, CASE WHEN why = '' THEN 'passed' ELSE why END AS filter_reason FROM g""")
def q_edited_examples(spark, sf_dir):
    got = release.edited_examples(relational.lookups(*build_inputs(spark, sf_dir)), None, release.BuildConfig(require_valid=True))
    return got.select("anchor_id", "modality", "severity_score", "severity_label", "headline_edited", "filter_reason")


@query(_BUILD + f""", g AS (SELECT *, concat_ws(';', CASE WHEN said = '' THEN 'missing_text_only_rewrite' END, CASE WHEN o_orderkey % 11 = 0 THEN 'sensitive_flagged' END, CASE WHEN o_orderkey % 5 = 0 THEN 'anchor_invalid:mask_too_small' END,
CASE WHEN {gate_sql('said', 80)} <> 'ok' THEN {gate_sql('said', 80)} END) AS why FROM v)
SELECT o_orderkey::VARCHAR AS anchor_id, round_even(raw, 6) AS severity_score, CASE WHEN said = '' THEN old ELSE said END AS headline_edited, CASE o_orderkey % 4 WHEN 0 THEN 'joint_fallback' WHEN 1 THEN 'text_only' ELSE 'missing' END AS source, CASE WHEN why = '' THEN 'passed' ELSE why END AS filter_reason FROM g""")
def q_text_examples(spark, sf_dir):
    _, plans, held, manifests = build_inputs(spark, sf_dir)
    got = release.text_examples(plans, held, manifests, release.BuildConfig(require_valid=True))
    return got.select("anchor_id", "severity_score", "headline_edited", c("provenance.rewrite_source").alias("source"), "filter_reason")


@query(
    f"SELECT c_custkey || '__pristine' AS pair_id, h AS headline, {split_sql('c_custkey::VARCHAR')} AS split FROM (SELECT c_custkey, 'old words of ' || lower(c_mktsegment) AS h FROM customer) WHERE {gate_sql('h', 80)} = 'ok'"
)
def q_pristine_examples(spark, sf_dir):
    got = release.pristine_examples(build_inputs(spark, sf_dir)[3])
    return got.select("pair_id", c("headline_edited").alias("headline"), relational.split_of(c("sample_id")).alias("split"))


@query("""WITH e AS (SELECT o_orderkey, o_orderpriority AS id, o_totalprice / 600000 AS s, o_orderstatus <> 'F' AS ok, 0 AS n FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, NULL, true, 1 FROM orders WHERE o_orderkey % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id, ok ORDER BY least(1.0, coalesce(s, 0)) DESC, n, lpad(o_orderkey::VARCHAR, 12, '0')) AS r FROM e) SELECT id AS pair_id, o_orderkey::VARCHAR AS sample_id, ok AS kept FROM k WHERE r = 1
UNION ALL SELECT nation.n_name || '__pristine', n_nationkey::VARCHAR, true FROM nation""")
def q_union_release(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = lambda df, score, ok: df.select(
        c("o_orderpriority").alias("pair_id"), c("o_orderkey").cast("string").alias("sample_id"),
        F.lit("image_only").alias("modality"), F.struct(score.alias("realism_score")).alias("quality"),
        F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("result_order"),
        F.when(ok, "passed").otherwise("bad").alias("filter_reason")
    )
    edited, texts = row(o, c("o_totalprice") / 600000, c("o_orderstatus") != "F"), row(
        o.where("o_orderkey % 100 = 0"), F.lit(None).cast("double"), F.lit(True)
    )
    pristine = table(spark, sf_dir, "nation").select(
        F.concat("n_name", F.lit("__pristine")).alias("pair_id"),
        c("n_nationkey").cast("string").alias("sample_id"), F.lit("pristine").alias("modality"),
        F.lit("passed").alias("filter_reason")
    )
    kept, refused = release.release(pristine, edited, texts, release.BuildConfig())
    return kept.select("pair_id", "sample_id", F.lit(True).alias("kept")).unionAll(refused.select("pair_id", "sample_id", F.lit(False).alias("kept")))


@query("""WITH j AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'low' WHEN 'P' THEN 'medium' ELSE 'high' END AS severity FROM orders), t AS (SELECT o_orderkey, severity, i, m FROM j, (SELECT unnest(range(2)) AS i), (SELECT unnest(['text_only', 'joint']) AS m) WHERE severity <> 'low')
SELECT o_orderkey, severity, CAST(i AS INTEGER) AS candidate_index, string_agg(m || '=' || m || o_orderkey, ';' ORDER BY m) AS rewrites FROM t GROUP BY ALL""")
def q_rewrite_tasks(spark, sf_dir):
    severity = F.when(c("o_orderstatus") == "O", "low").when(c("o_orderstatus") == "P", "medium").otherwise("high")
    plans = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.create_map(severity, F.array(F.struct(F.lit(1).alias("x")), F.struct(F.lit(2).alias("x")))).alias("severity_candidates")
    )
    tasks = inference.rewrite_tasks(plans, ["o_orderkey"], least="medium")
    answers = inference.with_recorded(
        tasks,
        tasks.select("o_orderkey", "mode", F.concat("mode", c("o_orderkey").cast("string")).alias("answer")),
        ["o_orderkey", "mode"]
    )
    back = inference.rewrites_back(answers, ["o_orderkey"], "answer")
    return back.select(
        "o_orderkey", "severity", "candidate_index",
        F.array_join(F.transform(F.map_entries("headline_rewrite"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("rewrites")
    )


@query(
    """SELECT l_orderkey, bool_and(l_discount > 0.01) AS match, min(l_tax) AS score, string_agg(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, ' | ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS reason, max(l_tax) AS best FROM lineitem GROUP BY l_orderkey"""
)
def q_verifiers(spark, sf_dir):
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", (c("l_discount") > 0.01).alias("match"),
        c("l_tax").alias("score"),
        F.when(c("l_returnflag") != "N", c("l_returnflag")).otherwise("").alias("reason")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    rows = lines.select(
        "l_orderkey", inference.verifier_stack(c("x")).alias("v"),
        inference.best_mask(F.transform("x", lambda r: F.struct(r["score"].alias("score"), r["match"].alias("mask"))))["score"].alias("best")
    )
    return rows.select("l_orderkey", "v.match", "v.score", F.when(c("v.reason") != "", c("v.reason")).alias("reason"), "best")
