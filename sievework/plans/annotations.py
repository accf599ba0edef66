"""Queries of text rules, extracted anchors and boxes over the provided tables, and their SQL.

Parts stand in for anchors: names are spans, types are categories; numbers of order lines stand in for measures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import coerce, geometry, jsonops, scoring, text
from sievework.operators import anchors, relational
from sievework.plans.catalogue import LOWER, SQUEEZED, contains_any_sql, query, spread, sql_list, table, tag_sql

c = F.col
SPAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + LOWER + r", '^[-–—:;,.\s]+', ''), '[-–—:;,.\s]+$', ''), '\b(the|a|an)\b\s+', '', 'g'), '\s+', ' ', 'g'))"
#: Of a list in order, the first element of each form.
FIRST = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: {1}), {2}) = i AND {2} <> '')"


def first_sql(items: str, form: str) -> str:
    return FIRST.format(items, form.format("y"), form.format("x"))


@query("""SELECT event_id, least(1.0, value / 200) AS clamped, printf('%06d', event_id + 1) AS record, CASE event_type WHEN 'view' THEN '/abs/' || user_id WHEN 'error' THEN NULL ELSE '/root/rel/' || user_id END AS path,
'{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS compact, event_type AS said, '' AS unsaid, true AS is_object, false AS is_array, coalesce(nullif(event_type, 'view'), 'x') AS first FROM events""")
def q_coercions(spark, sf_dir):
    props, named = F.parse_json("props"), F.parse_json(F.concat(F.lit('{"a":"'), "event_type", F.lit('"}')))
    path = F.when(
        c("event_type") == "view", F.concat(F.lit("/abs/"), "user_id")
    ).when(c("event_type") == "error", "").otherwise(F.concat(F.lit("rel/"), "user_id"))
    field = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant")
    return table(spark, sf_dir, "events").select(
        "event_id",
        coerce.strict_clamp(c("value") / 200).alias("clamped"),
        coerce.record_id(c("event_id")).alias("record"),
        coerce.rooted(path, "/root/").alias("path"),
        coerce.compact_json(F.struct("user_id", "event_type")).alias("compact"),
        coerce.variant_str(field(named, "a")).alias("said"),
        coerce.variant_str(field(props, "k")).alias("unsaid"),
        coerce.is_object(props).alias("is_object"),
        coerce.is_array(props).alias("is_array"),
        coerce.first_nonempty([F.when(c("event_type") != "view", c("event_type")).otherwise(""), F.lit("x")]).alias("first"),
    )


_LISTED = "['  ' || p_name, p_type, upper(p_name) || ' ', '', lower(p_type), p_brand]"


@query(
    f"SELECT p_partkey, array_to_string({first_sql('l', 'lower({0})')}, '|') AS cleaned, array_to_string({first_sql('r', 'lower({0})')}, '|') AS kept FROM (SELECT p_partkey, list_transform({_LISTED}, lambda x: {SQUEEZED.format('x')}) AS l, {_LISTED} AS r FROM part)"
)
def q_string_lists(spark, sf_dir):
    items = F.array(F.concat(F.lit("  "), "p_name"), "p_type", F.concat(F.upper("p_name"), F.lit(" ")), F.lit(""), F.lower("p_type"), "p_brand")
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey", F.array_join(coerce.clean_string_list(items), "|").alias("cleaned"),
        F.array_join(coerce.unique_keep_order(items, F.lower), "|").alias("kept")
    )


_WRITTEN = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' | ' || p_type || '/ ' || upper(p_name) WHEN 1 THEN '1204 ' || p_name || ' calling at Platform ' || p_size || ' Departures ' || p_type WHEN 2 THEN 'all of the ' || p_name || ' here' ELSE 'x' END"
_UNITS = r"""list_transform(flatten(list_transform(list_filter(list_transform(string_split_regex(t, '[|/]+'), lambda p: trim(p)), lambda p: p <> ''), lambda p: CASE WHEN len(string_split(p, ' ')) <= 3 THEN [p]
ELSE list_concat(regexp_extract_all(p, '\b\d{3,4}\s+[A-Za-z0-9&\-.'']+(?:\s+[A-Za-z0-9&\-.'']+){0,4}'), list_filter(regexp_extract_all(p, '\b[A-Z][a-zA-Z]+\b'), lambda w: lower(w) IN ('departures', 'cancelled', 'delayed', 'platform'))) END)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')))"""


@query(f"""WITH a AS (SELECT p_partkey, {SQUEEZED.format(_WRITTEN)} AS t FROM part), b AS (SELECT *, list_filter({_UNITS}, lambda p: length(p) >= 2) AS u FROM a), d AS (SELECT *, {first_sql('u', 'lower({0})')} AS f FROM b)
SELECT p_partkey, array_to_string(CASE WHEN len(f) > 0 THEN f[1:10] WHEN length(t) >= 2 THEN [t] ELSE [] END, '~') AS units FROM d""")
def q_visible_units(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.array_join(text.visible_units(F.expr(_WRITTEN)), "~").alias("units"))


def exact_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} IN ({sql_list(words)[1:-1]}) THEN '{tag}'" for tag, words in text.EXACT_TAGS.items()) + " ELSE 'object' END"


_ROLE = "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Observer' WHEN 2 THEN 'the company identifier mark' WHEN 3 THEN 'Person in distress' ELSE ' part of  a stage ' END"
_ROLES = "CASE WHEN list_contains(tags, 'person') AND {0} THEN 'person detail' WHEN list_contains(tags, 'person') THEN 'main person' ".format(contains_any_sql("s", ["hand", "arm", "head", "face"])) + " ".join(
    f"WHEN list_contains(tags, '{t}') THEN '{r}'" for t, r in text.ROLES_OF_TAGS.items()
) + " ELSE 'visible scene element' END"


@query(f"""WITH a AS (SELECT p_partkey, {_ROLE} AS role, p_name AS span, {SPAN.format('p_name')} AS s, list_filter([string_split(p_name, ' ')[-1], CASE WHEN p_size % 2 = 0 THEN 'Man' ELSE '' END], lambda x: x <> '') AS own, CASE WHEN p_size % 3 = 0 THEN ['vehicle'] ELSE [] END AS given FROM part),
m AS (SELECT *, list_transform(list_concat(own, given), lambda x: {exact_sql(SPAN.format('x'))}) AS every FROM a), u AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS once FROM m),
f AS (SELECT *, CASE WHEN len(once) > 1 THEN list_filter(once, lambda x: x <> 'object') ELSE once END AS tags FROM u)
SELECT p_partkey, array_to_string(tags, ',') AS tags, CASE WHEN role = '' OR lower(role) IN ({sql_list(text.INTERPRETIVE_ROLES)[1:-1]}) THEN {_ROLES} WHEN contains(lower(role), 'distress') THEN 'person detail' WHEN contains(lower(role), 'identifier') THEN 'text element'
WHEN contains(lower(role), 'observer') THEN 'background person' WHEN contains(lower(role), 'mail carrier') THEN 'main person' ELSE {SQUEEZED.format('role')} END AS role FROM f""")
def q_tags_and_roles(spark, sf_dir):
    own = F.array(F.element_at(F.split("p_name", " "), -1), F.when(c("p_size") % 2 == 0, "Man").otherwise(""))
    given = F.when(c("p_size") % 3 == 0, F.array(F.lit("vehicle"))).otherwise(F.array().cast("array<string>"))
    tagged = spread(table(spark, sf_dir, "part")).withColumn("tags", text.semantic_tags(own, given, c("p_name"))["tags"])
    return tagged.select(
        "p_partkey", F.array_join("tags", ",").alias("tags"),
        text.functional_role(F.expr(_ROLE), c("p_name"), c("tags")).alias("role")
    )


_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'Next to' WHEN 1 THEN ' Holding ' WHEN 2 THEN 'on' ELSE 'likes' END"
_HUMAN = "CASE p_partkey % 3 WHEN 0 THEN 'Woman' WHEN 1 THEN 'command' ELSE p_name END"


@query(f"""SELECT p_partkey, p_size % 4 = 0 AND p_size % 3 <> 0 AS weak, p_size % 7 = 0 AS vague, p_size % 5 = 0 AS not_groundable, p_partkey % 3 = 0 AS human, replace({SPAN.format(_KIND)}, ' ', '_') AS relation,
CASE p_partkey % 4 WHEN 1 THEN 'action' WHEN 2 THEN 'spatial' ELSE 'other' END AS kind, CASE p_size % 4 WHEN 2 THEN 'vegetation' WHEN 3 THEN 'object' ELSE 'people' END AS category,
CASE WHEN p_size % 6 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 4 ELSE 2 END AS queries, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 9 THEN 'medium' ELSE 'small' END AS size, CASE WHEN p_size / 50.0 > 0.7 THEN 'high' WHEN p_size / 50.0 > 0.4 THEN 'medium' ELSE 'low' END AS grounding FROM part""")
def q_anchor_flags(spark, sf_dir):
    size = c("p_size")
    tags = F.array(F.when(size % 4 < 2, "Person").when(size % 4 == 2, " plant").otherwise("food"))
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey",
        text.is_weak(F.when(size % 4 == 0, " Small").otherwise("full"), F.when(size % 3 == 0, "HIGH").otherwise("low")).alias("weak"),
        text.is_vague(F.when(size % 7 == 0, F.concat(F.lit("the Background "), "p_name")).otherwise(c("p_name"))).alias("vague"),
        text.is_non_groundable(F.when(size % 5 == 0, " Off-Camera ").otherwise(c("p_name"))).alias("not_groundable"),
        text.has_human_term(F.struct(F.struct(F.expr(_HUMAN).alias("category")).alias("inner"))).alias("human"),
        text.relation_type(F.expr(_KIND)).alias("relation"),
        text.relation_kind(F.expr(_KIND)).alias("kind"),
        text.category_of_tags(tags, F.when(size % 4 == 0, "two men in a crowd").otherwise("tall man")).alias("category"),
        text.query_limit(F.when(size % 6 == 0, "background").otherwise("object"), size % 2 == 0, 2, 4).alias("queries"),
        scoring.size_hint(size / 300).alias("size"),
        scoring.grounding_hint(size / 50).alias("grounding"),
    )


_TOKENS = f"list_filter(regexp_extract_all({{0}}, '[a-z0-9]+'), lambda x: NOT list_contains({sql_list(text.STOPWORDS)}, x))"
_SINGULAR = "CASE WHEN ends_with({0}, 'ies') AND length({0}) > 4 THEN left({0}, -3) || 'y' WHEN ends_with({0}, 'ses') AND length({0}) > 4 THEN left({0}, -2) WHEN ends_with({0}, 's') AND length({0}) > 3 AND NOT ends_with({0}, 'ss') THEN left({0}, -1) ELSE {0} END"


@query(f"""WITH p AS (SELECT p_partkey, p_brand || p_size % 10 AS s, p_name || CASE WHEN p_size % 3 = 0 THEN 's' ELSE '' END AS t FROM part), t AS (SELECT *, {_TOKENS.format('t')} AS w, {_TOKENS.format('t')}[-1] AS h FROM p),
j AS (SELECT a.p_partkey, b.p_partkey AS anchor, CASE WHEN a.t = b.t THEN 10.0 ELSE (CASE WHEN a.h = b.h THEN 5.0 ELSE 0.0 END) + (CASE WHEN {_SINGULAR.format('a.h')} = {_SINGULAR.format('b.h')} THEN 3.0 ELSE 0.0 END) + len(list_intersect(list_distinct(a.w), list_distinct(b.w)))
+ len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(b.w)) END AS score FROM t a JOIN t b ON a.s = b.s AND a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0)
SELECT p_partkey, anchor, CAST(score AS DOUBLE) AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, anchor) AS n FROM j WHERE score >= 2.5) WHERE n = 1""")
def q_resolve_entities(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(
        F.concat("p_brand", (c("p_size") % 10).cast("string")).alias("sample_id"), "p_partkey",
        F.concat("p_name", F.when(c("p_size") % 3 == 0, "s").otherwise("")).alias("t")
    )
    phrases, held = named.where("p_partkey % 2 = 1").select("sample_id", c("p_partkey").alias("phrase_id"), c("t").alias("phrase")), named.where("p_partkey % 2 = 0").select(
        "sample_id", c("p_partkey").alias("anchor"), c("t").alias("anchor_text")
    )
    return relational.resolve_entities(phrases, held, "phrase", "anchor_text", "anchor").select(c("phrase_id").alias("p_partkey"), "anchor", "match_score")


_SAID = "CASE o_orderkey % 4 WHEN 0 THEN '[MASK] m; [FILL] ' || o_orderpriority || ' hat;; [VISUAL] soft  light , warm' WHEN 1 THEN '[fill] lower ' || o_orderstatus WHEN 2 THEN '[FILL]one two three four five six seven eight nine ten eleven' ELSE ' no marks ' || o_orderstatus END"


@query(f"""WITH a AS (SELECT o_orderkey, o_orderpriority AS p, {_SAID} AS t FROM orders), b AS (SELECT *, regexp_extract(t, '(?is)\\[FILL\\](.*?)(?:\\[VISUAL\\]|$)', 1) AS f, regexp_matches(t, '(?is)\\[FILL\\]') AS any_, regexp_matches(t, '(?s)\\[FILL\\]') AS exact FROM a)
SELECT o_orderkey, CASE WHEN any_ THEN trim(regexp_replace(trim(f), ';+$', '')) ELSE trim(t) END AS fill, CASE WHEN exact THEN trim(regexp_replace(trim(f), ';+$', '')) ELSE t END AS exact_fill, trim(regexp_extract(t, '(?s)\\[VISUAL\\](.*?)$', 1)) AS visual,
lower(p) || '|' || o_orderkey % 5 || ' cap|' || array_to_string(string_split({LOWER.format("CASE WHEN any_ THEN f ELSE t END")}, ' ')[1:10], ' ') AS fingerprint, regexp_replace({SQUEEZED.format('t')}, '\\s+,', ',', 'g') AS compact,
CASE WHEN length(p) + 2 + length(p || ' more') <= 20 THEN p || ', ' || p || ' more' ELSE p END AS joined FROM b""")
def q_clauses(spark, sf_dir):
    said, p = F.expr(_SAID), c("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.fill_clause(said).alias("fill"),
        text.fill_clause(said, any_case=False).alias("exact_fill"),
        text.visual_clause(said).alias("visual"),
        text.fingerprint(p, F.concat((c("o_orderkey") % 5).cast("string"), F.lit(" Cap ")), said).alias("fingerprint"),
        text.compact_prompt(said).alias("compact"),
        text.joined_within(F.array(p, F.lit(""), F.concat(p, F.lit(" more"))), 20).alias("joined"),
    )


_WORDS = "string_split(p_name || ' ' || lower(p_type) || ' ' || p_name || ' object ' || string_split(p_name, ' ')[-1] || 's of', ' ')"
_GENERIC = f"{{0}} IN ({sql_list(text.GENERIC_SPANS)[1:-1]}) OR length({{0}}) <= 2"
_NUMBERED = f"""w AS (SELECT p_partkey, p_brand, p_name, p_type, unnest({_WORDS}) AS span, unnest(range(1, len({_WORDS}) + 1)) AS i FROM part), g AS (SELECT * FROM w WHERE NOT ({_GENERIC.format('span')})),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, span ORDER BY i) AS f FROM g) WHERE f = 1)"""


def worded(spark, sf_dir):
    """Parts with an anchor for each word of name and type; each points to the next word's."""
    words = F.split(
        F.concat(
            "p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), "p_name", F.lit(" object "),
            F.element_at(F.split("p_name", " "), -1), F.lit("s of")
        ),
        " "
    )
    none = F.array().cast("array<string>")
    word = lambda w, i: F.struct(
        F.concat(F.lit("x"), i.cast("string")).alias("anchor_id"),
        w.alias("span"),
        F.array(text.span_tag(w)).alias("semantic_tags_raw"),
        none.alias("semantic_tags"),
        F.lit("thing").alias("functional_role"),
        F.struct(F.lit("").alias("level"), F.lit("LEFT").alias("region_hint")).alias("localization"),
        none.alias("attributes"),
        F.array(F.struct(F.lit("Next to").alias("type"), F.concat(F.lit("x"), (i + 1).cast("string")).alias("target_anchor_id"))).alias("relations"),
        F.when(i % 2 == 0, "small").otherwise("full").alias("visibility"),
        F.lit("?").alias("salience"),
        F.lit("low").alias("confidence"),
    )
    return spread(table(spark, sf_dir, "part")).withColumn("anchors", F.transform(words, word))


@query(f"""WITH {_NUMBERED} SELECT k.p_partkey, string_agg('a' || k.n || ':' || k.span || CASE WHEN t.n IS NULL THEN '' ELSE ':next_to:a' || t.n END || ':' || CASE WHEN k.i % 2 = 1 THEN 'small' ELSE 'full' END || ':left:medium', ' ' ORDER BY k.n) AS anchors
FROM k LEFT JOIN k t ON k.p_partkey = t.p_partkey AND t.i = k.i + 1 GROUP BY k.p_partkey""")
def q_postprocessed(spark, sf_dir):
    shown = lambda a: F.concat_ws(
        ":", a["anchor_id"], a["span"],
        F.transform(a["relations"], lambda r: F.concat_ws(":", r["type"], r["target_anchor_id"])),
        a["visibility"], a["localization"]["region_hint"], a["salience"]
    )
    return worded(spark, sf_dir).select("p_partkey", F.array_join(F.transform(anchors.postprocessed(c("anchors")), shown), " ").alias("anchors"))


@query(f"""WITH {_NUMBERED}, s AS (SELECT p_partkey, list(span ORDER BY n) AS spans, any_value(p_brand) AS b, any_value(p_name) AS name FROM k GROUP BY p_partkey), 
x AS (SELECT p_partkey, list(span ORDER BY i) AS strong FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, span ORDER BY i) AS f FROM g WHERE i % 2 = 0 OR span = string_split(p_name, ' ')[-1]) WHERE f = 1 GROUP BY p_partkey)
SELECT p_partkey, array_to_string(list_concat(spans, [b, name]), '|') AS with_text, array_to_string(list_concat(spans, [name || ' lid']), '|') AS with_missed, coalesce(array_to_string(strong, '|'), '') AS without_weak FROM s LEFT JOIN x USING (p_partkey)""")
def q_enriched_anchors(spark, sf_dir):
    spans = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), "|")
    rows = worded(spark, sf_dir).withColumn(
        "missed",
        F.transform(
            F.array(F.concat("p_name", F.lit(" lid")), F.lit("object"), F.element_at(F.split("p_name", " "), 1)),
            lambda s: F.get(c("anchors"), F.lit(0)).withField("span", s)
        )
    )
    first, last = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1)
    return rows.select(
        "p_partkey",
        spans(anchors.with_visible_text(c("anchors"), F.array("p_brand", first, F.lit("sign"), "p_name"), F.lit(""))).alias("with_text"),
        spans(anchors.with_missed(c("anchors"), c("missed"))).alias("with_missed"),
        spans(anchors.without_weak(c("anchors"), [F.array(last)], F.lit(""))).alias("without_weak"),
    )


_CAPTION = "['The ' || p_name, 'object', p_name || ' top', p_brand, p_type || ' wall', upper(p_name), p_brand || ' stand', p_type]"


@query(f"""WITH l AS (SELECT p_partkey, {_CAPTION} AS l FROM part), k AS (SELECT p_partkey, list_filter({first_sql('l', SPAN)}, lambda x: NOT ({_GENERIC.format(SPAN.format('x'))})) AS k FROM l)
SELECT p_partkey, array_to_string(list_transform(k, lambda x: x || '=' || {exact_sql(tag_sql(SPAN.format('x')))}), '|') AS anchors FROM k""")
def q_caption_anchors(spark, sf_dir):
    p, b, t = c("p_name"), c("p_brand"), c("p_type")
    made = anchors.from_caption(
        F.array(F.concat(F.lit("The "), p), F.lit("object")), F.array(F.concat(p, F.lit(" top")), b),
        F.array(F.concat(t, F.lit(" wall"))), F.array(F.upper(p)), F.concat(b, F.lit(" stand | "), t)
    )
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey",
        F.array_join(F.transform(made, lambda a: F.concat(a["span"], F.lit("="), F.array_join(a["semantic_tags"], ","))), "|").alias("anchors")
    )


_GOOD = '{{"anchor_id": "a1", "span": "red car", "semantic_tags": [], "functional_role": "x", "localization": {{"level": "o", "region_hint": "left"}}, "attributes": [], "relations": []}}'
#: Payloads with one defect each, and what is said of it.
DEFECTS = [
    ('{{"grounded_context_caption": "c", "anchors": [{g}]}}', None),
    ("[1]", "anchors_not_dict"),
    ('{{"anchors": []}}', "anchors_missing_top_keys"),
    ('{{"grounded_context_caption": 1, "anchors": []}}', "anchors_invalid_grounded_context_caption"),
    ('{{"grounded_context_caption": "c", "anchors": {{}}}}', "anchors_invalid_list"),
    ('{{"grounded_context_caption": "c", "anchors": []}}', "too_few_anchors:0"),
    ('{{"grounded_context_caption": "c", "anchors": [{g}, 5]}}', "anchor_not_dict:1"),
    ('{{"grounded_context_caption": "c", "anchors": [{{"anchor_id": ""}}]}}', "anchor_invalid_id:0"),
    ('{{"grounded_context_caption": "c", "anchors": [{g}, {g}]}}', "duplicate_anchor_id:a1"),
    ('{{"grounded_context_caption": "c", "anchors": [{{"anchor_id": "b", "span": "x"}}]}}', "anchor_missing_key:b:semantic_tags"),
]
for _old, _new, _why in (
    ('"span": "red car"', '"span": " "', "anchor_invalid_span:a1"),
    ('"span": "red car"', '"span": "The Sign"', "anchor_generic_span:a1:The Sign"),
    ('"semantic_tags": []', '"semantic_tags": "x"', "anchor_invalid_semantic_tags:a1"),
    ('"functional_role": "x"', '"functional_role": null', "anchor_invalid_functional_role:a1"),
    ('"attributes": []', '"attributes": {{}}', "anchor_invalid_attributes:a1"),
    ('"relations": []', '"relations": null', "anchor_invalid_relations:a1"),
    ('"level": "o", ', "", "anchor_missing_localization_fields:a1"),
    ('"level": "o"', '"level": 3', "anchor_invalid_localization_fields:a1"),
):
    DEFECTS.append(('{{"grounded_context_caption": "c", "anchors": [' + _GOOD.replace(_old, _new) + "]}}", _why))
CAPTIONS = [
    ('{"image_caption_literal": "a", "visible_text": "", "people_count": 1, "notable_objects": []}', None),
    ('"x"', "caption_not_dict"),
    ('{"image_caption_literal": "a", "people_count": 1, "notable_objects": []}', "caption_missing_key:visible_text"),
    ('{"image_caption_literal": "a", "visible_text": 5, "people_count": 1, "notable_objects": []}', "caption_invalid_visible_text"),
    ('{"image_caption_literal": "a", "visible_text": "", "people_count": "1", "notable_objects": []}', "caption_invalid_people_count"),
    ('{"image_caption_literal": "a", "visible_text": "", "people_count": 1.5, "notable_objects": []}', "caption_invalid_people_count"),
    (
        '{"image_caption_literal": "a", "visible_text": "", "people_count": 1, "notable_objects": [], "visible_regions": 1}',
        "caption_invalid_visible_regions"
    ),
]
CONTEXTS = [
    ('{"article_context_rewrite": "x"}', None), ("[]", "context_not_dict"),
    ("{}", "context_missing_article_context_rewrite"),
    ('{"article_context_rewrite": 1}', "context_invalid_article_context_rewrite")
]
MISSED = [('{"missed_anchors": []}', None), ("1", "missed_not_dict"), ('{"missed_anchors": "x"}', "missed_invalid_list")]


def _said(rows: list) -> str:
    return f"CASE p_partkey % {len(rows)} " + " ".join(
        f"WHEN {i} THEN " + ("NULL" if why is None else f"'{why}'") for i, (_, why) in enumerate(rows)
    ) + " END"


@query(
    f"SELECT p_partkey, {_said(DEFECTS)} AS anchors, {_said(CAPTIONS)} AS caption, {_said(CONTEXTS)} AS context, {_said(MISSED)} AS missed FROM part"
)
def q_payload_errors(spark, sf_dir):
    good = _GOOD.format()
    pick = lambda rows: F.parse_json(F.get(F.array(*[F.lit(t) for t, _ in rows]), (c("p_partkey") % len(rows)).cast("int")))
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey",
        jsonops.anchors_error(pick([(t.format(g=good), w) for t, w in DEFECTS])).alias("anchors"),
        jsonops.caption_error(pick(CAPTIONS)).alias("caption"),
        jsonops.context_error(pick(CONTEXTS)).alias("context"),
        jsonops.missed_error(pick(MISSED)).alias("missed"),
    )


_SIDES = "SELECT vec_id, k, abs(embedding[4 * k + 1]::DOUBLE) * 600 AS x, abs(embedding[4 * k + 2]::DOUBLE) * 600 - 20 AS y, abs(embedding[4 * k + 3]::DOUBLE) AS w, abs(embedding[4 * k + 4]::DOUBLE) AS h FROM embeddings, (SELECT unnest(range(16)) AS k)"


@query(f"""WITH s AS ({_SIDES}) SELECT vec_id, CAST(k AS INTEGER) AS k, least(greatest(0.0, least(x, 99.0)), greatest(0.0, least(y, 99.0))) AS low, greatest(0.0, least(x + w * 600, 99.0)) AS right_, ((x / 600) - w / 2) * 100 AS left_px, ((x / 600) + w / 2) * 100 AS right_px,
greatest(0.0, x - greatest(4.0, floor(greatest(1.0, w * 600 + 1) * 0.12))) AS wider, least(99.0, x + w * 600 + greatest(4.0, floor(greatest(1.0, w * 600 + 1) * 0.12))) AS wider_right FROM s""")
def q_box_maths(spark, sf_dir):
    at = lambda i: F.abs(F.get("embedding", (c("k") * 4 + i).cast("int")).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    x, y, w, h = at(0) * 600, at(1) * 600 - 20, at(2), at(3)
    wide, tall = F.lit(100), F.lit(100)
    rows = rows.select("vec_id", "k", F.array(x, y, x + w * 600, y + h * 600).alias("box"), F.array(x / 600, y / 600, w, h).alias("relative"))
    cut, px, grown = geometry.clipped(c("box"), wide, tall), geometry.from_centre(c("relative"), wide, tall), geometry.expanded(c("box"), wide, tall)
    return rows.select(
        "vec_id", "k", F.least(cut[0], cut[1]).alias("low"), cut[2].alias("right_"), px[0].alias("left_px"),
        px[2].alias("right_px"), grown[0].alias("wider"), grown[2].alias("wider_right")
    )
