"""Work that grows no faster than its input: values are worked out once, lists don't move, equal texts are compared once."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import coerce, geometry, jsonops, scoring, text
from sievework.operators import anchors, gates, relational
from sievework.plans import catalogue

c = F.col
SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    return df._jdf.queryExecution().executedPlan().toString()


def times(df, x, what: str) -> int:
    """How often `what` is worked out in an expression over df."""
    return plan_of(df.select(x.alias("y"))).count(what)


def outside(x, kind="string"):
    """x by a Python function: Spark refuses one inside a lambda, where a value is worked out again for each element."""
    return F.udf(lambda v: v, kind)(x)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("The Red  Car",), ("religious man",), (None,)], "x string")


def spread_out(spark, name: str) -> bool:
    return catalogue.queries()[name](spark, SF).rdd.getNumPartitions() >= 24


def test_postprocessed(spark, words):
    """items of distinct_by and spans of anchors are worked out once; a small file is dealt over all cores."""
    once = words.select(coerce.distinct_by(F.transform(F.array("x"), F.soundex), lambda x: x).alias("y"))
    assert plan_of(once).count("soundex(") == 1
    assert times(words, text.normal_span(c("x")), "regexp_replace") <= 3
    assert spread_out(spark, "postprocessed")
    keyed = spark.createDataFrame([([("b", 1), (None, 2), ("a", 3), ("b", 4), (None, 5)],)], "x array<struct<k:string,v:int>>")
    assert [r["v"] for r in keyed.select(coerce.distinct_by(c("x"), lambda r: r["k"]).alias("y")).first()["y"]] == [1, 2, 3, 5]


def test_normal_span(spark):
    said = ["- the  an a x -", "The", "a.b the c", " the dog ,", "...", "an  an apple,the pear", "x - the - y", "The a", "-the dog"]
    got = spark.createDataFrame([(s,) for s in said], "x string").select(text.normal_span(c("x")).alias("y")).collect()
    assert [r["y"] for r in got] == ["x", "the", "a.b c", "dog", "", "apple,pear", "x - - y", "a", "dog"]


def test_relation_edges(spark):
    """lists of relations are neither sorted nor moved, edges are numbered as before."""
    plan = plan_of(catalogue.queries()["relation_edges"](spark, SF))
    assert "SortMergeJoin" not in plan
    # lines move once, with two numbers each; the other side of the join may be the same rows again
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) <= 2
    rows = [("s", 2, [("on", 9), ("on", 1), ("by", 1), ("on", 1)]), ("s", 1, [("on", 1)]), ("s", 5, []), ("t", 1, [("on", 2)]), ("u", 1, None)]
    kind = "sample_id string, anchor_id long, relations array<struct<type:string,target_anchor_id:long>>"
    got = relational.relation_edges(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["sample_id"], r["relation_index"], r["subject"], r["predicate"], r["object"]) for r in got) == [
        ("s", 0, 1, "on", 1), ("s", 1, 2, "on", 1), ("s", 2, 2, "by", 1)
    ]


def test_suppression(spark):
    """no call to Python for each group; the rows kept are those of greedy_nms(), ties by order."""
    rng = random.Random(5)
    rows = []
    for g in range(60):
        for k in range(rng.choice([1, 3, 12, 40])):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((g, k, [float(x), float(y), float(x + rng.randrange(30)), float(y + rng.randrange(30))], rng.randrange(8) / 8, {"m": k}))
    rows.append((60, 0, [0.0, 0.0, float("nan"), 5.0], 0.5, None))
    rows.append((60, 1, [0.0, 0.0, 5.0, 5.0], float("nan"), None))
    df = spark.createDataFrame(rows, "g int, k int, box array<double>, score double, more map<string,int>")
    kept = geometry.nms(df.repartition(7), ["g"], limit=0.3, order=["k"])
    assert "Pandas" not in plan_of(kept)
    want = set()
    for g in {r[0] for r in rows}:
        held = [r for r in rows if r[0] == g]
        want |= {(g, held[i][1]) for i in geometry.greedy_nms([r[2] for r in held], [r[3] for r in held], 0.3)}
    assert kept.columns == df.columns
    assert {(r["g"], r["k"]) for r in kept.collect()} == want
    assert geometry.nms(df, ["g"], limit=0.3).count() > 60
    assert "Pandas" not in plan_of(catalogue.queries()["selected_detections"](spark, SF))


def test_caption(spark, words):
    """a caption's visible text is taken apart once."""
    lists = F.array("x")
    assert times(words, anchors.from_caption(lists, lists, lists, lists, c("x")), "regexp_extract_all") == 2
    assert spread_out(spark, "caption_anchors")


def test_enriched(spark):
    """spans that are compared are worked out once."""
    df = spark.createDataFrame([([], [])], f"anchors array<struct<{anchors.ANCHOR}>>, missed array<struct<{anchors.ANCHOR}>>".replace("> string", ">"))
    found = [
        times(df, x, "regexp_replace") for x in (
            anchors.with_missed(c("anchors"), c("missed")),
            anchors.with_visible_text(c("anchors"), F.array(F.lit("a")), F.lit("b")),
            anchors.without_weak(c("anchors"), [F.array(F.lit("a"))], F.lit("b"))
        )
    ]
    assert max(found) < 50, found


def test_resolve_entities(spark):
    """equal texts are compared once; those that share no term aren't."""
    said = ["red cars", "blue hat", "the"]
    phrases = spark.createDataFrame([("s", i, said[i % 3]) for i in range(900)], "sample_id string, phrase_id int, phrase string")
    held = spark.createDataFrame(
        [("s", i, ["red car", "blue", "the", "tree", ""][i % 5]) for i in range(900, 0, -1)], "sample_id string, anchor int, anchor_text string"
    )
    pairs = relational.entity_pairs(phrases, held, "phrase", "anchor_text").collect()
    assert sorted((r["_p"], r["_t"], r["match_score"]) for r in pairs) == [("blue hat", "blue", 2.0), ("red cars", "red car", 4.5), ("the", "the", 10.0)]
    got = relational.resolve_entities(phrases, held, "phrase", "anchor_text", "anchor").collect()
    assert sorted((r["phrase_id"], r["anchor"], r["match_score"]) for r in got) == sorted(
        (i, 5 if i % 3 == 0 else 2, 4.5 if i % 3 == 0 else 10.0) for i in range(900) if i % 3 != 1
    )


def test_detections_are_suppressed(spark):
    """boxes that cover each other aren't both chosen, and an anchor of several has up to four."""
    got = catalogue.queries()["selected_detections"](spark, SF).collect()
    by_part = {}
    for r in got:
        by_part.setdefault(r["p_partkey"], []).append(r["x1"])
    assert all(len(set(x)) == len(x) for x in by_part.values())
    assert max(map(len, by_part.values())) == 4


def test_span_tag(spark, words):
    """F8: a span is made normal once, not for each word of the tags."""
    assert [r[0] for r in words.select(text.span_tag(outside(c("x")))).collect()] == ["vehicle", "person", "object"]
    assert times(words, text.span_tag(c("x")), "regexp_replace") <= 5
    assert spread_out(spark, "infer_tag")


def test_term_hits(words):
    """a text is made lower case once, not for each term."""
    assert [r[0] for r in words.select(gates.term_hits(outside(c("x")), ["religious", "red", "car"])).collect()] == [["red", "car"], ["religious"], []]


def test_payload_errors(spark, words):
    """a payload is parsed and its keys are listed once."""
    df = words.withColumn("v", F.lit('{"grounded_context_caption": "c", "anchors": [{"anchor_id": "a"}, {"anchor_id": "a"}]}'))
    assert times(df, jsonops.anchors_error(F.parse_json(outside(c("v")))), "StructsToJsonEvaluator") <= 3
    assert times(df, jsonops.caption_error(F.parse_json("v")), "StructsToJsonEvaluator") == 1
    assert spread_out(spark, "payload_errors")


def test_sensitive_flag(words):
    """terms of article and edits are looked up once for both test and result."""
    edits = F.array(F.struct(F.lit("low").alias("severity"), F.lit(0).alias("candidate_index"), F.lit("gay").alias("edited_anchor"), F.lit("x").alias("edit_instruction")))
    flag = words.select(gates.sensitive_flag(outside(c("x")), edits).alias("f"))
    assert plan_of(flag).count("regexp_replace") <= 2
    assert [r["f"] and r["f"]["context_terms_matched"] for r in flag.collect()] == [None, ["religious"], None]


def test_softmax_match(spark):
    """the largest number and the sum of a vector are worked out once, not for each of its numbers."""
    df = spark.createDataFrame([([1.0, 2.0, 0.5],), ([],)], "x array<double>")
    match = geometry.softmax_match(outside(c("x"), "array<double>"), 1)
    assert times(df, match, "EXP(") == 1
    assert [r["m"]["match"] for r in df.select(match.alias("m")).collect()] == [True, None]
    assert spread_out(spark, "clip_verify")


def test_planning(words):
    """an anchor's text is made lower case once for all keywords."""
    tier = scoring.object_tier(outside(c("x")), F.lit("b"))
    assert [r["t"]["reason"] for r in words.select(tier.alias("t")).collect()] == ["car", "default_fallback", "default_fallback"]
    assert times(words, scoring.allowed_operations(c("x"), F.lit(None).cast("string"), F.lit(0.5)), "regexp_replace") <= 4


def test_examples(words):
    """words of two headlines are listed once for their union and intersection."""
    assert times(words, text.lexical_change(c("x"), F.upper("x")), "regexp_replace") <= 4


def test_has_any(spark):
    """A word may begin another, hold marks of patterns, or be empty."""
    said = ["x cup", "cu", "cap.", "capx", "a-b", "[", "", None]
    df = spark.createDataFrame([(s,) for s in said], "x string")
    for listed in (["cup", "cu"], ["cap.", "caps", "a-b"], ["[", "]^"], ["é", "cap"]):
        got = [r[0] for r in df.select(text.has_any(c("x"), listed)).collect()]
        assert got == [None if s is None else any(w in s for w in listed) for s in said]
    assert [r[0] for r in df.select(text.has_any(c("x"), [])).collect()] == [False] * len(said)
