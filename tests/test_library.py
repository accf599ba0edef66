"""Golden cases of the library's operators, boundary values included."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import coerce, geometry, jsonops, raster, routing, scoring, text
from sievework.operators import anchors, gates, inference, relational, release
from sievework.sources import scans, sinks
from sievework.streaming import gates as streams

c = F.col


def column(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_coercion(spark):
    assert column(spark, coerce.clamp(c("x")), [("0.5",), ("2",), ("x",), (None,), ("-1",)], "x string") == [0.5, 1.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="number is required|CAST_INVALID_INPUT"):
        column(spark, coerce.strict_clamp(c("x")), [(None,)], "x double")
    assert column(spark, coerce.clean_string_list(c("x")), [([" a  b", "A B", None, "", "c"],), (None,)], "x array<string>") == [["a b", "c"], []]
    assert column(spark, coerce.variant_str(F.parse_json("x")), [('"a"',), ("5",), ("{}",)], "x string") == ["a", "", ""]
    assert column(spark, coerce.repaired_utf8(c("x")), [("CafÃ©",), ("Café",), ("日本",), ("plain",)], "x string") == ["Café", "Café", "日本", "plain"]
    assert column(spark, coerce.rooted(c("x"), "/r"), [("a/b",), ("/a",), ("",), (None,)], "x string") == ["/r/a/b", "/a", None, None]
    assert column(spark, coerce.record_id(c("x")), [(0,), (1234566,)], "x int") == ["000001", "1234567"]


def test_texts(spark):
    assert column(spark, text.normal_span(c("x")), [(" - The  big Car. ",), ("a an the",)], "x string") == ["big car", "the"]
    assert column(
        spark, text.span_tag(c("x")), [("landscape",), ("red car",), ("zzz",), ("woman",)], "x string"
    ) == ["accessory", "vehicle", "object", "person"]
    assert column(
        spark, text.mapped_tag(c("x")), [("headwear",), ("the bus",), ("hand",), ("sign_text",)], "x string"
    ) == ["accessory", "vehicle", "object", "sign_text"]
    assert column(spark, text.words_only(c("x")), [("Don't—STOP, ünder_x!",), (None,)], "x string") == ["don't stop ünder_x", ""]
    assert column(
        spark, text.visible_units(c("x")),
        [("GATE 5 | exit / GATE 5",), ("1234 Leeds Central calling at Platform nine",), ("",), ("x",)],
        "x string"
    ) == [["GATE 5", "exit"], ["1234 Leeds Central calling at Platform", "Platform"], [], []]
    assert column(
        spark, text.candidate_queries(c("x"), F.lit("object")), [("red cars in a scene view",), ("",)],
        "x string"
    ) == [["red cars in a scene view", "red cars", "view"], []]
    assert column(
        spark, text.category_of_tags(F.array(c("x")), F.lit("man")), [("person",), ("plant",), ("food",)],
        "x string"
    ) == ["people", "vegetation", "object"]
    assert column(spark, text.fill_clause(c("x")), [("[mask] a; [fill] b c; [visual] d",), ("none",)], "x string") == ["b c", "none"]
    assert column(
        spark, text.fill_clause(c("x"), any_case=False), [("[MASK] a; [FILL] b; [VISUAL] d",), ("[fill] b",)],
        "x string"
    ) == ["b", "[fill] b"]
    assert column(spark, text.slug(c("x")), [("A b/C!",), ("__",), ("x" * 60,)], "x string") == ["a_b_c", "item", "x" * 48]
    assert column(
        spark, text.has_human_term(F.struct(F.struct(c("x").alias("category")).alias("n"))),
        [("Man",), ("woman ",), ("command",)], "x string"
    ) == [True, True, False]
    assert column(
        spark, text.match_score(c("x"), F.lit("red car")), [("red car",), ("blue cars",), ("",), ("car",)],
        "x string"
    ) == [10.0, 3.0, -1.0, 9.5]
    assert column(spark, text.joined_within(c("x"), 10), [(["abc", "defg", "hijkl"],)], "x array<string>") == ["abc, defg"]


def test_json(spark):
    texts = [
        '{"a": 1}', '```json\n{"a": 1}\n```', 'sure: {"a": 1} ok', '<think>{"b": 2}</think> {"a": 1}',
        '{"a": 1, "b": [{"c": 2}, {"d', "no json", None
    ]
    got = column(spark, jsonops.extracted(c("x")), [(t,) for t in texts], "x string")
    assert [json.loads(g) if g else None for g in got] == [{"a": 1}] * 4 + [{"a": 1, "b": [{"c": 2}]}, None, None]
    assert column(
        spark, jsonops.has_fields(F.parse_json("x"), {"a": "STRING", "b": "ARRAY"}),
        [('{"a": "x", "b": []}',), ('{"a": 1}',)], "x string"
    ) == [[], ["invalid_a", "missing_b"]]


def test_text_gate(spark):
    cases = {
        " ": "empty_text", "a [FILL] b c": "prompt_markup_left_in_text", "two words": "too_short",
        "w " * 81: "too_long", "so goooood now": "repeated_chars", "one two three": "too_similar_to_original",
        "one two four": "ok"
    }
    got = column(spark, gates.text_reason(c("x"), F.lit("Three, one two")), [(t,) for t in cases], "x string")
    assert got == list(cases.values())
    assert column(spark, gates.text_reason(c("x"), F.lit("")), [("a b c",)], "x string") == ["ok"]


def test_technical_validity(spark):
    ok = ("ok", "ok", "m", 0.002, 0.35, 0.30, "a car")
    change = lambda i, v: tuple(v if k == i else x for k, x in enumerate(ok))
    rows = [
        ok, change(1, "bad"), change(2, ""), change(3, None), change(3, 0.0019), change(3, 0.61),
        change(4, None), change(4, 0.34), change(5, 0.29), change(5, None), change(6, "the area"),
        change(6, ""), change(3, 0.60)
    ]
    want = [
        None, "status_not_ok", "no_union_mask", "missing_mask_stats", "mask_too_small", "mask_too_large",
        "low_grounding_score", "low_grounding_score", "low_verify_score", None, "vague_anchor",
        "vague_anchor", None
    ]
    assert column(
        spark, gates.technical_reason(*[c(x) for x in "abcdefg"]), rows,
        "a string, b string, c string, d double, e double, f double, g string"
    ) == want


def test_calibration_and_buckets(spark):
    points = scoring.calibration_points({"points": [[0.2, 0.1], [0.5, 0.4], {"raw": 0.5, "calibrated": 0.6}, [0.8, 0.9]]})
    got = column(spark, scoring.calibrated(c("x"), points), [(x,) for x in (0.0, 0.2, 0.35, 0.5, 0.65, 0.9, 1.5)], "x double")
    assert got == pytest.approx([0.1, 0.1, 0.25, 0.4, 0.75, 0.9, 0.9])
    assert column(spark, scoring.calibrated(c("x"), ()), [(1.5,)], "x double") == [1.0]
    assert column(spark, scoring.bucket(c("x")), [(0.30,), (0.31,), (0.60,), (0.61,)], "x double") == ["low", "medium", "medium", "high"]
    model = scoring.severity_model(
        '{"weights": {"tier_obj": 0.5}, "thresholds": {"low_max": 0.2, "none_max": 0.1}, "calibration": [[0, 0], [1, 0.5]]}'
    )
    assert (
        model.weights["tier"], model.low_max, model.medium_max, model.none_max, model.calibration
    ) == (0.5, 0.2, 0.60, 0.1, ((0.0, 0.0), (1.0, 0.5)))


def test_detections(spark):
    rows = [
        ([0.0, 0.0, 100.0, 100.0], 0.9, "object", False), ([0.0, 0.0, 1.0, 1.0], 0.1, "object", False),
        ([0.0, 0.0, 5.0, 5.0], 0.9, "people", True), ([0.0, 0.0, 97.0, 90.0], 0.9, "people", True),
        ([0.0, 0.0, 97.0, 96.0], 0.9, "building", False), ([0.0, 0.0, 100.0, 100.0], 0.9, "background", False)
    ]
    df = spark.createDataFrame(rows, "box array<double>, score double, cat string, multi boolean").select(
        geometry.evaluated(c("box"), c("score"), c("cat"), c("multi"), F.lit(1000), F.lit(1000)).alias("small"),
        geometry.evaluated(c("box"), c("score"), c("cat"), c("multi"), F.lit(100), F.lit(100)).alias("e")
    )
    got = df.collect()
    assert [r["e"]["rejection_reasons"] for r in got] == [
        ["scene_level_box", "full_frame_box"], ["low_score", "tiny_box"], ["too_small_for_group"],
        ["scene_level_box"], ["scene_level_box"], []
    ]
    assert got[0]["e"]["precision_score"] == pytest.approx(0.9 - 0.45 - 0.40 - 0.10) and got[1]["small"]["rejection_reasons"] == ["low_score", "tiny_box"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 15), st.integers(1, 15), st.integers(0, 5)), max_size=25))
def test_nms_property(items):
    boxes, scores = [[x, y, x + w, y + h] for x, y, w, h, _ in items], [s for *_, s in items]
    kept = geometry.greedy_nms(boxes, scores, 0.3)

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    assert all(iou(boxes[i], boxes[j]) <= 0.3 for i in kept for j in kept if i < j)
    assert all(any(iou(boxes[i], boxes[k]) > 0.3 and scores[k] >= scores[i] for k in kept) for i in range(len(items)) if i not in kept)


def test_routes(spark):
    meta = {
        "face_edit": False, "person_like": False, "whole_person": False, "body_attached": False,
        "identity_sensitive": False, "safe_remove": False, "role_swap": False, "hidden_structure": False
    }
    cases = [  # operation, flags, area, aspect, compactness, borders, empty, reason
        ("remove", [], 0.1, 1, 1, 0, True, "empty_mask"),
        ("attribute_change", [], 0.1, 1, 1, 0, False, "requested_attribute_change"),
        ("insert", [], 0.1, 1, 1, 0, False, "requested_insert"),
        ("fill", [], 0.1, 1, 1, 0, False, "requested_fill"),
        ("remove", ["hidden_structure", "person_like"], 0.1, 1, 1, 0, False, "remove_reveals_hidden_structure_rerouted"),
        ("remove", ["hidden_structure"], 0.3, 1, 1, 0, False, "scene_remove_despite_hidden_structure"),
        ("remove", ["hidden_structure"], 0.31, 1, 1, 0, False, "remove_reveals_hidden_structure"),
        ("remove", ["body_attached"], 0.08, 1, 1, 0, False, "body_attached_remove_unstable_rerouted"),
        ("remove", [], 0.1, 1, 0.09, 0, False, "remove_irregular_mask"),
        ("remove", ["person_like"], 0.27, 1, 1, 0, False, "person_remove_too_large_rerouted"),
        ("remove", ["person_like"], 0.2, 1, 1, 0, False, "safe_person_remove"),
        ("remove", [], 0.31, 1, 1, 0, False, "remove_too_large"),
        ("Remove", [], 0.3, 1, 1, 0, False, "safe_remove"),
        ("replace", ["role_swap", "person_like"], 0.1, 1, 1, 0, False, "role_swap_rerouted_to_local_attribute_change"),
        ("replace", ["whole_person"], 0.1, 1, 1, 0, False, "whole_person_replace_disallowed"),
        ("replace", [], 0.1, 4.6, 1, 0, False, "replace_strip_like_region"),
        ("replace", [], 0.1, 1, 0.09, 0, False, "replace_irregular_mask"),
        ("replace", ["identity_sensitive"], 0.1, 1, 1, 0, False, "identity_sensitive_replace_rerouted"),
        ("replace", ["person_like"], 0.15, 1, 1, 0, False, "person_like_replace_too_large_rerouted"),
        ("replace", ["body_attached"], 0.14, 1, 1, 0, False, "safe_person_local_replace"),
        ("replace", [], 0.46, 1, 1, 3, False, "replace_border_touching_extreme"),
        ("replace", [], 0.41, 1, 1, 2, False, "replace_too_large"),
        ("replace", [], 0.4, 1, 1, 2, False, "replace_border_touching_allowed"),
        ("replace", [], 0.29, 1, 1, 1, False, "safe_large_scene_replace"),
        ("replace", [], 0.28, 1, 1, 1, False, "safe_replace"),
        ("tint", [], 0.1, 1, 1, 0, False, "unknown_operation_tint"),
    ]
    rows = [(op, {**meta, **{f: True for f in flags}}, float(a), float(s), float(k), b, e) for op, flags, a, s, k, b, e, _ in cases]
    df = spark.createDataFrame(
        rows,
        "op string, meta struct<" + ",".join(f"{k}:boolean" for k in meta) + ">, a double, s double, k double, b int, e boolean"
    )
    assert [
        r[0] for r in df.select(routing.route(c("op"), c("meta"), c("a"), c("s"), c("k"), c("b"), c("e"))["reason"]).collect()
    ] == [x[-1] for x in cases]
    got = spark.createDataFrame(
        [("Woman's face", "police badge", "", "")], "a string, b string, c string, d string"
    ).select(routing.anchor_meta(*[c(x) for x in "abcd"]).alias("m")).first()["m"]
    assert got["face_edit"] and got["person_like"] and got["whole_person"] and got["role_swap"] and got["identity_sensitive"] and got["hidden_structure"]
    tries = spark.range(1).select(routing.attempts(F.lit("replace"), F.lit("low"), F.lit(False), F.lit(0.05), F.lit(True)).alias("t")).first()["t"]
    assert len(tries) == 3 and tries[0]["strength"] == pytest.approx(0.46 * 0.85) and tries[2]["steps"] == 50


RAW = "anchors array<struct<" + anchors.ANCHOR.replace(" array", ":array").replace(" struct", ":struct").replace(" string", ":string") + ">>"


def raw(i, span, visibility="full", confidence="high", relations=()):
    return {
        "anchor_id": i, "span": span, "semantic_tags_raw": [], "semantic_tags": [], "functional_role": "",
        "localization": {"level": "", "region_hint": "LEFT"}, "attributes": ["x", "X"],
        "relations": [{"type": t, "target_anchor_id": k} for t, k in relations], "visibility": visibility,
        "salience": "?", "confidence": confidence
    }


def test_extracted_anchors(spark):
    rows = [
        (
            [
                raw("a1", "object"),
                raw("a2", "red car", relations=[("Next to", "a3"), ("next_to", "a3"), ("likes", "a3"), ("on", "zz")]),
                raw("a3", "tall tree", "small", "low"), raw("a4", "The red car")
            ],
        )
    ]
    df = spark.createDataFrame(rows, RAW)
    got = df.select(anchors.postprocessed(c("anchors")).alias("x")).first()["x"]
    assert [(a["anchor_id"], a["span"], a["semantic_tags"], a["functional_role"]) for a in got] == [
        ("a1", "red car", ["vehicle"], "vehicle"), ("a2", "tall tree", ["plant"], "background vegetation")
    ]
    assert [
        tuple(r) for r in got[0]["relations"]
    ] == [("next_to", "a2")] and got[0]["localization"]["region_hint"] == "left" and got[0]["salience"] == "medium" and got[0]["attributes"] == ["x"]
    empty, one = F.array().cast("array<string>"), F.array(F.lit("tall tree"))
    assert df.select(
        F.size(anchors.without_weak(c("anchors"), [empty], F.lit(""))),
        F.size(anchors.without_weak(c("anchors"), [one], F.lit("")))
    ).first()[:] == (1, 2)
    assert [
        a["span"] for a in df.select(anchors.with_visible_text(c("anchors"), empty, F.lit("EXIT NOW | red car")).alias("x")).first()["x"]
    ] == ["red car", "tall tree", "EXIT NOW"]
    more = spark.createDataFrame([(rows[0][0], [raw("m", "big dog"), raw("n", "a red car")])], RAW + ", missed " + RAW.removeprefix("anchors "))
    assert [
        a["span"] for a in more.select(anchors.with_missed(c("anchors"), c("missed")).alias("x")).first()["x"]
    ] == ["red car", "tall tree", "big dog"]
    lists = [F.array(*[F.lit(f"{k} thing {i}") for i in range(9)]) for k in ("red", "blue", "wide", "said")]
    assert [
        a["span"][:4].strip() for a in df.select(anchors.from_caption(*lists, F.lit("one more | last one")).alias("x")).first()["x"]
    ] == ["red"] * 9 + ["wide"] + ["said"] * 2 + ["one", "last"]
    assert df.select(anchors.payload_errors(c("anchors"), 5)).first()[0] == ["too_few_anchors"]


def test_selected_detections(spark):
    a = spark.createDataFrame(
        [("s", "a1", "red car", "vehicle", False, 100, 100), ("s", "a2", "dog", "object", False, 100, 100)],
        "sample_id string, anchor_id string, phrase string, category string, multi boolean, width int, height int"
    )
    d = spark.createDataFrame(
        [
            ("s", "red car", [0.0, 0.0, 30.0, 30.0], 0.5), ("s", "car", [1.0, 1.0, 30.0, 30.0], 0.6),
            ("s", "car", [60.0, 60.0, 90.0, 90.0], 0.4), ("s", "dog", [0.0, 0.0, 100.0, 100.0], 0.9)
        ],
        "sample_id string, query string, box array<double>, score double"
    )
    got = anchors.selected_detections(a, d).collect()
    assert [(r["anchor_id"], r["query"], r["score"]) for r in got] == [("a1", "car", 0.6)]
    assert {r["anchor_id"] for r in anchors.selected_detections(a, d, keep_bad=True).collect()} == {"a1", "a2"}


def test_scored_candidates_and_jobs(spark):
    cand = "struct<operation:string,edited_anchor:string,edit_instruction:string,semantic_shift:double,role_shift:double,contradiction_potential:double,public_impact:double,realism:double,localizability:double>"
    make = lambda sev, pos, anchor, s: (
        "s", "a", sev, pos, ("replace", anchor, f"[FILL] {anchor}", s, s, s, s, 0.5, 0.5), 0.5, 0.5, 0.5, 0.5,
        0.5, True, "dominant"
    )
    rows = [
        make("low", 0, "cap", 0.9), make("low", 1, "hat", 0.2), make("medium", 0, "cap", 0.9),
        make("medium", 1, "bag", 0.1), make("other", 0, "x", 0.1)
    ]
    got = anchors.scored_candidates(
        spark.createDataFrame(
            rows,
            f"sample_id string, anchor_id string, severity string, pos int, candidate {cand}, tier_prior double, salience_proxy double, visibility_proxy double, centrality double, editability double, visible boolean, apparent_size string"
        )
    ).collect()
    seen = {(r["severity"], r["candidate"]["edited_anchor"]): (r["candidate_index"], r["tier_ordering_warning"]) for r in got}
    assert seen == {("low", "cap"): (0, False), ("low", "hat"): (1, False), ("medium", "bag"): (0, True)}
    jobs = spark.createDataFrame(
        [
            ("s", "a", "low", i, a, "[FILL] f [VISUAL] v", sc, 0.1, "") for i,
            (a, sc) in enumerate([("cap", 0.1), ("Cap ", 0.9), ("hat", 0.3), ("tie", 0.4), ("bag", 0.5)])
        ],
        "sample_id string, anchor_id string, severity string, pos int, edited_anchor string, edit_instruction string, planned_score_raw double, mask_ratio double, occlusion string"
    )
    assert [
        (r["raw_index"], r["candidate_index"], r["fill_clause"]) for r in anchors.edit_jobs(jobs).orderBy("raw_index").collect()
    ] == [(2, 0, "f"), (3, 1, "f")]


REWRITE = "struct<rewritten_headline:string,text_edit_operation:string,nli_direction:string,rewrite_rationale:string,error:string,raw_rewrite_output:string>"
PLAN = f"sample_id string, anchor_id string, image_path string, headline string, summary string, sensitive boolean, tier_prior double, proxy_tier_prior double, tier_name string, salience_proxy double, visibility_proxy double, blended_salience double, blended_visibility double, has_proxies boolean, candidates map<string,array<struct<operation:string,edited_anchor:string,edit_instruction:string,rationale:string,delta_sem_plan:double,semantic_shift:double,role_shift:double,public_impact:double,contradiction_potential:double,headline_rewrite:map<string,{REWRITE}>>>>"


def test_release_build(spark, tmp_path):
    said = lambda h, raw_=None: (h, None, "contradiction", None, None, raw_)
    cands = {
        "high": [
            (
                "replace", "car", "i", "r", 0.0, 1.0, 1.0, 1.0, 0.0,
                {"joint": said("new words here now"), "text_only": said(None, 'x {"rewritten_headline": "other words stand here"} y')}
            )
        ]
    }
    plans = spark.createDataFrame(
        [("s1", "a1", "p.png", "plan headline here", "", False, None, None, "tier_c", 0.5, 0.5, 1.0, 0.0, True, cands)],
        PLAN
    )
    anchors_ = spark.createDataFrame(
        [("s1", "a1", False, "mask_too_small")],
        "sample_id string, anchor_id string, technical_valid boolean, technical_reject_reason string"
    )
    manifests = spark.createDataFrame(
        [("s1", "p.png", "old words were here", "sum", ("lit",)), ("s2", "q.png", "x", "", ("y",))],
        "sample_id string, image_path string, headline string, summary string, caption struct<image_caption_literal:string>"
    )
    result = "sample_id string, anchor_id string, modality string, severity string, candidate_index int, accepted boolean, error string, realism_score double, masked_changed_ratio double, masked_mean_delta double, requested_operation string, effective_operation string, output_path string, image_path string, rewritten_caption string, nli_direction string, tier string"
    good = ("s1", "a1", "imagetext", "high", 0, True, "", 0.9, 0.5, 5.0, "replace", "replace", "o.png", "p.png", None, None, "")
    results = spark.createDataFrame(
        [
            good, good[:7] + (0.1,) + good[8:],
            ("s1", "a1", "image_only", "high", 0, True, "boom", 0.1, 0.99, 0.1, "replace", None, None, "p.png", None, None, "")
        ],
        result
    )
    looked = relational.lookups(results, plans, anchors_, manifests)
    cfg = release.BuildConfig(require_valid=False)
    held = lambda df: spark.createDataFrame(df.collect(), df.schema)
    edited = held(release.edited_examples(looked, None, cfg))
    rows = edited.collect()
    assert sorted(r["filter_reason"] for r in rows) == ["edit_error;low_realism;changed_ratio_too_high;masked_delta_too_low", "low_realism", "passed"]
    ok = next(r for r in rows if r["filter_reason"] == "passed")
    assert ok["modality"] == "image_text" and ok["headline_edited"] == "new words here now" and ok["severity_components"]["C_nli"] == 1.0 and ok["severity_score"] == pytest.approx(
        0.35 * 0.85 + 0.25 + 0.2 + 0.15 + 0.05
    )
    assert ok["pair_id"].startswith("s1__a1__image_text__replace__high__high__0__") and len(ok["pair_id"].split("__")[-1]) == 10
    strict = release.edited_examples(looked, None, release.BuildConfig(require_valid=True)).collect()
    assert all("anchor_invalid:mask_too_small" in r["filter_reason"] for r in strict)
    texts = held(release.text_examples(plans, anchors_, manifests, cfg))
    assert [(r["headline_edited"], r["filter_reason"]) for r in texts.collect()] == [("other words stand here", "passed")]
    pristine = release.pristine_examples(manifests)
    kept, refused = map(held, release.release(pristine, edited, texts, cfg))
    assert kept.count() == 3 and refused.count() == 2 and {r["split"] for r in kept.collect()} <= {"train", "val", "test"}
    counts = {(r["counter"], r["value"]): r["n"] for r in release.stats(kept, refused).collect()}
    assert counts["modality", "pristine"] == 1 and counts["quarantine_reason", "low_realism"] == 2 and counts["requested_to_final", "high->high"] >= 1
    sinks.write_release(kept, refused, {"n": 3}, {"seed": 1}, str(tmp_path / "out"))
    flat = spark.read.option("header", True).csv(str(tmp_path / "out/flat_rich"))
    assert len(flat.columns) == 45 and flat.count() == 3 and len(spark.read.option("header", True).csv(str(tmp_path / "out/flat")).columns) == 17
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "out/examples")).collect()]
    assert all("severity_label" in x for x in lines)


def test_relational(spark):
    ranks = relational.ranked(spark.range(1000).orderBy(F.rand(1)), ["id"]).collect()
    assert all(r["id"] == r["rank0"] for r in ranks)
    with pytest.raises(ValueError):
        relational.shard(spark.range(3), "id", 2, 2)
    df = spark.createDataFrame([(i, "a" if i < 7 else "b", None if i % 3 else "k") for i in range(20)], "id int, cell string, kind string")
    assert {r["count"] for r in relational.balance(df, ["cell"], "id", 1).groupBy("cell").count().collect()} == {7}
    assert {r["count"] for r in relational.balance(df, ["cell"], "id", 1, "kind").groupBy("cell").count().collect()} == {6}
    assert relational.sample(df, 5, 1, "id").count() == 5
    done = spark.createDataFrame([("s", None)], "a string, b string")
    assert relational.resume(spark.createDataFrame([("s", None), ("s", "x")], "a string, b string"), done, ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="no manifest for"):
        relational.required(df, spark.createDataFrame([(1, "m")], "id int, m string"), ["id"], "manifest").collect()
    scored = spark.createDataFrame([("p", 0.5, 2), ("p", 0.5, 1), ("p", None, 0), ("q", None, 5)], "k string, s double, o int")
    assert {(r["k"], r["o"]) for r in relational.dedupe_best(scored, "k", "s", "o").collect()} == {("p", 1), ("q", 5)}
    items = spark.range(1).select(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("n")) for i, s in enumerate([1, 3, 3, 2])]).alias("x"))
    assert [r["n"] for r in items.select(relational.best_k(c("x"), [("s", True)], 3).alias("y")).first()["y"]] == [1, 2, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('title,description,date,image\n"a, ""b""",sum,2020,x.png\nsecond," multi\nline ",,y.png\n')
    got = scans.articles(spark, scans.newest(spark, str(tmp_path / "in"))).orderBy("row_index").collect()
    assert [
        (r["row_index"], r["title"], r["summary"], r["images"]) for r in got
    ] == [(0, 'a, "b"', "sum", "x.png"), (1, "second", "multi\nline", "y.png")]
    assert scans.articles(spark, str(tmp_path / "in"), 1, 2).count() == 1
    (tmp_path / "m").mkdir()
    for name, body in {
        "1.json": '{"sample_id": "x", "v": 1}', "2.json": '{"sample_id": "x", "v": 2}',
        "index.json": '{"sample_id": "i"}', "3.json": "[1]", "4.json": "{bad", "z.json": '{"sample_id": "z"}'
    }.items():
        (tmp_path / "m" / name).write_text(body)
    rows = {r["sample_id"]: r["v"] for r in scans.manifests(spark, str(tmp_path / "m")).selectExpr("sample_id", "to_json(v) v").collect()}
    assert set(rows) == {"x", "z"} and json.loads(rows["x"])["v"] == 2 and scans.manifests(spark, str(tmp_path / "m"), numeric=True).count() == 1
    (tmp_path / "r.jsonl").write_text('{"k": "a", "n": 1}\n\n[1]\n{bad\n{"k": "a", "n": 2}\n{"k": "", "n": 3}\n')
    lines = scans.typed(scans.jsonl(spark, str(tmp_path / "r.jsonl")), "k string, n int")
    assert lines.count() == 3 and [(r["k"], r["n"]) for r in scans.last_wins(lines, ["k"], ["file", "ord"]).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="MALFORMED"):
        scans.jsonl(spark, str(tmp_path / "r.jsonl"), strict=True).collect()
    (tmp_path / "p.json").write_text('{"meta": {"images_dir": "d"}, "records": [{"id": "1"}, {"id": "1"}, {"id": ""}, {"id": ""}]}')
    recs = scans.records(scans.json_objects(spark, str(tmp_path / "p.json")), "id:string")
    assert scans.first_records(recs, "id", ["file", "pos"]).count() == 3
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert [r["id"] for r in scans.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]


def test_inference_boundary(spark):
    def load():
        def model(rows):
            if any(r["id"] == 3 for r in rows):
                raise RuntimeError("bad row")
            return [{"answer": r["id"] * 2} for r in rows]

        return model

    got = {r["id"]: (r["answer"], r["error"]) for r in inference.with_model(spark.range(6).coalesce(1), load, "answer long", batch=4).collect()}
    assert got[0] == (0, None) and got[2] == (4, None) and got[3] == (None, "RuntimeError: bad row") and got[5] == (10, None)
    stack = spark.range(1).select(
        inference.verifier_stack(
            F.array(
                F.struct(F.lit(True).alias("match"), F.lit(0.5).alias("score"), F.lit("a").alias("reason")),
                F.struct(F.lit(False).alias("match"), F.lit(0.2).alias("score"), F.lit("").alias("reason"))
            )
        ).alias("s")
    ).first()["s"]
    assert tuple(stack) == (False, 0.2, "a")


def test_raster():
    mask = np.zeros((10, 20), np.uint8)
    mask[2:5, 0:10] = 255
    s = raster.mask_stats(mask)
    assert s["bbox"] == [0, 2, 9, 4] and s["touches_border"] == 1 and s["compactness"] == 1.0 and s["area_ratio"] == 0.15 and raster.mask_stats(mask * 0)["is_empty"]
    assert raster.eroded(mask, 1).sum() == 255 * 8 and (raster.eroded(mask, 9) == mask).all()
    assert raster.box_mask([2, 2, 3, 3], 10, 10, 1).sum() == 255 * 16
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 255, (120, 120, 3)).astype(np.uint8)
    assert "blurred_or_smeared" in raster.visual_check(
        np.full((120, 120, 3), 7, np.uint8), False
    )["reasons"] and "blurred_or_smeared" not in raster.visual_check(noise, False)["reasons"]
    assert raster.visual_check(None, True)["confidence"] == 1.0
    assert raster.change_stats(noise[:10, :20], noise[:10, :20], mask) == (0.0, 0.0) and raster.crop(noise, [5, 5, 5, 9]) is None


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(i, "one two three") for i in range(10)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = streams.start(
        streams.gated(streams.read(spark, str(tmp_path / "in"), "doc_id long, text string")),
        str(tmp_path / "out"), str(tmp_path / "ck")
    )
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10 and {r["reason"] for r in out.collect()} == {"ok"}


def test_no_cartesian_product(spark):
    from sievework.plans import catalogue

    for name in ("release_lookup", "balance_cells", "relation_edges", "resume_anti"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
