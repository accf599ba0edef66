"""Jobs from files to files: each is run, stopped by what is there, resumed and overwritten."""

import json

import pytest

from sievework.plans import jobs


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def read(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(str(path)).collect()]


def answer(**more):
    anchor = {
        "anchor_id": "a1", "span": "red car", "semantic_tags": ["vehicle"], "functional_role": "vehicle",
        "localization": {"level": "object", "region_hint": "left"}, "attributes": [], "relations": []
    }
    caption = {"image_caption_literal": "a car", "visible_text": "EXIT", "people_count": 0, "notable_objects": ["red car"]}
    return {
        "caption": json.dumps(caption),
        "context": "```json\n" + json.dumps({"article_context_rewrite": "x"}) + "\n```",
        "anchors": json.dumps({"grounded_context_caption": "c", "anchors": [anchor]}),
        "missed": json.dumps({"missed_anchors": []}), **more
    }


def test_extract(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for name in ("x.png", "y.png", "z.png"):
        (tmp_path / "images" / name).write_bytes(b"png")
    (tmp_path / "a.csv").write_text("title,description,image\nfirst,s,x.png\nsecond,s,y.png\nthird,s,gone.png\nfourth,s,z.png\n")
    told = lines(
        tmp_path / "told.jsonl",
        [
            {"images": "x.png", **answer()}, {"images": "y.png", **answer(context='{"other": 1}')},
            {"images": "z.png", **answer(anchors='{"grounded_context_caption": "c", "anchors": []}')}
        ]
    )
    arguments = ["--csv", str(tmp_path / "a.csv"), "--images-dir", str(tmp_path / "images"), "--answers", told, "--output", str(tmp_path / "records")]
    report = jobs.settings(jobs.Extract, [*arguments, "--end-row", "2"]).run(spark).first().asDict()
    assert report == {"total": 2, "ok": 1, "missing_image": 0, "failed": 1}
    with pytest.raises(FileExistsError):
        jobs.settings(jobs.Extract, arguments).run(spark)
    report = jobs.settings(jobs.Extract, [*arguments, "--resume"]).run(spark).first().asDict()
    assert report == {"total": 4, "ok": 2, "missing_image": 1, "failed": 1}
    got = {r["id"]: r for r in read(spark, tmp_path / "records")}
    assert got["000002"]["errors"] == [
        "context_failed:context_missing_article_context_rewrite"
    ] and got["000003"]["errors"] == ["missing_image:gone.png"]
    # no anchors were told: they come of the caption
    assert [
        a["span"] for a in got["000004"]["outputs"]["anchors"]["anchors"]
    ] == ["EXIT"] or [a["span"] for a in got["000004"]["outputs"]["anchors"]["anchors"]] == ["red car", "EXIT"]
    assert [a["span"] for a in got["000001"]["outputs"]["anchors"]["anchors"]] == ["red car", "EXIT"] and len(got["000001"]["created_at"]) == 19
    boxes = lines(
        tmp_path / "boxes.jsonl",
        [
            {"sample_id": "000001", "query": "red car", "box": [0, 0, 30, 30], "score": 0.9},
            {"sample_id": "000001", "query": "exit", "box": [50, 50, 60, 60], "score": 0.1}
        ]
    )
    sizes = lines(tmp_path / "sizes.jsonl", [{"sample_id": f"00000{i}", "width": 100, "height": 100} for i in range(1, 5)])
    report = jobs.Ground(str(tmp_path / "records"), boxes, sizes, str(tmp_path / "grounded"), keep_bad=True).run(spark).first().asDict()
    assert report["anchors"] >= 3 and report["ok"] == 2 and report["fallback"] == 1
    one = next(r for r in read(spark, tmp_path / "grounded") if r["id"] == "000001")
    assert {a["phrase"]: (a["status"], a["fallback_used"]) for a in one["anchors"]} == {"red car": ("ok", False), "EXIT": ("ok", True)}


def manifest(sample, *words):
    box = {"score": 0.9, "precision_score": 0.8, "box_xyxy": [1, 2, 3, 4]}
    anchor = lambda i, w: {
        "anchor_id": f"a{i}", "anchor_text": w, "category": "vehicle", "status": "ok",
        "grounding_status": "ok", "union_mask_path": f"m{i}.png",
        "union_mask_stats": {"width": 10, "height": 10, "foreground_area_px": 8}, "best_detection": box,
        "detections": [{"score": 0.9}]
    }
    return {
        "sample_id": sample, "image_path": f"{sample}.png",
        "headline": f"A {words[0]} stands in the road today", "summary": "s",
        "caption": {"image_caption_literal": "l"}, "anchors": [anchor(i, w) for i, w in enumerate(words)],
        "relations": []
    }


def test_flatten_plan_edit_release(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for s, words in {"s1": ["red car", "red car", "blue bus"], "s2": ["old van"], "s3": ["area"]}.items():
        (tmp_path / "m" / f"{s}.json").write_text(json.dumps(manifest(s, *words)))
    flat, plans, results = (str(tmp_path / n) for n in ("flat", "plans", "results"))
    report = jobs.Flatten(str(tmp_path / "m"), flat).run(spark).first().asDict()
    assert report == {"total": 5, "kept": 4, "duplicates": 0}
    rows = read(spark, flat)
    assert {r["anchor_id"]: r["technical_valid"] for r in rows if r["sample_id"] == "s3"} == {"a0": False} and len(rows[0]) == 31
    cand = lambda w, s: {
        "operation": "replace", "edited_anchor": w, "edit_instruction": f"[FILL] {w}; [VISUAL] plain",
        "rationale": "r",
        **dict.fromkeys(("semantic_shift", "role_shift", "contradiction_potential", "public_impact", "realism", "localizability"), s)
    }
    said = lambda *ws: json.dumps(
        {
            "visual_grounding": {"visible": True, "apparent_size": "moderate", "occlusion_notes": ""},
            "anchor_interpretation": {"anchor_centrality": 0.8, "local_editability": 0.9},
            "severity_candidates": {"low": [cand(w, 0.6) for w in ws], "high": [cand("gay couple", 0.9)]}
        }
    )
    told = lines(
        tmp_path / "told.jsonl",
        [
            {"sample_id": "s1", "anchor_id": "a0", "raw": "<think>x</think>" + said("green car", "van")},
            {"sample_id": "s2", "anchor_id": "a0", "raw": said("tram")[:-30]},
            {"sample_id": "s1", "anchor_id": "a1", "raw": "no"}
        ]
    )
    plan = jobs.Plan(flat, str(tmp_path / "m"), told, plans)
    report = plan.run(spark).first().asDict()
    assert report["total"] == 4 and report["ok"] + report["error"] + report["skipped_low_salience"] == 4 and report["ok"] >= 1
    with pytest.raises(FileExistsError):
        plan.run(spark)
    assert jobs.Plan(flat, str(tmp_path / "m"), told, plans, resume=True).run(spark).first()["total"] == 4
    assert jobs.Plan(flat, str(tmp_path / "m"), told, str(tmp_path / "few"), max_samples=1, max_anchors=1).run(spark).first()["total"] == 1
    got = {(r["sample_id"], r["anchor_id"]): r for r in read(spark, plans)}
    held = got["s1", "a0"]["planner_output"]["severity_candidates"]
    assert [
        x["edited_anchor"] for x in held["low"]
    ] == ["green car", "van"] and held["medium"][0]["derived"]["is_fallback"] and held["low"][0]["derived"]["planned_score_raw"] > 0.2
    masks = lines(
        tmp_path / "masks.jsonl",
        [
            {
                "sample_id": s, "anchor_id": a, "area_ratio": 0.05, "bbox_aspect_ratio": 1.0,
                "compactness": 0.8, "touches_border": 0, "is_empty": False
            } for s,
            a in got
        ]
    )
    done = lines(
        tmp_path / "done.jsonl",
        [
            {
                "sample_id": "s1", "anchor_id": "a0", "severity": v, "candidate_index": 0,
                "realism_score": 0.9, "masked_mean_delta": 20.0, "masked_changed_ratio": 0.4,
                "duration_s": 1.23456
            } for v in ("low", "medium", "high")
        ]
    )
    report = jobs.Edit(plans, flat, masks, done, results, images_root="out/").run(spark).first().asDict()
    assert report["accepted"] >= 2 and report["low"] >= 2
    assert jobs.Edit(plans, flat, masks, done, results, images_root="out/", resume=True).run(spark).first()["total"] == report["total"]
    rows = read(spark, results)
    ok = next(r for r in rows if r["accepted"] and r["severity"] == "low")
    assert len(ok) == 29 and ok["output_path"] == "out/s1/a0_req-replace_eff-replace_low_0.png" and ok["duration_s"] == 1.235 and ok["modality"] == "image_only" and ok["route_reason"] == "safe_replace"
    assert all("rejects/" in r["output_path"] for r in rows if not r["accepted"] and r["effective_operation"] != "skip")
    report = jobs.settings(
        jobs.Release,
        [
            "--manifests", str(tmp_path / "m"), "--output", str(tmp_path / "release"), "--results", results,
            "--plans", plans, "--anchors", flat, "--synthesize", "--no-exclude-sensitive"
        ]
    ).run(spark).first().asDict()
    examples = read(spark, tmp_path / "release/examples")
    assert report["pristine"] == 3 and report["examples"] == len(examples) > 4 and {r["split"] for r in examples} <= {"train", "val", "test"}
    made = [r for r in examples if r["modality"] == "text_only"]
    assert made and all(
        r["provenance"]["rewrite_source"] == "synthetic" for r in made
    ) and "A red car stands in the road today featuring green car" in {r["headline_edited"] for r in made}
    counts = json.loads(read(spark, tmp_path / "release/stats")[0] if False else spark.read.text(str(tmp_path / "release/stats")).first()["value"])
    assert counts["modality"]["pristine"] == 3
    assert "synthesize: True" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "release/card")).collect())


def test_settings():
    job = jobs.settings(
        jobs.Plan,
        ["--editable", "e", "--manifests", "m", "--answers", "a", "--output", "o", "--num-shards", "4", "--shard-id", "3", "--include-invalid"]
    )
    assert (job.num_shards, job.shard_id, job.include_invalid, job.max_samples) == (4, 3, True, None)
    with pytest.raises(SystemExit):
        jobs.settings(jobs.Plan, [])
