"""Boxes (x1, y1, x2, y2) as arrays of doubles."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.coerce import let

PEOPLE, LARGE, SCENE = ["person", "people"], ["building", "structure"], ["environment", "background"]
SENSITIVE = ["person", "people", "vehicle", "sign", "text", "symbol", "object", "water", "vegetation"]
# Limits by precision mode; any other mode is high.
PRECISION = {
    "high": {"sensitive": 0.65, "people_group": 0.85, "large": 0.92, "tiny": 0.0007, "tiny_large": 0.0020, "side": 0.93, "score": 0.25},
    "balanced": {"sensitive": 0.78, "people_group": 0.90, "large": 0.94, "tiny": 0.0005, "tiny_large": 0.0015, "side": 0.95, "score": 0.22},
    "recall": {"sensitive": 0.90, "people_group": 0.95, "large": 0.98, "tiny": 0.0003, "tiny_large": 0.0008, "side": 0.98, "score": 0.18},
}


def corner(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i)).cast("double")


def iou(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(zero, F.least(corner(a, hi), corner(b, hi)) - F.greatest(corner(a, lo), corner(b, lo)))
    area = lambda x: F.greatest(zero, corner(x, 2) - corner(x, 0)) * F.greatest(zero, corner(x, 3) - corner(x, 1))
    inter = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - inter
    return F.when(union <= 0, 0.0).otherwise(inter / union)


def clipped(box: Column, width: Column, height: Column) -> Column:
    """Inside the image, corners in order."""
    inside = lambda i, most: F.greatest(F.lit(0.0), F.least(corner(box, i), most - F.lit(1.0)))
    x, y = (inside(0, width), inside(2, width)), (inside(1, height), inside(3, height))
    return F.array(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))


def from_centre(box: Column, width: Column, height: Column) -> Column:
    """Pixels corners of a relative box given by centre and sides."""
    half = lambda i, k, sign, most: (corner(box, i) + sign * corner(box, k) / 2) * most
    return F.array(half(0, 2, -1, width), half(1, 3, -1, height), half(0, 2, 1, width), half(1, 3, 1, height))


def expanded(box: Column, width: Column, height: Column, pad: float = 0.12) -> Column:
    """A closed pixel box with a margin of a share of its sides, four pixels at least."""
    margin = lambda lo, hi: F.greatest(
        F.lit(4.0),
        F.floor(F.greatest(F.lit(1.0), corner(box, hi) - corner(box, lo) + 1) * pad).cast("double")
    )
    px, py = margin(0, 2), margin(1, 3)
    zero = F.lit(0.0)
    return F.array(
        F.greatest(zero, corner(box, 0) - px), F.greatest(zero, corner(box, 1) - py),
        F.least(width - F.lit(1.0), corner(box, 2) + px), F.least(height - F.lit(1.0), corner(box, 3) + py)
    )


def evaluated(box: Column, score: Column, category: Column, multi: Column, width: Column, height: Column, mode: str = "high") -> Column:
    """Struct area_ratio, width_ratio, height_ratio, precision_score and rejection_reasons of a detection."""
    cfg, one = PRECISION.get(mode, PRECISION["high"]), F.lit(1.0)
    w, h = F.greatest(one, corner(box, 2) - corner(box, 0)), F.greatest(one, corner(box, 3) - corner(box, 1))
    area, wide, high = (w * h) / F.greatest(
        one, (width * height).cast("double")
    ), w / F.greatest(one, width.cast("double")), h / F.greatest(one, height.cast("double"))
    people, scene, group = category.isin(PEOPLE), category.isin(SCENE), category.isin(PEOPLE) & multi
    scene_box = (area >= cfg["sensitive"]) | ((wide >= cfg["side"]) & (high >= cfg["side"]))
    tiny = F.when(category.isin(LARGE), cfg["tiny_large"]).otherwise(cfg["tiny"])
    rules = [
        ("low_score", score < cfg["score"], 0.20),
        ("scene_level_box", category.isin(SENSITIVE) & (area >= cfg["sensitive"]) & ~group, 0.45),
        ("scene_level_box", group & (area >= cfg["people_group"]), 0.35),
        ("scene_level_box", category.isin(LARGE) & (area >= cfg["large"]) & ~multi, 0.25),
        ("tiny_box", ~scene & (area <= tiny), 0.18),
        ("too_small_for_group", multi & people & (area < cfg["tiny"] * 8), 0.20),
        ("full_frame_box", ~scene & (wide >= 0.98) & (high >= 0.98), 0.40),
        (None, ~scene & scene_box, 0.10),
    ]
    adjusted = score
    for _, hit, penalty in rules:
        adjusted = F.when(hit, adjusted - penalty).otherwise(adjusted)
    reasons = F.array_compact(F.array(*[F.when(hit, name) for name, hit, _ in rules if name]))
    six = lambda c: F.bround(c, 6)
    return F.struct(
        six(area).alias("area_ratio"), six(wide).alias("width_ratio"), six(high).alias("height_ratio"),
        six(adjusted).alias("precision_score"), reasons.alias("rejection_reasons")
    )


def greedy_nms(boxes, scores, limit: float) -> list[int]:
    """Places of the boxes kept: by falling score (ties: the first), dropping what overlaps a kept box by more than limit."""
    import numpy as np

    boxes, scores = np.asarray(boxes, float).reshape(-1, 4), np.asarray(scores, float)
    order, kept = np.lexsort((np.arange(len(scores)), -scores)), []
    area = np.clip(boxes[:, 2] - boxes[:, 0], 0, None) * np.clip(boxes[:, 3] - boxes[:, 1], 0, None)
    while len(order):
        i, rest = order[0], order[1:]
        kept.append(int(i))
        w = np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0])
        h = np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        union = area[i] + area[rest] - inter
        order = rest[np.where(union > 0, inter / np.where(union > 0, union, 1), 0) <= limit]
    return kept


def nms(
    df: DataFrame, keys: list[str], box: str = "box", score: str = "score", limit: float = 0.7, order: list[str] | None = None
) -> DataFrame:
    """The rows of df that greedy suppression keeps within each group of keys (detections of one image and query), as
    greedy_nms() does. Of equal scores the first by order goes first; without order, by the columns that can be ordered.

    A group is one row that expressions work on, so that small groups cost no call of their own to Python."""
    sortable = [f.name for f in df.schema.fields if not {"map", "variant"} & set(re.findall("[a-z]+", f.dataType.simpleString()))]
    place = F.struct(F.coalesce(-F.col(score).cast("double"), F.lit(float("nan"))).alias("s"), *[F.col(n).alias(f"t{i}") for i, n in enumerate(order or sortable)])
    row = F.struct(place.alias("place"), *[corner(F.col(box), i).alias(f"c{i}") for i in range(4)], F.struct(*df.columns).alias("row"))
    groups = df.select(*keys, row.alias("r")).groupBy(*keys).agg(F.collect_list("r").alias("rs"))
    size = lambda b: F.greatest(F.lit(0.0), b["c2"] - b["c0"]) * F.greatest(F.lit(0.0), b["c3"] - b["c1"])
    side = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))

    def covers(a: Column, x: Column) -> Column:
        share = lambda i: F.when(i > 0, F.nanvl(i / (a["area"] + x["area"] - i), F.lit(0.0))).otherwise(0.0)
        return let(side(a, x, "c0", "c2") * side(a, x, "c1", "c3"), share) > limit

    sized = F.transform("rs", lambda r: F.struct(r["place"].alias("place"), size(r).alias("area"), *[r[n].alias(n) for n in ("c0", "c1", "c2", "c3")]))
    numbered = F.array_sort(F.transform(sized, lambda r, i: r.withField("i", i)))
    kept = let(
        numbered,
        lambda all_: F.aggregate(
            all_, F.slice(all_, 1, 0),
            lambda acc, x: F.when(F.exists(acc, lambda a: covers(a, x)), acc).otherwise(F.concat(acc, F.array(x)))
        )
    )
    return groups.select(F.explode(F.transform(kept, lambda k: F.get("rs", k["i"])["row"])).alias("k")).select("k.*")


def softmax_match(logits: Column, positive: int, least: float = 0.30, margin: float = 0.08) -> Column:
    """Struct score, best_other and match of one label's share among logits."""
    exps = lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp((v - top).cast("double"))))
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))
    found = lambda s: F.struct(
        F.get(s, F.lit(positive)).alias("score"),
        F.coalesce(F.array_max(F.filter(s, lambda v, i: i != positive)), F.lit(0.0)).alias("best_other")
    )
    judged = lambda m: F.struct(
        m["score"].alias("score"), m["best_other"].alias("best_other"),
        ((m["score"] >= least) & (m["score"] - m["best_other"] >= margin)).alias("match")
    )
    return let(let(let(let(logits, exps), shares), found), judged)


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most size rows."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
