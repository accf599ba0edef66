"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each text gives a vector of statistics (sizes, shares of character classes, word and line shapes), put on
log scales. Every labelled row of the training folds adds to the moments of its class (count, sums, sums
of products), summed over partitions; no row is sampled. Each class covariance is shrunk towards the pooled
one and towards its diagonal; its Cholesky factor is computed once and cached in the model. The score is the
logistic of the difference of the two classes' log densities (Mahalanobis terms and log determinants); the
logistic is fitted on a histogram of differences of fixed size, so that scores are probabilities.

Labels join on the key: rows with null labels or keys don't train, a document with several label rows
trains once for each. Null texts are empty; empty and very long texts get a score like any other. Repeated
rows stay. Of the documents only key and text are read, so other columns' names don't matter. Without rows of
both classes the model can't be fitted, and fitting raises ValueError; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import in_arrow, maybe_among, slices, staged

NAMES = (
    "chars", "words", "word_chars", "symbols", "upper", "digits", "bangs", "stops", "bars", "other", "caps_words",
    "distinct_words", "lines", "repeated_lines", "worst_symbols", "worst_upper", "worst_bars", "long_words", "common_share", "stutter",
)
SHRINK, DIAGONAL, RIDGE = 0.1, 0.05, 1e-3
#: Log density differences are kept to this range, in so many bins, where the logistic is fitted.
CLIP, BINS = 60.0, 480
THRESHOLD = 0.3
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>@^~_=+{}[]\\/", bytes(range(65, 91)), b"0123456789"


def _less(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of one text."""
    data = (text or "").encode("utf-8", "replace")
    size, words = len(data) + 1.0, data.split()
    n = len(words) + 1.0
    lines = [x for x in data.split(b"\n") if len(x) > 1]
    share = lambda k, of, least=0.002: float(np.log(k / of + least))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    worst = [0.0, 0.0, 0.0]
    for x in lines:
        s = len(x) + 20.0
        worst = [max(worst[0], _less(x, _SYMBOLS) / s), max(worst[1], _less(x, _UPPER) / s), max(worst[2], x.count(b"|") / s)]
    upper = _less(data, _UPPER)
    return [
        float(np.log(size)),
        float(np.log(n)),
        float(np.log((size - n) / n + 1)),
        share(_less(data, _SYMBOLS), size),
        share(upper, size),
        share(_less(data, _DIGITS), size),
        share(data.count(b"!"), size),
        share(_less(data, b".,;:?"), size),
        share(data.count(b"|"), size),
        share(_less(data, bytes(range(32)) + b"\x7f"), size),
        share(sum(map(bytes.isupper, words)), n),
        float(np.log((len(seen) + 1) / n)),
        share(len(lines), n),
        share(len(lines) - len(set(lines)), len(lines) + 1.0, 0.05),
        *(float(np.log(w + 0.02)) for w in worst),
        share(sum(len(w) > 24 for w in words), n),
        share(max(seen.values(), default=0), n, 0.01),
        share(sum(map(bytes.__eq__, words, words[1:])), n, 0.01),
    ]


def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by class."""
    return np.array([(y == k).sum() for k in (0, 1)], float), np.array([x[y == k].sum(0) for k in (0, 1)]), np.array(
        [x[y == k].T @ x[y == k] for k in (0, 1)]
    )


class TooFewLabels(ValueError):
    """A class lacks the labelled rows that its density needs."""


@dataclass
class Gaussians:
    """The two classes' densities from their moments."""

    counts: np.ndarray
    sums: np.ndarray
    products: np.ndarray
    shrink: float = SHRINK
    diagonal: float = DIAGONAL
    slope: float = 1.0
    offset: float = 0.0
    means: np.ndarray = field(init=False)
    factors: list = field(init=False)
    log_dets: list = field(init=False)

    def __post_init__(self) -> None:
        if (self.counts < 2).any():
            raise TooFewLabels(f"both classes need two labelled rows at least; there are {self.counts.astype(int).tolist()}")
        self.means = self.sums / self.counts[:, None]
        own = [p / n - np.outer(m, m) for p, n, m in zip(self.products, self.counts, self.means, strict=True)]
        pooled = sum(c * n for c, n in zip(own, self.counts, strict=True)) / self.counts.sum()
        self.factors, self.log_dets = [], []
        for c in own:
            c = (1 - self.shrink) * c + self.shrink * pooled
            c = (1 - self.diagonal) * c + (self.diagonal + RIDGE) * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(low))
            self.log_dets.append(2 * np.log(np.diag(low)).sum())

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, of each row."""
        log = [-0.5 * ((((x - m) @ f.T) ** 2).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return np.nan_to_num(log[1] - log[0] + np.log(self.counts[1] / self.counts[0]), nan=0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -CLIP, CLIP) + self.offset, -500, 500)))


def histogram(difference: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of class 0 and 1 in each bin of differences."""
    at = np.clip(((difference + CLIP) / (2 * CLIP) * BINS).astype(int), 0, BINS - 1)
    return np.bincount(at[y == 0], minlength=BINS).astype(float), np.bincount(at[y == 1], minlength=BINS).astype(float)


def calibrate(zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that fits the bins, by Newton steps with a weak prior."""
    d = (np.arange(BINS) + 0.5) / BINS * 2 * CLIP - CLIP
    at, w, hit = np.array([0.3, 0.0]), zeros + ones, ones
    feats = np.stack([d, np.ones(BINS)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(feats @ at, -50, 50)))
        grad = feats.T @ (hit - w * p) - np.array([0.1, 0.1]) * (at - np.array([0.3, 0.0]))
        hess = (feats * (w * p * (1 - p))[:, None]).T @ feats + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at = at + step / max(1.0, np.abs(step).max() / 0.5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def held_out(key: Column) -> Column:
    """Whether a key is in the fold that never trains."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the vector of statistics of each row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            rows = pa.array([np.array(statistics_of(t)) for t in part.column(text).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(key), rows], [key, "vector"])

    kept = docs.select(f"`{key}`", f"`{text}`")
    return in_arrow(kept, run, f"`{key}` {kept.schema[key].dataType.simpleString()}, vector array<double>")


def _summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over partitions of an array of fixed size that of() makes of vectors and labels."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for p in parts:
            if len(p):
                got = of(np.stack(p["vector"].to_numpy()), p["y"].to_numpy())
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    # few values a partition; sums of each place are made on executors
    got = rows.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + max((r["i"] for r in got), default=-1))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def fit(vectors: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Gaussians:
    """The model of all labelled rows outside the held-out fold."""
    known = labels.select(
        F.col(f"`{key}`").alias("_k"), F.col(f"`{label}`").cast("int").alias("y")
    ).where(F.col("y").isin(0, 1) & ~held_out(F.col("_k")))
    rows = staged(vectors.join(known, F.col(f"`{key}`") == F.col("_k")).select("vector", "y"), "labelled")
    width = len(NAMES)
    flat = _summed(rows, lambda x, y: np.concatenate([m.ravel() for m in moments(x, y)]))
    if not len(flat):
        raise TooFewLabels("no labelled rows")
    model = Gaussians(flat[:2], flat[2 : 2 + 2 * width].reshape(2, width), flat[2 + 2 * width :].reshape(2, width, width))
    bins = _summed(rows, lambda x, y: np.concatenate(histogram(model.difference(x), y)))
    model.slope, model.offset = calibrate(bins[:BINS], bins[BINS:])
    return model


def score(vectors: DataFrame, model: Gaussians, key: str = "doc_id") -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(model.score(x), pa.float64())], [key, "score"])

    return in_arrow(vectors, run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted (1 from THRESHOLD on) of each row of docs."""
    vectors = staged(features(docs, key, text), "statistics")
    if docs.isEmpty():
        return vectors.select(f"`{key}`", F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = score(vectors, fit(vectors, labels, key, label), key)
    return scored.select(
        f"`{key}`", held_out(F.col(f"`{key}`")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: Gaussians, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches least; no shuffle."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.filter(pa.array(model.score(np.array([statistics_of(t) for t in part.column(text).to_pylist()])) >= least))

    return in_arrow(docs, run, docs.schema)


def accepted(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    least: float = THRESHOLD
) -> DataFrame:
    """The rows of docs that the model of their labels accepts. Statistics are worked out once for all rows, and once more
    for labelled ones, which the model needs first. With too few labels for a model, all rows stay."""
    learnt = labels.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{label}`").alias("quality"))
    few = maybe_among(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id", learnt, "doc_id").where("maybe")
    try:
        model = fit(staged(features(few, "doc_id", "text"), "statistics"), learnt, "doc_id", "quality")
    except TooFewLabels:
        return docs
    return keep(docs, model, text, least)
