"""The boundary to models: recorded outputs are joined, or a plug-in runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_recorded(jobs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs with what a model has answered, null where nothing is recorded."""
    return jobs.join(outputs.dropDuplicates(keys), keys, "left")


def distinct_requests(jobs: DataFrame, request: list[str]) -> DataFrame:
    """Each request once, so that equal ones of an image cost one call."""
    return jobs.select(*request).distinct()


def with_model(jobs: DataFrame, load: Callable[[], Callable[[list[dict]], list[dict]]], schema: str, batch: int = 4, retries: int = 1) -> DataFrame:
    """Rows of jobs, batch by batch, through a model that each Python worker loads once.
    load: returns a function from rows (dicts) to answers (dicts by schema). A failed batch is tried again row by
    row; a row that fails then gets null answers and its error, never an exception."""
    import pandas as pd

    names = T.StructType.fromDDL(schema).names
    held: dict = {}

    def attempt(model, rows: list[dict]) -> list[dict]:
        for k in range(retries + 1):
            try:
                return [dict(a, error=None) for a in model(rows)]
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return [{"error": error}] if len(rows) == 1 else [a for r in rows for a in attempt(model, [r])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "model" not in held:
            held["model"] = load()
        for p in parts:
            for i in range(0, len(p), batch):
                rows = p.iloc[i : i + batch]
                answers = attempt(held["model"], rows.to_dict("records"))
                got = pd.DataFrame([{n: a.get(n) for n in [*names, "error"]} for a in answers], columns=[*names, "error"])
                yield pd.concat([rows.reset_index(drop=True), got], axis=1)

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema.fields)
    return jobs.mapInPandas(run, f"{given}, {schema}, error string")


def verifier_stack(results: Column) -> Column:
    """All verifiers agree: struct match, score (the least) and reasons. results: array of struct match, score, reason."""
    return F.struct(
        (F.forall(results, lambda r: F.coalesce(r["match"], F.lit(False))) & (F.size(results) > 0)).alias("match"),
        F.coalesce(F.array_min(F.transform(results, lambda r: r["score"])), F.lit(0.0)).alias("score"),
        F.array_join(F.filter(F.transform(results, lambda r: r["reason"]), lambda x: x != ""), " | ").alias("reason"),
    )


def best_mask(masks: Column) -> Column:
    """The mask of the highest score, the first of equals. masks: array of struct score, mask."""
    top = F.array_max(F.transform(masks, lambda m: m["score"]))
    return F.get(F.filter(masks, lambda m: m["score"] == top), F.lit(0))


def rewrite_tasks(plans: DataFrame, ids: list[str], candidates: str = "severity_candidates", least: str = "low") -> DataFrame:
    """One row for each job, severity, candidate and mode that needs a rewrite, severities from least up."""
    ranks = {"low": 0, "medium": 1, "high": 2}
    rows = plans.select(*ids, F.explode(candidates).alias("severity", "cands")).select(
        *ids, "severity", F.posexplode("cands").alias("candidate_index", "candidate")
    )
    wanted = [s for s, r in ranks.items() if r >= ranks[least]]
    return rows.where(F.col("severity").isin(wanted)).select("*", F.explode(F.array(F.lit("text_only"), F.lit("joint"))).alias("mode"))


def rewrites_back(answers: DataFrame, ids: list[str], answer: str) -> DataFrame:
    """Answers of the modes of each candidate as a map."""
    return answers.groupBy(*ids, "severity", "candidate_index").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", answer)))).alias("headline_rewrite")
    )
