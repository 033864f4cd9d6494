"""Predictions, their scores, and the search for the best candidate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findspan.functions.scoring import is_finite
from findspan.session import in_blocks, small_batches

# Candidates that one pass over the examples evaluates; a longer list takes more passes.
CANDIDATES_PER_PASS = 5_000

# Fixed value: a candidate is chosen for all predictors if it beats the mean of their bests by this factor.
GLOBAL_FACTOR = 1.1


def predict(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], Sequence],
    batch: int = 32,
    result: str = "prediction",
    result_type: str = "string",
) -> DataFrame:
    """Run a user's batch predictor. Rows of a failing batch are retried alone; rows that still
    fail are kept with a null result and the ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), batch):
                rows = part.iloc[start:start + batch].reset_index(drop=True)
                try:
                    values = list(fn(rows))
                    if len(values) != len(rows):
                        raise ValueError(f"{len(values)} predictions for {len(rows)} rows")
                    errors = [None] * len(rows)
                except Exception:  # noqa: BLE001 - any failure of user code becomes data
                    values, errors = [], []
                    for i in range(len(rows)):
                        try:
                            (value,) = fn(rows.iloc[i:i + 1].reset_index(drop=True))
                            values.append(value)
                            errors.append(None)
                        except Exception as error:  # noqa: BLE001
                            values.append(None)
                            errors.append(f"{type(error).__name__}: {error}")
                out = rows.copy()
                out[result] = pd.Series(values, dtype=object)
                out["error"] = pd.Series(errors, dtype=object)
                yield out

    schema = T.StructType(list(df.schema.fields)).add(
        T.StructField(result, T.DataType.fromDDL(result_type), True)).add("error", T.StringType(), True)
    return df.mapInPandas(run, schema)


def score_predictions(
    examples: DataFrame, predictions: DataFrame, keys: Sequence[str], metric: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Mean metric over all examples; an example without a prediction counts 0.

    ``metric`` is an expression over the joined row.
    """
    joined = examples.join(predictions, list(keys), "left")
    return joined.groupBy(*by).agg(
        F.count("*").alias("examples"),
        F.coalesce(F.avg(F.coalesce(metric.cast("double"), F.lit(0.0))), F.lit(0.0)).alias("score"),
    )


def best_candidate(evals: DataFrame) -> DataFrame:
    """Best finite candidate of each predictor with the mean of its ten best scores.

    ``global_choice`` is set on the row of the best candidate overall when its score exceeds the
    mean of the bests by the fixed factor. Ties go to the candidate (and predictor) first by name.
    """
    finite = evals.filter(is_finite(F.col("score")))
    order = W.partitionBy("predictor").orderBy(F.desc("score"), "candidate")
    top = finite.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= 10)
    bests = top.groupBy("predictor").agg(
        F.max(F.when(F.col("__rank") == 1, F.col("candidate"))).alias("candidate"),
        F.max("score").alias("score"),
        F.avg("score").alias("top_mean"),
    )
    overall = bests.agg(
        F.struct(
            F.avg("score").alias("mean"),
            F.min(F.struct((-F.col("score")).alias("s"), "predictor"))["predictor"].alias("first"),
        )
    ).scalar()
    chosen = (F.col("predictor") == overall["first"]) & (F.col("score") > overall["mean"] * GLOBAL_FACTOR)
    return bests.withColumn("global_choice", chosen)


def search_candidates(
    candidates: DataFrame,
    examples: DataFrame,
    fn: Callable[[str, pd.DataFrame], Sequence],
    metric: Callable[[pd.DataFrame, Sequence], Sequence[float]],
    scored: DataFrame | None = None,
) -> DataFrame:
    """Mean score of every candidate over all examples; those in ``scored`` keep their score.

    Candidates travel to the examples in blocks, so the list may have any length. Each task yields one
    partial sum per candidate, so pairs are never rows and only sums are shuffled. A worker holds a thousand
    examples at a time, so its memory doesn't grow with the table. An example whose prediction fails counts 0; without examples every score is 0.
    """
    small_batches(examples.sparkSession)
    wanted = candidates.select("predictor", "candidate").distinct()
    if scored is not None:
        wanted = wanted.join(scored.select("predictor", "candidate"), ["predictor", "candidate"], "left_anti")

    def evaluate_all(todo: list[tuple[str, str]]) -> Callable:
        def evaluate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals, n = [0.0] * len(todo), 0
            for part in parts:
                n += len(part)
                for place, (_, candidate) in enumerate(todo):
                    try:
                        total = float(sum(metric(part, fn(candidate, part))))
                    except Exception:  # noqa: BLE001 - find the examples that fail
                        total = 0.0
                        for i in range(len(part)):
                            one = part.iloc[i:i + 1]
                            try:
                                total += float(sum(metric(one, fn(candidate, one))))
                            except Exception:  # noqa: BLE001
                                continue
                    totals[place] += total
            if n:
                rows = [(predictor, candidate, total, n) for (predictor, candidate), total in zip(todo, totals)]
                yield pd.DataFrame(rows, columns=["predictor", "candidate", "total", "n"])

        return evaluate

    schema = "predictor string, candidate string, total double, n long"
    # A row of nothing for every candidate, so that each has a score even without examples.
    partial = wanted.select("predictor", "candidate", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
    for rows in in_blocks(wanted, ["predictor", "candidate"], CANDIDATES_PER_PASS):
        todo = sorted((r.predictor, r.candidate) for r in rows)
        partial = partial.unionByName(examples.mapInPandas(evaluate_all(todo), schema))
    new = partial.groupBy("predictor", "candidate").agg(
        F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(0.0)).alias("score"))
    if scored is None:
        return new
    return new.unionByName(scored.select("predictor", "candidate", "score"))
