"""Folds, random search, nested cross-validation, and the final refit."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.functions.hashing import shuffle_key
from outlast.functions.ordering import number_rows
from outlast.models.boosting import fit_boostings
from outlast.models.cox import fit_cox_path
from outlast.models.forest import fit_forests
from outlast.operators.concordance import harrell_c
from outlast.operators.evaluation import QUANTILES, evaluate, evaluation_times
from outlast.session import at_once, cut_lineage
from outlast.sources.schema import METRICS, METRICS_DDL

# The published search spaces.
COX_SPACE = {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}
FOREST_SPACE = {
    "n_estimators": [200, 500, 1000],
    "min_samples_leaf": [5, 15, 30, 50],
    "max_features": ["sqrt", "log2", 0.5],
    "max_depth": [None, 5, 10, 20],
}
BOOSTING_SPACE = {
    "n_estimators": [100, 300, 500, 1000],
    "learning_rate": [0.01, 0.05, 0.1, 0.3],
    "max_depth": [2, 3, 4, 6],
    "subsample": [0.6, 0.8, 1.0],
}
QUICK = {"n_folds": 3, "n_iter": 5}
FULL = {"n_folds": 10, "n_iter": 25}


@dataclass(frozen=True)
class ModelSpec:
    """How to fit one family. ``fit_all`` takes the training rows and several parameter sets, so a
    family can share passes over the data between them."""

    name: str
    space: dict[str, list]
    fit_all: Callable[[DataFrame, list[dict]], list]

    def fit(self, train: DataFrame, params: dict):
        return self.fit_all(train, [params])[0]


def cox_spec(space: dict[str, list] = COX_SPACE) -> ModelSpec:
    return ModelSpec("Cox PH", space, lambda train, sets: fit_cox_path(train, [s["alpha"] for s in sets]))


def forest_spec(space: dict[str, list] = FOREST_SPACE, seed: int = 42) -> ModelSpec:
    return ModelSpec("RSF", space, lambda train, sets: fit_forests(train, sets, seed))


def boosting_spec(space: dict[str, list] = BOOSTING_SPACE, seed: int = 42) -> ModelSpec:
    return ModelSpec("Gradient Boosting", space, lambda train, sets: fit_boostings(train, sets, seed))


def registry(seed: int = 42) -> dict[str, ModelSpec]:
    return {s.name: s for s in (cox_spec(), forest_spec(seed=seed), boosting_spec(seed=seed))}


def quick_registry(seed: int = 42) -> dict[str, ModelSpec]:
    """Fixed, modest settings for ranking models cheaply."""
    one = lambda **kw: {k: [v] for k, v in kw.items()}
    specs = (cox_spec(one(alpha=1.0)), forest_spec(one(n_estimators=200, min_samples_leaf=15), seed),
             boosting_spec(one(n_estimators=200, learning_rate=0.05, max_depth=3), seed))
    return {s.name: s for s in specs}


# ---- folds ----------------------------------------------------------------------------------

def assign_folds(df: DataFrame, k: int, seed: int = 42, stratify: str | None = "evento",
                 key: str = "tasker_id", name: str = "fold", slices: int | None = None) -> DataFrame:
    """Shuffled folds of equal size, within each class of ``stratify`` when given."""
    by = [stratify] if stratify else []
    ranked = number_rows(df, shuffle_key(F.col(key), seed), F.col(key), by, "_rank", slices)
    return ranked.withColumn(name, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def stratified_folds(df: DataFrame, k: int, seed: int = 42, key: str = "tasker_id") -> DataFrame:
    return assign_folds(df, k, seed, "evento", key)


# ---- search ---------------------------------------------------------------------------------

def draw_parameters(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Seeded draws without repetition; the whole grid when it is no larger than ``n_iter``."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return grid if len(grid) <= n_iter else random.Random(seed).sample(grid, n_iter)


@dataclass(frozen=True)
class Search:
    model: object
    params: dict
    scores: list[tuple[dict, float]] = field(default_factory=list)


def _scored(model, df: DataFrame, **labels) -> DataFrame:
    return model.with_risk(df).select(
        *[F.lit(v).alias(n) for n, v in labels.items()], "tempo", "evento", "risk")


def random_search(train: DataFrame, spec: ModelSpec, n_iter: int, seed: int = 42, n_folds: int = 3) -> Search:
    """Inner cross-validation scored by Harrell's C, then a refit of the winner on all rows.

    The predictions of all candidates and folds are scored by one grouped concordance job.
    """
    draws = draw_parameters(spec.space, n_iter, seed)
    if len(draws) == 1:
        return Search(spec.fit(train, draws[0]), draws[0])
    folded = cut_lineage(assign_folds(train, n_folds, seed, stratify=None, name="_inner"))

    def held_scores(k: int) -> list[DataFrame]:
        fit_rows, held = folded.where(F.col("_inner") != k).drop("_inner"), folded.where(F.col("_inner") == k)
        return [_scored(model, held.drop("_inner"), candidate=i, inner=k)
                for i, model in enumerate(spec.fit_all(fit_rows, draws))]

    parts = at_once(train.sparkSession, [partial(held_scores, k) for k in range(n_folds)])
    scores = harrell_c(cut_lineage(reduce(DataFrame.unionByName, chain(*parts))), by=["candidate", "inner"])
    means = {r["candidate"]: r["c"] for r in
             scores.groupBy("candidate").agg(F.avg("c_harrell").alias("c")).collect()}
    best = max(range(len(draws)), key=lambda i: (means[i], -i))
    return Search(spec.fit(train, draws[best]), draws[best], [(d, means[i]) for i, d in enumerate(draws)])


def score_fold(model, train: DataFrame, test: DataFrame, quantiles: Iterable[float] = QUANTILES) -> DataFrame:
    """The four metrics of a fitted model on held-out rows (one row)."""
    times = cut_lineage(evaluation_times(train, test, quantiles))
    predicted = model.with_survival(model.with_risk(test), times)
    held = cut_lineage(predicted.select("tempo", "evento", "risk", "surv"))
    return evaluate(train.select("tempo", "evento"), held, times)


def nested_cv(matrix: DataFrame, specs: Iterable[ModelSpec], n_folds: int, n_iter: int, seed: int = 42,
              quantiles: Iterable[float] = QUANTILES, inner_folds: int = 3) -> DataFrame:
    """One metric row per (model, fold). Pass a written matrix: every fit scans it again."""
    folded = cut_lineage(stratified_folds(matrix, n_folds, seed))

    def scores_of(spec: ModelSpec, k: int) -> tuple:
        train, test = folded.where(F.col("fold") != k).drop("fold"), folded.where(F.col("fold") == k).drop("fold")
        found = random_search(train, spec, n_iter, seed, inner_folds)
        scores = score_fold(found.model, train, test, quantiles).first()
        return spec.name, k, *[scores[m] for m in METRICS]

    rows = at_once(matrix.sparkSession, [partial(scores_of, spec, k) for spec in specs for k in range(n_folds)])
    return matrix.sparkSession.createDataFrame(rows, METRICS_DDL)


def final_fit(matrix: DataFrame, specs: Iterable[ModelSpec], n_iter: int, seed: int = 42,
              inner_folds: int = 3) -> tuple[dict, DataFrame]:
    """Search on all rows: the fitted models by name, and the table of winning parameters."""
    specs = list(specs)
    searches = at_once(matrix.sparkSession, [
        partial(random_search, matrix, spec, n_iter, seed, inner_folds) for spec in specs])
    found = {spec.name: search for spec, search in zip(specs, searches)}
    rows = [(name, json.dumps(s.params, sort_keys=True)) for name, s in found.items()]
    table = matrix.sparkSession.createDataFrame(rows, "modelo STRING, hiperparametros STRING")
    return {name: s.model for name, s in found.items()}, table
