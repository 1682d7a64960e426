"""The stages of a churn study, from the three tables to written results.

Each stage reads and writes tables, so it can run as its own Spark job and be repeated alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.models.boosting import BoostedModel
from outlast.models.cox import CoxModel
from outlast.models.forest import ForestModel
from outlast.models.selection import ModelSpec, final_fit, nested_cv, quick_registry, score_fold, stratified_folds
from outlast.models.shapley import tree_shapley_values
from outlast.operators import compare as cp
from outlast.operators import survival as sv
from outlast.operators.cohort import CohortRules, build_cohort, cohort_summary, sensitivity_grid
from outlast.operators.eda import round_numbers
from outlast.operators.features import feature_matrix
from outlast.operators.interpret import (on_design, partial_dependence, pdp_targets, permutation_importance,
                                         shapley_mean_abs, shapley_values)
from outlast.operators.preprocess import predictor_columns
from outlast.session import at_once, cut_lineage
from outlast.sources.schema import METRICS_DDL
from outlast.sources.tables import Tables, log_run, read_csv, write_csv, write_table

# Features whose partial dependence is always reported.
PDP_FEATURES = ["taxa_preferencial", "nota_max_servico", "pontualidade", "taxa_retencao"]
MIN_EVENTS = 30


def cohort_matrix(tables: Tables, rules: CohortRules) -> DataFrame:
    """Feature matrix of a cohort; the cohort in between is written once and read by each block."""
    cohort = cut_lineage(build_cohort(tables.taskers, tables.jobs, tables.incidents, rules))
    return feature_matrix(cohort, tables.jobs, tables.incidents)


def build_study(tables: Tables, rules: CohortRules, out_dir: str) -> DataFrame:
    """Stage 2: write the feature matrix to ``out_dir`` and return the cohort summary."""
    spark = tables.taskers.sparkSession
    matrix = spark.read.parquet(write_table(cohort_matrix(tables, rules), f"{out_dir}/cohort.parquet"))
    return cohort_summary(matrix)


def mean_uno_c(matrix: DataFrame, specs: Iterable[ModelSpec], n_folds: int = 3, seed: int = 42) -> dict[str, float]:
    """Mean Uno concordance of each model (its first parameter set) over stratified folds."""
    folded = cut_lineage(stratified_folds(matrix, n_folds, seed))
    specs = list(specs)

    def c_uno(spec: ModelSpec, k: int) -> float:
        train, test = folded.where(F.col("fold") != k).drop("fold"), folded.where(F.col("fold") == k).drop("fold")
        model = spec.fit(train, {name: values[0] for name, values in spec.space.items()})
        return score_fold(model, train, test).first()["c_uno"]

    scores = at_once(matrix.sparkSession, [partial(c_uno, spec, k) for spec in specs for k in range(n_folds)])
    return {spec.name: sum(scores[i * n_folds:(i + 1) * n_folds]) / n_folds for i, spec in enumerate(specs)}


def sensitivity_ranking(tables: Tables, rules: CohortRules, inactivity_days: Iterable[int],
                        landmark_days: Iterable[int], specs: Iterable[ModelSpec] | None = None,
                        seed: int = 42, min_events: int = MIN_EVENTS) -> DataFrame:
    """The sensitivity grid plus a ``c_uno[model]`` column per model, for cohorts with enough events."""
    specs = list(quick_registry(seed).values() if specs is None else specs)
    grid = cut_lineage(sensitivity_grid(tables.taskers, tables.jobs, tables.incidents, rules,
                                        inactivity_days, landmark_days))

    def ranked(w: int, landmark: int) -> tuple:
        chosen = replace(rules, inactivity_days=w, landmark_days=landmark)
        means = mean_uno_c(cut_lineage(cohort_matrix(tables, chosen)), specs, seed=seed)
        return w, landmark, *[float(means[s.name]) for s in specs]

    points = grid.where(F.col("n_eventos") > min_events).select("W", "landmark").collect()
    rows = at_once(grid.sparkSession, [partial(ranked, p["W"], p["landmark"]) for p in points])
    ddl = "W INT, landmark INT, " + ", ".join(f"`c_uno[{s.name}]` DOUBLE" for s in specs)
    return grid.join(grid.sparkSession.createDataFrame(rows, ddl), ["W", "landmark"], "left")


def sensitivity_study(tables: Tables, rules: CohortRules, inactivity_days: Iterable[int], landmark_days: Iterable[int],
                      out_dir: str, specs: Iterable[ModelSpec] | None = None, seed: int = 42) -> DataFrame:
    """Stage 6: write the sensitivity table, rounded to four decimals, and return it."""
    found = sensitivity_ranking(tables, rules, inactivity_days, landmark_days, specs, seed)
    return found.sparkSession.read.parquet(write_table(round_numbers(found, 4), f"{out_dir}/sensibilidade"))


def model_path(out_dir: str, name: str) -> str:
    return f"{out_dir}/modelos/{name.replace(' ', '_')}"


def train_and_evaluate(matrix: DataFrame, specs: Iterable[ModelSpec], out_dir: str, n_folds: int = 10, n_iter: int = 25,
                       inner_folds: int = 3, seed: int = 42) -> DataFrame:
    """Stage 3: nested cross-validation, summary, final fits, winning parameters, run log; all written.

    Returns the metrics by model and fold.
    """
    spark, specs = matrix.sparkSession, list(specs)
    path = write_csv(nested_cv(matrix, specs, n_folds, n_iter, seed, inner_folds=inner_folds), f"{out_dir}/metricas_por_fold")
    metrics = read_csv(spark, path, METRICS_DDL)
    summary = spark.read.parquet(write_table(cp.metric_summary(metrics), f"{out_dir}/comparacao_modelos"))
    models, parameters = final_fit(matrix, specs, n_iter, seed, inner_folds)
    for name, model in models.items():
        model.save(model_path(out_dir, name))
    write_table(parameters, f"{out_dir}/hiperparametros")
    config = {"n_folds": n_folds, "n_iter": n_iter, "inner_folds": inner_folds, "seed": seed, "modelos": sorted(models)}
    log_run("treino_avaliacao", config, summary, f"{out_dir}/execucoes")
    return metrics


def load_model(spark, out_dir: str, name: str):
    """A model that stage 3 saved."""
    kinds = {"Cox PH": CoxModel, "RSF": ForestModel, "Gradient Boosting": BoostedModel}
    if name not in kinds:
        raise ValueError(f"unknown model {name!r}, expected one of {sorted(kinds)}")
    return kinds[name].load(spark, model_path(out_dir, name))


def compare_study(spark, out_dir: str, metric: str = "c_uno") -> cp.Comparison:
    """Stage 4: read the metrics by fold, compare the models, and write the four tables."""
    metrics = read_csv(spark, f"{out_dir}/metricas_por_fold", METRICS_DDL)
    found = cp.compare_models(metrics, metric)
    names = ("teste_friedman", "ranks_medios", "posthoc_nemenyi", "grupos")
    parts = (found.summary, found.ranks, found.nemenyi, found.groups)
    return cp.Comparison(*[spark.read.parquet(write_table(t, f"{out_dir}/{n}_{metric}")) for t, n in zip(parts, names)])


def stratified_study(matrix: DataFrame, out_dir: str) -> DataFrame:
    """Curves and log-rank tests by loyalty (median split) and by bonus (terciles), written; returns the tests."""
    loyal = sv.median_split(matrix.select("tempo", "evento", "taxa_preferencial"), "taxa_preferencial")
    bonus = sv.tercile_split(matrix.select("tempo", "evento", "bonus_total"), "bonus_total")
    curves, tests = [], []
    for name, rows, groups in (("fidelizacao", loyal, ["low", "high"]), ("bonus", bonus, ["low", "mid", "high"])):
        curves.append(sv.stratified_kaplan_meier(rows).withColumn("analise", F.lit(name)))
        tests.append(sv.logrank_test(rows, groups).withColumn("analise", F.lit(name)))
    write_table(reduce(DataFrame.unionByName, curves), f"{out_dir}/km_estratificado")
    return matrix.sparkSession.read.parquet(write_table(reduce(DataFrame.unionByName, tests), f"{out_dir}/logrank"))


def best_saved_model(spark, out_dir: str):
    """The saved model with the best mean Uno concordance over the folds."""
    metrics = read_csv(spark, f"{out_dir}/metricas_por_fold", METRICS_DDL)
    return load_model(spark, out_dir, cp.best_model(metrics).first()["modelo"])


def explain_study(matrix: DataFrame, out_dir: str, n_repeats: int = 10, seed: int = 42, **shapley) -> DataFrame:
    """Stage 5: explain the best saved model; importance, partial dependence, Shapley values and strata.

    Shapley values are exact for forest and boosting; Cox's come from sampled feature orders, exact for a linear score.
    """
    model = best_saved_model(matrix.sparkSession, out_dir)
    importance = interpret_model(model, matrix, out_dir, n_repeats, seed)
    if hasattr(model, "packed"):
        bounds = {k: v for k, v in shapley.items() if k != "n_permutations"}
        values = tree_shapley_values(model, matrix, seed=seed, **bounds)
    else:
        design = cut_lineage(model.preprocessor.transform(matrix))
        values = shapley_values(on_design(model), design, model.preprocessor.outputs(), seed=seed, **shapley)
    write_table(shapley_mean_abs(values), f"{out_dir}/shap_resumo")
    stratified_study(matrix, out_dir)
    return importance


def interpret_model(model, matrix: DataFrame, out_dir: str, n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """Importance of every predictor, and one partial-dependence table by feature.

    The table replaces the one of an earlier run, so no stale feature survives in it.
    """
    numeric, categorical = predictor_columns(matrix)
    importance = cut_lineage(permutation_importance(model, matrix, numeric + categorical, n_repeats, seed))
    write_table(importance, f"{out_dir}/importancia_permutacao")
    targets = [r["atributo"] for r in pdp_targets(
        importance, matrix.select(*numeric), PDP_FEATURES).orderBy("posicao").collect()]
    curves = reduce(DataFrame.unionByName, [partial_dependence(model, matrix, t) for t in targets])
    write_table(curves, f"{out_dir}/pdp", partition_by=["atributo"])
    return importance
