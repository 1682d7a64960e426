"""Named queries: ``name -> f(spark, sf_dir)``. All of them read whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlast.functions.ordering import long_columns
from outlast.functions.scalar import age_years, haversine_km, ntz
from outlast.functions.text import normalize_text
from outlast.models import selection as sel
from outlast.models.boosting import fit_boosting
from outlast.models.cox import fit_cox
from outlast.models.forest import best_cuts, fit_forest
from outlast.models.hazard import cox_gradient, partial_loglik
from outlast.models.shapley import tree_shapley_values
from outlast.operators import cohort as co
from outlast.operators import compare as cp
from outlast.operators import concordance as cc
from outlast.operators import eda
from outlast.operators import evaluation as ev
from outlast.operators import features as ft
from outlast.operators import interpret as ip
from outlast.operators import preprocess as pp
from outlast.operators import survival as sv
from outlast.plans import study
from outlast.session import at_once, shared_folder, configure, cut_lineage
from outlast.sources import schema, tables
from outlast.sources.star import metrics_by_fold_view, scan, star_tables

RULES = co.CohortRules(cutoff="2001-11-01", purge_days=60, inactivity_days=60, landmark_days=180, city=None, state=None)
RESIDENTS = co.CohortRules(cutoff="2001-11-01", purge_days=60, inactivity_days=60, landmark_days=180,
                           city="Middle East", state="r4")
GRID = ([30, 60, 90], [90, 180, 270])
IMPUTED = ["idade", "distancia_media_km", "pontualidade", "nota_media_diarias"]
MONEY = {"remuneracao_total", "remuneracao_media", "bonus_total", "penalidade_total", "final_payout",
         "bonus_payout", "penalty_amount"}
# Shifts values off exact decimal ties, so that two engines round sums of different order alike.
NUDGE = 3.1e-9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = configured
    return run


# ---- presentation ---------------------------------------------------------------------------

def _round(c: str) -> Column:
    digits = 4 if c in MONEY else 6
    return (F.round(F.col(c) + F.lit(NUDGE * 10 ** (6 - digits)), digits) + 0.0).alias(c)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (money to four)."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select([_round(c) if c in doubles else F.col(c) for c in df.columns])


def _double_counts(df: DataFrame) -> DataFrame:
    """Nullable integers as doubles: pandas has no other common form for them."""
    return df.withColumns({c: F.col(c).cast("double") for c in schema.SCORE_COUNTS})


# ---- shared inputs --------------------------------------------------------------------------

def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    t = star_tables(spark, sf)
    return co.build_cohort(t.taskers, t.jobs, t.incidents, RULES)


def _target(spark: SparkSession, sf: str) -> DataFrame:
    t = star_tables(spark, sf)
    return co.survival_target(co.cohort_filter(co.milestones(t.taskers), RULES), t.jobs, t.incidents, RULES)


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(study.cohort_matrix(star_tables(spark, sf), RULES))


def _formula_risk(key: str = "tasker_id") -> Column:
    return F.round(F.sin(key) * 3, 1)


def _risky(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(_target(spark, sf).select("tasker_id", "tempo", "evento", _formula_risk().alias("risk")))


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame


def _split(df: DataFrame) -> Split:
    folded = cut_lineage(sel.stratified_folds(df, 3))
    return Split(folded.where("fold <> 0"), folded.where("fold = 0"))


def _formula_survival(test: DataFrame, times: DataFrame) -> DataFrame:
    return test.withColumn("_t", times.select("times").scalar()).withColumn(
        "surv", F.transform("_t", lambda t: F.exp(-(t / 4000) * F.exp(F.col("risk") / 3)))).drop("_t")


def _evaluation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and (weighted) test rows censored at the horizon, and the evaluation times."""
    s = _split(_risky(spark, sf))
    times = cut_lineage(ev.evaluation_times(s.train, s.test))
    tau = times.select("tau").scalar()
    train = ev.admin_censor(s.train, tau)
    test = _formula_survival(ev.admin_censor(s.test, tau), times)
    return train, cut_lineage(ev.with_weights(train, test)), times


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics_by_fold_view(spark, sf)


# ---- sources and sinks ----------------------------------------------------------------------

@query
def csv_roundtrip(spark, sf):
    path = tables.write_csv(_metrics(spark, sf).select("modelo", "fold", *schema.METRICS),
                            f"{shared_folder(spark)}/{uuid4().hex}")
    return rounded(tables.read_csv(spark, path, schema.METRICS_DDL))


@query
def run_log(spark, sf):
    return tables.log_run("treino_avaliacao", {"rules": vars(RULES)}, cp.metric_summary(_metrics(spark, sf)),
                          f"{shared_folder(spark)}/{uuid4().hex}").drop("carimbo")


@query
def table_counts(spark, sf):
    return eda.table_counts(vars(star_tables(spark, sf)))


@query
def descriptive_table(spark, sf):
    matrix = _matrix(spark, sf)
    return eda.descriptive_table(matrix, len(matrix.columns) - len(schema.NOT_PREDICTORS))


# ---- cohort ---------------------------------------------------------------------------------

@query
def milestones(spark, sf):
    return co.milestones(star_tables(spark, sf).taskers)


@query
def latest_profile(spark, sf):
    return rounded(co.latest_profile(star_tables(spark, sf).taskers))


@query
def normalize_text_documents(spark, sf):
    docs = scan(spark, sf, "documents")
    plain = docs.select("doc_id", normalize_text(F.col("text")).alias("t"))
    return plain.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query
def normalize_text_regions(spark, sf):
    regions = scan(spark, sf, "region")
    return regions.select("r_regionkey", normalize_text(F.col("r_name")).alias("name"))


@query
def cohort_filter(spark, sf):
    t = star_tables(spark, sf)
    return co.cohort_filter(co.lifecycle(t.taskers), RESIDENTS).select(
        "tasker_id", "ativacao_at", "city", "state_uf")


@query
def last_activity(spark, sf):
    return co.last_activity(star_tables(spark, sf).jobs)


@query
def involuntary_keys(spark, sf):
    return co.involuntary_keys(star_tables(spark, sf).incidents)


@query
def survival_target(spark, sf):
    return _target(spark, sf)


@query
def asof_snapshot(spark, sf):
    t = star_tables(spark, sf)
    target = co.survival_target(co.cohort_filter(co.milestones(t.taskers), RULES), t.jobs, t.incidents, RULES)
    return rounded(_double_counts(co.asof_snapshot(t.taskers, target)))


@query
def cohort(spark, sf):
    return rounded(_double_counts(_cohort(spark, sf)))


@query
def cohort_summary(spark, sf):
    return rounded(co.cohort_summary(_target(spark, sf)))


@query
def cohort_summary_residents(spark, sf):
    t = star_tables(spark, sf)
    return rounded(co.cohort_summary(co.build_cohort(t.taskers, t.jobs, t.incidents, RESIDENTS)))


@query
def sensitivity_grid(spark, sf):
    t = star_tables(spark, sf)
    return rounded(co.sensitivity_grid(t.taskers, t.jobs, t.incidents, RULES, *GRID))


@query
def time_describe(spark, sf):
    return rounded(eda.time_describe(_target(spark, sf)))


@query
def activation_funnel(spark, sf):
    return rounded(eda.activation_funnel(star_tables(spark, sf).taskers))


# ---- features -------------------------------------------------------------------------------

@query
def haversine_distance(spark, sf):
    t = star_tables(spark, sf)
    homes = co.latest_profile(t.taskers.select("tasker_id", "updated_at", "rev", "latitude", "longitude")).select(
        "tasker_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    km = haversine_km(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude"))
    return rounded(t.jobs.join(homes, "tasker_id").select("tasker_id", "job_id", km.alias("km")))


@query
def age_in_years(spark, sf):
    t = star_tables(spark, sf).taskers.select("tasker_id", "updated_at", "rev", "birthdate")
    return rounded(co.latest_profile(t).select(
        "tasker_id", age_years(F.col("birthdate"), ntz(ft.AGE_REFERENCE)).alias("idade")))


@query
def profile_features(spark, sf):
    return rounded(ft.profile_features(_cohort(spark, sf)))


@query
def funnel_intervals(spark, sf):
    return rounded(ft.funnel_intervals(_cohort(spark, sf)))


@query
def identity_features(spark, sf):
    return rounded(ft.identity_features(_cohort(spark, sf)))


@query
def reputation_features(spark, sf):
    return rounded(ft.reputation_features(_cohort(spark, sf)))


@query
def service_scores(spark, sf):
    return rounded(ft.service_scores(_cohort(spark, sf)))


@query
def window_jobs(spark, sf):
    rows = ft.window_jobs(cut_lineage(_cohort(spark, sf)), star_tables(spark, sf).jobs)
    return rounded(rows.select("tasker_id", "job_id", "job_date", "final_payout", "distancia_km",
                               "antecedencia_confirmacao_dias"))


@query
def window_productivity(spark, sf):
    return rounded(ft.window_productivity(cut_lineage(_cohort(spark, sf)), star_tables(spark, sf).jobs))


@query
def genuine_rating(spark, sf):
    return rounded(ft.genuine_rating(cut_lineage(_cohort(spark, sf)), star_tables(spark, sf).jobs))


@query
def distance_stats(spark, sf):
    return rounded(ft.distance_stats(cut_lineage(_cohort(spark, sf)), star_tables(spark, sf).jobs))


@query
def conduct_features(spark, sf):
    return rounded(ft.conduct_features(cut_lineage(_cohort(spark, sf)), star_tables(spark, sf).incidents))


@query
def window_features(spark, sf):
    t = star_tables(spark, sf)
    return rounded(ft.window_features(cut_lineage(_cohort(spark, sf)), t.jobs, t.incidents))


@query
def feature_matrix(spark, sf):
    return rounded(study.cohort_matrix(star_tables(spark, sf), RULES))


# ---- preprocessing --------------------------------------------------------------------------

def _prepared(spark, sf) -> tuple[DataFrame, DataFrame]:
    folded = cut_lineage(sel.stratified_folds(_matrix(spark, sf), 3))
    return folded.where("fold <> 0").drop("fold"), folded.drop("fold")


def _melt(df: DataFrame) -> DataFrame:
    wide = df.drop("tempo", "evento")
    names = [c for c in wide.columns if c != "tasker_id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names])
    return rounded(wide.select("tasker_id", F.explode(pairs).alias("p")).select("tasker_id", "p.*"))


@query
def impute_median(spark, sf):
    train, rows = _prepared(spark, sf)
    return rounded(pp.impute_median(train, rows.select("tasker_id", *IMPUTED), IMPUTED))


@query
def zscore(spark, sf):
    train, rows = _prepared(spark, sf)
    return rounded(pp.zscore(train, rows.select("tasker_id", *IMPUTED), IMPUTED))


@query
def impute_mode(spark, sf):
    train, rows = _prepared(spark, sf)
    return pp.impute_mode(train, rows.select("tasker_id", *schema.CATEGORICAL), schema.CATEGORICAL)


@query
def one_hot(spark, sf):
    train, rows = _prepared(spark, sf)
    return _melt(pp.one_hot(train, rows.select("tasker_id", *schema.CATEGORICAL), schema.CATEGORICAL))


@query
def preprocess_matrix(spark, sf):
    train, rows = _prepared(spark, sf)
    return _melt(pp.Preprocessor.fit(train, scale=True).transform(rows))


# ---- survival estimation --------------------------------------------------------------------

@query
def kaplan_meier(spark, sf):
    return rounded(sv.kaplan_meier(_target(spark, sf)))


@query
def kaplan_meier_ci(spark, sf):
    return rounded(sv.kaplan_meier(_target(spark, sf), band=True))


@query
def censoring_km(spark, sf):
    return rounded(sv.censoring_survival(_target(spark, sf)))


@query
def nelson_aalen(spark, sf):
    return rounded(sv.nelson_aalen(_target(spark, sf)))


def _by_loyalty(spark, sf):
    return sv.median_split(cut_lineage(ft_columns(spark, sf, "taxa_preferencial")), "taxa_preferencial")


def _by_bonus(spark, sf):
    return sv.tercile_split(_matrix(spark, sf).select("tempo", "evento", "bonus_total"), "bonus_total")


def ft_columns(spark, sf, column: str) -> DataFrame:
    source = {new: old for old, new in schema.REPUTATION.items()}[column]
    return _cohort(spark, sf).select("tempo", "evento", F.col(source).alias(column))


@query
def km_by_median_split(spark, sf):
    return rounded(sv.stratified_kaplan_meier(_by_loyalty(spark, sf)))


@query
def km_by_tercile(spark, sf):
    return rounded(sv.stratified_kaplan_meier(_by_bonus(spark, sf)))


@query
def logrank_2(spark, sf):
    return rounded(sv.logrank_test(_by_loyalty(spark, sf), ["low", "high"]).drop("p_value"))


@query
def logrank_2_p(spark, sf):
    return rounded(sv.logrank_test(_by_loyalty(spark, sf), ["low", "high"]))


@query
def logrank_3(spark, sf):
    return rounded(sv.logrank_test(_by_bonus(spark, sf), ["low", "mid", "high"]))


# ---- evaluation -----------------------------------------------------------------------------

@query
def eval_horizon(spark, sf):
    s = _split(_risky(spark, sf))
    horizon = ev.evaluation_horizon(s.train, s.test)
    return rounded(horizon.withColumn("max_censored", ev.max_censored(s.test).scalar()))


@query
def eval_times(spark, sf):
    s = _split(_risky(spark, sf))
    return rounded(ev.evaluation_times(s.train, s.test).select("low", "tau", F.explode("times").alias("t")))


@query
def admin_censor(spark, sf):
    s = _split(_risky(spark, sf))
    tau = ev.evaluation_horizon(s.train, s.test).select("tau").scalar()
    return ev.admin_censor(s.test, tau).select("tasker_id", "tempo", "evento")


@query
def harrell_c(spark, sf):
    return rounded(cc.harrell_c(_risky(spark, sf)))


@query
def harrell_c_fractional(spark, sf):
    quarters = F.col("tempo") + F.col("tasker_id") % 4 / 4
    return rounded(cc.harrell_c(_risky(spark, sf).withColumn("tempo", quarters)))


@query
def pair_counts(spark, sf):
    return cc.pair_counts(_risky(spark, sf)).select("tempo", "comparable", "concordant", "tied")


@query
def uno_c(spark, sf):
    train, test, times = _evaluation(spark, sf)
    return rounded(ev.uno_c(train, test.drop("g"), times.select("tau").scalar()))


@query
def auc_t(spark, sf):
    return rounded(ev.auc_at(*_evaluation(spark, sf)[1:]))


@query
def auc_mean(spark, sf):
    return rounded(ev.auc_mean(*_evaluation(spark, sf)[1:]))


@query
def brier_t(spark, sf):
    return rounded(ev.brier_at(*_evaluation(spark, sf)))


@query
def ibs(spark, sf):
    return rounded(ev.integrated_brier(*_evaluation(spark, sf)))


@query
def evaluate(spark, sf):
    s = _split(_risky(spark, sf))
    times = cut_lineage(ev.evaluation_times(s.train, s.test))
    return rounded(ev.evaluate(s.train, _formula_survival(s.test, times), times))


# ---- models ---------------------------------------------------------------------------------

@query
def cox_partial_loglik_at_zero(spark, sf):
    return rounded(partial_loglik(_target(spark, sf).withColumn("score", F.lit(0.0)), "score"))


@query
def cox_gradient_formula(spark, sf):
    scored = _target(spark, sf).select("tasker_id", "tempo", "evento", (_formula_risk() / 3).alias("score"))
    return rounded(cox_gradient(scored, "score").select("tasker_id", "residual"))


@query
def cox_fit(spark, sf):
    model = fit_cox(_matrix(spark, sf), alpha=1.0)
    return rounded(model.coefficient_table(spark).withColumns(
        {"loglik": F.lit(model.loglik), "iterations": F.lit(model.iterations)}))


@query
def cox_survival_at(spark, sf):
    s = _split(_matrix(spark, sf))
    train, test = s.train.drop("fold"), s.test.drop("fold")
    times = cut_lineage(ev.evaluation_times(train, test))
    predicted = fit_cox(train, alpha=1.0).with_survival(test, times)
    return rounded(predicted.select("tasker_id", F.posexplode("surv").alias("at", "survival")))


@query
def gbm_survival_fit(spark, sf):
    matrix = _matrix(spark, sf)
    return rounded(fit_boosting(matrix, n_estimators=100, subsample=0.8).with_risk(matrix).select("tasker_id", "risk"))


@query
def gbm_first_stump(spark, sf):
    """The values of the two leaves of one round of depth 1."""
    train, _ = _prepared(spark, sf)
    tree = fit_boosting(train, n_estimators=1, max_depth=1, learning_rate=1.0).trees[0]
    low, high = sorted(tree.value[1:])
    return rounded(spark.createDataFrame([(low, high)], "low DOUBLE, high DOUBLE"))


@query
def logrank_best_cuts(spark, sf):
    matrix = _matrix(spark, sf)
    # Values are rounded, so that both engines see the same ones as equal.
    found = best_cuts(rounded(matrix), pp.predictor_columns(matrix)[0], min_leaf=15)
    # Thresholds of equal statistics are a matter of rounding; the statistic is not.
    return found.select("feature", F.round(F.col("score") + NUDGE, 6).alias("score"))


@query
def rsf_fit(spark, sf):
    return rounded(fit_forest(_matrix(spark, sf), n_estimators=200, min_samples_leaf=15).split_table(spark))


@query
def rsf_predict(spark, sf):
    matrix = _matrix(spark, sf)
    return rounded(fit_forest(matrix, n_estimators=200, min_samples_leaf=15).with_risk(matrix).select("tasker_id", "risk"))


@query
def stratified_folds(spark, sf):
    return sel.stratified_folds(_target(spark, sf), 10).select("tasker_id", "evento", "fold")


@query
def unstratified_folds(spark, sf):
    return sel.assign_folds(_target(spark, sf), 3, stratify=None).select("tasker_id", "fold")


@query
def random_search(spark, sf):
    matrix, specs = _matrix(spark, sf), list(sel.registry().values())
    searches = at_once(spark, [partial(sel.random_search, matrix, spec, n_iter=sel.FULL["n_iter"]) for spec in specs])
    rows = [(spec.name, json.dumps(p, sort_keys=True), c, p == found.params)
            for spec, found in zip(specs, searches) for p, c in found.scores]
    return rounded(spark.createDataFrame(rows, "modelo STRING, hiperparametros STRING, c_harrell DOUBLE, chosen BOOLEAN"))


@query
def nested_cv(spark, sf):
    return rounded(sel.nested_cv(_matrix(spark, sf), sel.registry().values(), n_folds=2, n_iter=2, inner_folds=2))


@query
def final_fit(spark, sf):
    return sel.final_fit(_matrix(spark, sf), sel.registry().values(), n_iter=2, inner_folds=2)[1]


@query
def model_roundtrip(spark, sf):
    """Rows whose risk differs between a model and its saved and loaded copy, by family; SQL tells the row count."""
    matrix, out = _matrix(spark, sf), f"{shared_folder(spark)}/{uuid4().hex}"

    def compared(spec: sel.ModelSpec) -> DataFrame:
        model = spec.fit(matrix, {name: values[0] for name, values in spec.space.items()})
        model.save(study.model_path(out, spec.name))
        again = study.load_model(spark, out, spec.name)
        both = again.with_risk(model.with_risk(matrix).withColumnRenamed("risk", "before"))
        return cut_lineage(both.agg(F.lit(spec.name).alias("modelo"), F.count("*").alias("n"),
                                    F.count_if(~F.col("before").eqNullSafe(F.col("risk"))).alias("n_different")))

    return reduce(DataFrame.unionAll, at_once(spark, [partial(compared, s) for s in sel.quick_registry().values()]))


# ---- comparison -----------------------------------------------------------------------------

@query
def metric_summary(spark, sf):
    return cp.metric_summary(_metrics(spark, sf))


@query
def best_model(spark, sf):
    return rounded(cp.best_model(_metrics(spark, sf)))


@query
def metric_pivot(spark, sf):
    return rounded(cp.metric_pivot(_metrics(spark, sf), "c_uno"))


@query
def friedman(spark, sf):
    return rounded(cp.friedman(_metrics(spark, sf), "c_uno"))


@query
def mean_ranks(spark, sf):
    m = cut_lineage(_metrics(spark, sf))
    return rounded(reduce(DataFrame.unionAll, [
        cp.mean_ranks(m, metric).withColumn("metrica", F.lit(metric)) for metric in schema.METRICS]))


@query
def nemenyi_q(spark, sf):
    return rounded(cp.nemenyi_q(_metrics(spark, sf), "c_uno").drop("k"))


@query
def nemenyi_p(spark, sf):
    return rounded(cp.nemenyi_p(_metrics(spark, sf), "c_uno"))


@query
def critical_distance(spark, sf):
    return rounded(cp.critical_distance(_metrics(spark, sf)))


@query
def cd_groups(spark, sf):
    return rounded(cp.cd_groups(_metrics(spark, sf), "c_uno"))


@query
def compare_models(spark, sf):
    return cp.compare_models(_metrics(spark, sf), "ibs").summary


# ---- interpretation and sensitivity ---------------------------------------------------------

def _formula_model() -> ip.ExpressionModel:
    return ip.ExpressionModel(F.coalesce("pontualidade", F.lit(0.0)) * F.coalesce("taxa_preferencial", F.lit(0.0))
                              - F.coalesce("n_diarias", F.lit(0.0)) * 0.25)


def _importance_like(matrix: DataFrame) -> DataFrame:
    columns = ["pontualidade", "simpatia", "n_diarias", "idade", "taxa_preferencial"]
    return long_columns(matrix, columns).groupBy(F.col("column").alias("atributo")).agg(
        F.avg("value").alias("importancia_media"))


@query
def permutation_importance(spark, sf):
    matrix = _matrix(spark, sf)
    numeric, categorical = pp.predictor_columns(matrix)
    return rounded(ip.permutation_importance(_formula_model(), matrix, sorted(numeric + categorical)))


@query
def top_k_importance(spark, sf):
    named = _metrics(spark, sf).select(
        F.concat_ws("-", "modelo", "fold").alias("atributo"), F.col("c_uno").alias("importancia_media"))
    return rounded(ip.top_importance(named, 15))


@query
def partial_dependence(spark, sf):
    return rounded(ip.partial_dependence(_formula_model(), _matrix(spark, sf), "pontualidade"))


@query
def pdp_targets(spark, sf):
    matrix = _matrix(spark, sf)
    return ip.pdp_targets(_importance_like(matrix), matrix, study.PDP_FEATURES)


@query
def shapley_mean_abs(spark, sf):
    matrix = _matrix(spark, sf).select("tasker_id", "pontualidade", "taxa_preferencial", "n_diarias")
    values = ip.shapley_values(_formula_model(), matrix, ["pontualidade", "taxa_preferencial", "n_diarias"])
    return rounded(ip.shapley_mean_abs(values))


@query
def shapley_of_trees(spark, sf):
    """Mean absolute exact Shapley value of every preprocessed feature for a fitted forest and a fitted boosting."""
    matrix, registry = _matrix(spark, sf), sel.quick_registry()

    def explained(name: str) -> DataFrame:
        model = registry[name].fit(matrix, {k: v[0] for k, v in registry[name].space.items()})
        return ip.shapley_mean_abs(tree_shapley_values(model, matrix)).select(F.lit(name).alias("modelo"), "*")

    return rounded(reduce(DataFrame.unionAll, at_once(spark, [partial(explained, n) for n in ("RSF", "Gradient Boosting")])))


@query
def hash_sample(spark, sf):
    return ip.hash_sample(_target(spark, sf), 100).select("tasker_id", "tempo", "evento")


@query
def sensitivity_ranking(spark, sf):
    specs = [sel.cox_spec({"alpha": [1.0]})]
    return rounded(study.sensitivity_ranking(star_tables(spark, sf), RULES, [60], [180], specs))
