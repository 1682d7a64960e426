"""Predictors known at the landmark: profile, funnel, in-window work and conduct, reputation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlast.functions.ordering import grouped_quantiles
from outlast.functions.scalar import (age_years, haversine_km, is_true, non_negative, ntz,
                                      ratio_or_zero, whole_days)
from outlast.operators.cohort import KEY
from outlast.session import cut_lineage
from outlast.sources.schema import REPUTATION, SCORE_COUNTS, SCORES, ZERO_WHEN_ABSENT

AGE_REFERENCE = "2026-01-01"


# ---- profile, funnel, identity: projections of the cohort -----------------------------------

def profile_columns(cohort: DataFrame, reference: str = AGE_REFERENCE) -> dict[str, Column]:
    out = {
        "idade": age_years(F.col("birthdate"), ntz(reference)),
        "genero": F.col("gender"),
        "plano": F.col("plan"),
        "canal_indicacao": F.col("indication"),
    }
    if "n_servicos_oferecidos" in cohort.columns:
        out["n_servicos_oferecidos"] = F.col("n_servicos_oferecidos").cast("double")
    return out


def funnel_columns(cohort: DataFrame) -> dict[str, Column]:
    """Days spent in each step of the activation funnel; null when a step was never taken."""
    spent = lambda a, b: non_negative(whole_days(F.col(a), F.col(b))).cast("double")
    out = {}
    if "onboarding_at" in cohort.columns:
        out["dias_cad_onb"] = spent("criacao_at", "onboarding_at")
        out["dias_onb_atv"] = spent("onboarding_at", "ativacao_at")
    out["dias_cadastro_ativacao"] = spent("criacao_at", "ativacao_at")
    return out


def identity_columns(cohort: DataFrame) -> dict[str, Column]:
    """Identity check: delay and success, both ignored when the check came after the landmark."""
    present, out = set(cohort.columns), {}
    checked = F.col("photo_identity_checked_at")
    in_time = checked <= F.col("landmark_at")
    dated = "photo_identity_checked_at" in present
    if dated and "ativacao_at" in present:
        seen = F.when(in_time, checked) if "landmark_at" in present else checked
        out["dias_ate_verificacao_identidade"] = non_negative(
            whole_days(F.col("ativacao_at"), seen)).cast("double")
    if "photo_identity_state" in present:
        passed = F.col("photo_identity_state") == "approved"
        if dated and "landmark_at" in present:
            passed = passed & in_time
        out["identidade_verificada"] = is_true(passed).cast("double")
    return out


def _project(cohort: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return cohort.select(KEY, *[c.alias(name) for name, c in columns.items()])


def profile_features(cohort: DataFrame, reference: str = AGE_REFERENCE) -> DataFrame:
    return _project(cohort, profile_columns(cohort, reference))


def funnel_intervals(cohort: DataFrame) -> DataFrame:
    return _project(cohort, funnel_columns(cohort))


def identity_features(cohort: DataFrame) -> DataFrame:
    return _project(cohort, identity_columns(cohort))


# ---- reputation: projections of the cohort ---------------------------------------------------

def reputation_columns() -> dict[str, Column]:
    return {new: F.col(old) for old, new in REPUTATION.items()}


def service_score_columns(cohort: DataFrame) -> dict[str, Column]:
    """Review-weighted mean, best score and number of reviewed services over the service scores.

    A missing score has no weight; a score whose review count is missing makes the mean unknown.
    With reviews but no score at all the best score is minus infinity.
    """
    scores = [F.col(c) for c in SCORES if c in cohort.columns]
    counts = [F.col(c).cast("double") for c in SCORE_COUNTS if c in cohort.columns]
    if not scores:
        return {}
    zero = F.lit(0.0)
    weights = [F.when(s.isNull(), zero).otherwise(n) for s, n in zip(scores, counts)]
    total = reduce(lambda a, b: a + b, weights)
    points = reduce(lambda a, b: a + b, [F.coalesce(s * w, zero) for s, w in zip(scores, weights)])
    reviewed = [is_true(n > 0) for n in counts]
    best = F.array_max(F.array(*scores))
    return {
        "nota_media_servicos": F.when(total > 0, F.try_divide(points, total)),
        "n_servicos_avaliados": reduce(lambda a, b: a + b, [r.cast("double") for r in reviewed]),
        "nota_max_servico": F.when(reduce(lambda a, b: a | b, reviewed),
                                   F.coalesce(best, F.lit(float("-inf")))),
    }


def reputation_features(cohort: DataFrame) -> DataFrame:
    return _project(cohort, reputation_columns())


def service_scores(cohort: DataFrame) -> DataFrame:
    return _project(cohort, service_score_columns(cohort))


# ---- facts inside [activation, landmark] -----------------------------------------------------

def _windows(cohort: DataFrame, *extra: Column) -> DataFrame:
    return cohort.select(KEY, "ativacao_at", "landmark_at", *extra)


def _dated(facts: DataFrame, date: str, cohort: DataFrame) -> DataFrame:
    """Facts between the first activation and the last landmark: a bound that reaches the scan.

    The cohort is read once more for it, so pass a written one.
    """
    span = cohort.agg(F.min("ativacao_at").alias("first"), F.max("landmark_at").alias("last"))
    return facts.where((F.col(date) >= span.select("first").scalar()) & (F.col(date) <= span.select("last").scalar()))


def window_jobs(cohort: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs dated inside the professional's window, both ends included, with derived measures."""
    homes = _windows(cohort, F.col("latitude").alias("_home_lat"), F.col("longitude").alias("_home_lon"))
    inside = _dated(jobs, "job_date", cohort).join(homes, KEY).where(F.col("job_date").between(F.col("ativacao_at"), F.col("landmark_at")))
    rows = inside.withColumn("distancia_km", haversine_km(
        F.col("_home_lat"), F.col("_home_lon"), F.col("latitude"), F.col("longitude")))
    if "confirmed_at" in jobs.columns:
        rows = rows.withColumn("antecedencia_confirmacao_dias", non_negative(
            whole_days(F.col("confirmed_at"), F.col("job_date"))).cast("double"))
    return rows.drop("_home_lat", "_home_lon", "ativacao_at", "landmark_at")


def window_incidents(cohort: DataFrame, incidents: DataFrame) -> DataFrame:
    """Non-critical incidents inside the window. Critical ones decide censoring, never a predictor."""
    inside = _dated(incidents.where(~is_true(F.col("disable_tasker"))), "incident_at", cohort).join(_windows(cohort), KEY)
    return inside.where(F.col("incident_at").between(F.col("ativacao_at"), F.col("landmark_at"))).drop(
        "ativacao_at", "landmark_at")


def _sum_or_zero(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def rating_aggregates(rows: DataFrame) -> list[Column]:
    """Mean and number of real ratings: zero means unrated, preferential jobs rate themselves."""
    rated = F.col("feedback_score") > 0
    if "performed_by_preferential" in rows.columns:
        rated = rated & ~F.col("performed_by_preferential")
    score = F.when(rated, F.col("feedback_score"))
    return [F.avg(score).alias("nota_media_diarias"), F.count(score).cast("double").alias("n_diarias_avaliadas")]


def productivity_aggregates(rows: DataFrame) -> list[Column]:
    aggs = [
        F.count("job_id").cast("double").alias("n_diarias"),
        _sum_or_zero(F.col("preferential").cast("double")).alias("n_diarias_pref"),
        _sum_or_zero(F.col("work_time")).alias("tempo_trabalhado_total"),
        F.avg("work_time").alias("tempo_trabalhado_medio"),
        _sum_or_zero(F.col("final_payout")).alias("remuneracao_total"),
        F.avg("final_payout").alias("remuneracao_media"),
    ]
    present = set(rows.columns)
    if "subscription" in present:
        aggs.append(F.avg(F.col("subscription").cast("double")).alias("fracao_assinatura"))
    if "service" in present:
        # Services are a short list, so a set per key stays small and merges on the map side;
        # count_distinct would expand every row and shuffle once more.
        aggs.append(F.size(F.collect_set("service")).cast("double").alias("n_tipos_servico"))
    if "bonus_payout" in present:
        aggs.append(_sum_or_zero(F.col("bonus_payout")).alias("bonus_total"))
    if "antecedencia_confirmacao_dias" in present:
        aggs.append(F.avg("antecedencia_confirmacao_dias").alias("antecedencia_media_confirmacao_dias"))
    return aggs


def distance_aggregates() -> list[Column]:
    """Distance statistics but for the two quantiles."""
    return [
        F.avg("distancia_km").alias("distancia_media_km"),
        F.max("distancia_km").alias("distancia_max_km"),
        F.stddev_samp("distancia_km").alias("distancia_desvio_km"),
    ]


def _per_key(cohort: DataFrame, jobs: DataFrame, blocks: Iterable[Callable[[DataFrame], list[Column]]],
             with_distance: bool = False) -> DataFrame:
    """Aggregate the window jobs per key.

    With the distance block the window jobs, a small part of all, are written and read twice: the
    exact quantiles come from the sketch-and-refine path, which holds no key's values in one task.
    """
    rows = window_jobs(cohort, jobs)
    if not with_distance:
        return rows.groupBy(KEY).agg(*[c for block in blocks for c in block(rows)])
    rows = cut_lineage(rows)
    stats = rows.groupBy(KEY).agg(*[c for block in blocks for c in block(rows)], *distance_aggregates())
    spread = grouped_quantiles(rows, [KEY], "distancia_km", [0.5, 0.9])
    return stats.join(spread, KEY, "left").withColumnsRenamed(
        {"_q0": "distancia_mediana_km", "_q1": "distancia_p90_km"})


def genuine_rating(cohort: DataFrame, jobs: DataFrame) -> DataFrame:
    return _per_key(cohort, jobs, [rating_aggregates])


def window_productivity(cohort: DataFrame, jobs: DataFrame) -> DataFrame:
    return _per_key(cohort, jobs, [productivity_aggregates])


def distance_stats(cohort: DataFrame, jobs: DataFrame) -> DataFrame:
    return _per_key(cohort, jobs, [], with_distance=True)


def conduct_features(cohort: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incident counts by type, delays in minutes and penalties inside the window."""
    minutes = F.col("time_delta") / 60.0
    of_type = lambda t: F.count_if(F.col("type") == t).cast("double")
    return window_incidents(cohort, incidents).groupBy(KEY).agg(
        F.count("incident_id").cast("double").alias("n_incidentes"),
        of_type("no_show").alias("n_no_show"), of_type("delayed").alias("n_atraso"),
        of_type("cancel").alias("n_cancelamento"),
        F.avg(minutes).alias("atraso_medio_min"), F.max(minutes).alias("atraso_max_min"),
        _sum_or_zero(F.col("penalty_amount")).alias("penalidade_total"))


def _with_window_features(spine: DataFrame, cohort: DataFrame, jobs: DataFrame,
                          incidents: DataFrame) -> DataFrame:
    work = _per_key(cohort, jobs, [productivity_aggregates, rating_aggregates], with_distance=True)
    feats = spine.join(work, KEY, "left").join(conduct_features(cohort, incidents), KEY, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ZERO_WHEN_ABSENT if c in feats.columns}
    per_job = lambda c: ratio_or_zero(F.col(c), F.col("n_diarias"))
    return feats.withColumns(filled).withColumns({
        "taxa_no_show": per_job("n_no_show"), "taxa_atraso": per_job("n_atraso"),
        "taxa_cancelamento": per_job("n_cancelamento"), "fracao_preferencial": per_job("n_diarias_pref")})


def window_features(cohort: DataFrame, jobs: DataFrame, incidents: DataFrame) -> DataFrame:
    """All in-window predictors for every cohort member; no activity means zero counts and rates."""
    return _with_window_features(cohort.select(KEY), cohort, jobs, incidents)


def feature_matrix(cohort: DataFrame, jobs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Key, target and every predictor. Only the in-window block needs joins.

    The cohort is read by each block, so pass a written one (``outlast.session.cut_lineage``).
    """
    own = {**profile_columns(cohort), **funnel_columns(cohort), **identity_columns(cohort)}
    reputation = {**reputation_columns(), **service_score_columns(cohort)}
    fixed = cohort.select(
        KEY, "tempo", "evento", *[c.alias(n) for n, c in {**own, **reputation}.items()])
    joined = _with_window_features(fixed, cohort, jobs, incidents)
    lead = [KEY, "tempo", "evento", *own]
    window = [c for c in joined.columns if c not in lead and c not in reputation]
    return joined.select(*lead, *window, *reputation)
