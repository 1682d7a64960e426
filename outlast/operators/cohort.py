"""From state history to a landmark cohort with a survival target.

Every table is reduced to one row per professional by a map-side combined aggregate before any
join, so the joins below run between de-duplicated keys and cannot be skewed. The single exception,
the as-of read of the history, relies on AQE's skew split (see ``outlast.session``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlast.functions.scalar import is_true, ntz, whole_days
from outlast.functions.text import same_text
from outlast.sources.schema import PROFILE, REPUTATION_INPUTS, STATES

KEY = "tasker_id"


@dataclass(frozen=True)
class CohortRules:
    """Parameters of the cohort. ``city``/``state`` set to None switch the residence filter off."""

    cutoff: str = "2026-01-01"
    purge_days: int = 60
    inactivity_days: int = 60
    landmark_days: int = 30
    city: str | None = "sao paulo"
    state: str | None = "SP"

    @property
    def effective_cutoff(self) -> Column:
        """End of observation. It moves with the purge parameter, not with the inactivity window."""
        return ntz(self.cutoff) - F.make_dt_interval(days=F.lit(self.purge_days))


def latest_known(column: str, order: Iterable[str], when: Column | None = None) -> Column:
    """Last non-null value of ``column`` in the given order (each column on its own), among the rows
    where ``when`` holds."""
    counts = F.col(column).isNotNull()
    counts = counts if when is None else counts & when
    return F.max_by(column, F.when(counts, F.struct(*order))).alias(column)


def _history_order(history: DataFrame) -> list[str]:
    return [c for c in ("updated_at", "rev") if c in history.columns]


def _milestone_columns() -> list[Column]:
    firsts = [F.min(F.when(F.col("state") == s, F.col("updated_at"))).alias(c) for c, s in STATES.items()]
    return [F.min("created_at").alias("criacao_at"), *firsts,
            F.min("current_sign_in_at").alias("primeiro_login_at")]


def _profile_columns(history: DataFrame) -> list[Column]:
    order = _history_order(history)
    return [latest_known(c, order) for c in PROFILE if c in history.columns]


def milestones(history: DataFrame) -> DataFrame:
    """First time in each state, first creation and first login, one row per professional."""
    return history.groupBy(KEY).agg(*_milestone_columns())


def latest_profile(history: DataFrame) -> DataFrame:
    """Most recent non-null value of every profile column that exists."""
    return history.groupBy(KEY).agg(*_profile_columns(history))


def lifecycle(history: DataFrame) -> DataFrame:
    """Milestones and latest profile from one pass over the history."""
    return history.groupBy(KEY).agg(*_milestone_columns(), *_profile_columns(history))


def residence_filter(df: DataFrame, city: str, state: str) -> DataFrame:
    return df.where(same_text(F.col("city"), city) & (F.upper("state_uf") == state.upper()))


def cohort_filter(lifecycles: DataFrame, rules: CohortRules) -> DataFrame:
    """Professionals who activated and, if a residence is set, live there."""
    activated = lifecycles.where(F.col("ativacao_at").isNotNull())
    if rules.city is None:
        return activated
    return residence_filter(activated, rules.city, rules.state)


def last_activity(jobs: DataFrame) -> DataFrame:
    """Last job and number of jobs per professional (the count spots hot keys later on)."""
    return jobs.groupBy(KEY).agg(
        F.max("job_date").alias("ultima_atividade_at"), F.count("*").alias("n_jobs_total"))


def involuntary_keys(incidents: DataFrame) -> DataFrame:
    """Professionals removed for cause: any critical incident, at any date."""
    return incidents.where(is_true(F.col("disable_tasker"))).select(KEY).distinct()


def with_activity(activated: DataFrame, jobs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Attach what the outcome depends on; independent of the landmark and inactivity parameters."""
    critical = involuntary_keys(incidents).withColumn("_critical", F.lit(True))
    return (activated.join(last_activity(jobs), KEY, "left").join(critical, KEY, "left")
            .withColumn("involuntario", is_true(F.col("_critical"))).drop("_critical"))


def outcome_columns(rules: CohortRules, inactivity: Column, landmark_days: Column) -> dict[str, Column]:
    """Event flag, outcome date and landmark as expressions over ``with_activity`` rows.

    The decision is ordered: removed for cause, never worked (no outcome), churned, still active.
    """
    end = rules.effective_cutoff
    gone, last = F.col("inativacao_at"), F.col("ultima_atividade_at")
    churned = (whole_days(last, end) >= inactivity) | is_true(gone <= end)
    voluntary = ~F.col("involuntario") & last.isNotNull()
    outcome = (F.when(F.col("involuntario"), F.least(gone, end))  # least() skips a null date
               .when(last.isNotNull(), F.when(churned, last).otherwise(end)))
    return {
        "evento": voluntary & is_true(churned),
        "data_desfecho": outcome,
        "landmark_at": F.col("ativacao_at") + F.make_dt_interval(days=landmark_days),
    }


def apply_outcome(rows: DataFrame, rules: CohortRules, inactivity: Column,
                  landmark_days: Column) -> DataFrame:
    """Add the target and keep only rows whose outcome is not before the landmark."""
    labelled = rows.withColumns(outcome_columns(rules, inactivity, landmark_days))
    reached = labelled.where(F.col("data_desfecho") >= F.col("landmark_at"))
    return reached.withColumn(
        "tempo", whole_days(F.col("landmark_at"), F.col("data_desfecho")).cast("double"))


def survival_target(activated: DataFrame, jobs: DataFrame, incidents: DataFrame,
                    rules: CohortRules) -> DataFrame:
    """(tasker_id, tempo, evento) and the three dates behind them."""
    rows = with_activity(activated.select(KEY, "ativacao_at", "inativacao_at"), jobs, incidents)
    return apply_outcome(rows, rules, F.lit(rules.inactivity_days), F.lit(rules.landmark_days)).select(
        KEY, "tempo", "evento", "ativacao_at", "landmark_at", "data_desfecho")


def asof_snapshot(history: DataFrame, landmarks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column the last non-null value recorded at or before each key's landmark."""
    columns = [c for c in (columns or REPUTATION_INPUTS) if c in history.columns]
    order = _history_order(history)
    known = history.select(KEY, *dict.fromkeys([*order, *columns])).join(
        landmarks.select(KEY, "landmark_at"), KEY).where(F.col("updated_at") <= F.col("landmark_at"))
    return known.groupBy(KEY).agg(*[latest_known(c, order) for c in columns])


def build_cohort(taskers: DataFrame, jobs: DataFrame, incidents: DataFrame, rules: CohortRules,
                 profile_asof_landmark: bool = False) -> DataFrame:
    """The analysis cohort: target, milestones, profile, and reputation as of the landmark.

    The history is read twice. A narrow pass finds milestones (and the residence, if it is filtered
    on) and decides who is in the cohort; only their rows enter the wide pass that picks the latest
    profile and the reputation known at the landmark. Target columns ride along as grouping columns,
    so no join back is needed.

    The profile is the latest one by default; ``profile_asof_landmark`` reads it, too, as it was
    known at the landmark.
    """
    order = _history_order(taskers)
    residence = [] if rules.city is None else ["city", "state_uf"]
    gates = taskers.groupBy(KEY).agg(*_milestone_columns(), *[latest_known(c, order) for c in residence])
    activated = cohort_filter(gates, rules).drop(*residence)
    target = apply_outcome(with_activity(activated, jobs, incidents), rules,
                           F.lit(rules.inactivity_days), F.lit(rules.landmark_days))
    lead = [KEY, "tempo", "evento", "ativacao_at", "landmark_at", "data_desfecho"]
    fixed = [*lead, *[c for c in gates.columns if c not in lead and c not in residence], "n_jobs_total"]
    profile = [c for c in PROFILE if c in taskers.columns]
    reputation = [c for c in REPUTATION_INPUTS if c in taskers.columns]
    known = F.col("updated_at") <= F.col("landmark_at")
    history = taskers.select(KEY, *dict.fromkeys([*order, *profile, *reputation]))
    return target.select(*fixed).join(history, KEY).groupBy(*fixed).agg(
        *[latest_known(c, order, known if profile_asof_landmark else None) for c in profile],
        *[latest_known(c, order, known) for c in reputation])


def distinct_days(cohort: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Rows and events per distinct survival time: the small table most estimators start from.

    Survival times are whole days, so there are at most as many rows as days observed.
    """
    return cohort.groupBy(*by, "tempo").agg(
        F.count("*").alias("n"), F.count_if("evento").alias("d"))


def summarize(days: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Cohort size, events, censored, event rate, median and longest time from ``distinct_days``."""
    n, d = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0))
    return days.groupBy(*by).agg(
        n.alias("n_profissionais"), d.alias("n_eventos"), (n - d).alias("n_censurados"),
        F.try_divide(d.cast("double"), n.cast("double")).alias("taxa_evento"),
        F.percentile("tempo", F.lit(0.5), F.col("n")).alias("tempo_mediano"),
        F.max("tempo").alias("tempo_max"))


def cohort_summary(cohort: DataFrame) -> DataFrame:
    return summarize(distinct_days(cohort))


def sensitivity_grid(taskers: DataFrame, jobs: DataFrame, incidents: DataFrame, rules: CohortRules,
                     inactivity_days: Iterable[int], landmark_days: Iterable[int]) -> DataFrame:
    """Summary per (W, landmark) pair from one plan: the inputs are aggregated once, the target is
    re-derived per grid point by exploding a literal array, and counting starts on the map side."""
    activated = cohort_filter(lifecycle(taskers), rules)
    rows = with_activity(activated.select(KEY, "ativacao_at", "inativacao_at"), jobs, incidents)
    points = F.array(*[F.struct(F.lit(w).alias("W"), F.lit(lm).alias("landmark"))
                       for w in inactivity_days for lm in landmark_days])
    grid = rows.withColumn("_g", F.explode(points)).select("*", "_g.W", "_g.landmark").drop("_g")
    labelled = apply_outcome(grid, rules, F.col("W"), F.col("landmark"))
    return summarize(distinct_days(labelled, ["W", "landmark"]), ["W", "landmark"])
