"""Non-parametric survival estimation on the distinct-day table.

Every estimator first reduces the cohort to (stratum, day, n, d). Windows run on that table only:
it has one row per observed day and stratum, a few thousand at most, whatever the cohort size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.functions.ordering import column_quantiles
from outlast.functions.tails import chi2_tail
from outlast.operators.cohort import distinct_days

Z95 = 1.959963984540054


def risk_sets(cohort: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Distinct days with rows ``n``, events ``d`` and the number still ``at_risk``."""
    by = list(by)
    later = Window.partitionBy(*by).orderBy(F.col("tempo").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    return distinct_days(cohort, by).withColumn("at_risk", F.sum("n").over(later))


def _up_to(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("tempo").rowsBetween(Window.unboundedPreceding, 0)


def _product_limit(leaving: Column, at_risk: Column, window) -> Column:
    """Running product of 1 - leaving/at_risk through logarithms; exactly 0 once all have left."""
    extinct = F.max(F.when(leaving >= at_risk, 1).otherwise(0)).over(window)
    logs = F.sum(F.when((leaving < at_risk), F.log1p(-leaving / at_risk)).otherwise(0.0)).over(window)
    return F.when(extinct == 1, F.lit(0.0)).otherwise(F.exp(logs))


def kaplan_meier(cohort: DataFrame, by: Iterable[str] = (), band: bool = False) -> DataFrame:
    """Product-limit survival per distinct day; ``band`` adds the 95 % log-log limits."""
    by = list(by)
    w = _up_to(by)
    d, r = F.col("d"), F.col("at_risk")
    out = risk_sets(cohort, by).withColumn("survival", _product_limit(d, r, w))
    if not band:
        return out
    spread = F.sum(F.when(d < r, d / (r * (r - d).cast("double")))).over(w)
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    width = F.when(inside, F.sqrt("_spread") * Z95 / F.log(F.when(inside, s)))
    edge = lambda sign: F.when(inside, F.pow(s, F.exp(width * sign))).otherwise(s)
    return out.withColumn("_spread", spread).withColumns(
        {"lower": edge(-1), "upper": edge(1)}).drop("_spread")


def censoring_survival(cohort: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Product-limit estimate of staying uncensored; events of a day leave before its censorings."""
    by = list(by)
    censored, exposed = F.col("n") - F.col("d"), F.col("at_risk") - F.col("d")
    steps = risk_sets(cohort, by).withColumns({"_c": censored, "_r": exposed})
    # A day on which everyone at risk has an event leaves nobody exposed and changes nothing.
    extinct = F.max(F.when((F.col("_c") > 0) & (F.col("_c") >= F.col("_r")), 1).otherwise(0)).over(_up_to(by))
    logs = F.sum(F.when((F.col("_c") > 0) & (F.col("_c") < F.col("_r")),
                        F.log1p(-F.col("_c") / F.col("_r"))).otherwise(0.0)).over(_up_to(by))
    return steps.withColumn("g", F.when(extinct == 1, F.lit(0.0)).otherwise(F.exp(logs))).drop("_c", "_r")


def nelson_aalen(cohort: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    by = list(by)
    return risk_sets(cohort, by).withColumn(
        "cum_hazard", F.sum(F.col("d") / F.col("at_risk")).over(_up_to(by)))


# ---- strata ---------------------------------------------------------------------------------

def median_split(df: DataFrame, column: str, labels: tuple[str, str] = ("low", "high")) -> DataFrame:
    """Rows with a positive value, split at their median (the median itself counts as low)."""
    kept = df.where(F.col(column) > 0)
    middle = column_quantiles(kept, [column], [0.5]).select("_q0").scalar()
    return kept.withColumn("stratum", F.when(F.col(column) <= middle, labels[0]).otherwise(labels[1]))


def tercile_split(df: DataFrame, column: str,
                  labels: tuple[str, str, str] = ("low", "mid", "high")) -> DataFrame:
    """Right-closed bins at the exact 1/3 and 2/3 quantiles: equal values share a bin."""
    cuts = column_quantiles(df, [column], [1 / 3, 2 / 3]).select(F.struct("_q0", "_q1")).scalar()
    value = F.col(column)
    return df.where(value.isNotNull()).withColumn("_cuts", cuts).withColumn(
        "stratum", F.when(value <= F.col("_cuts._q0"), labels[0])
        .when(value <= F.col("_cuts._q1"), labels[1]).otherwise(labels[2])).drop("_cuts")


def stratified_kaplan_meier(df: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Kaplan-Meier per stratum together with the stratum size."""
    size = F.sum("n").over(Window.partitionBy(stratum))
    return kaplan_meier(df, [stratum]).withColumn("stratum_size", size)


# ---- log-rank -------------------------------------------------------------------------------

def _day_grid(df: DataFrame, stratum: str, groups: list[str]) -> DataFrame:
    """One row per event day with, per group, its events and its number at risk."""
    later = Window.orderBy(F.col("tempo").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = distinct_days(df, [stratum]).groupBy("tempo").agg(*[
        F.coalesce(F.sum(F.when(F.col(stratum) == g, F.col(c))), F.lit(0)).alias(f"{c}{i}")
        for i, g in enumerate(groups) for c in ("n", "d")])
    at_risk = {f"r{i}": F.sum(f"n{i}").over(later) for i in range(len(groups))}
    total = lambda prefix: sum((F.col(f"{prefix}{i}") for i in range(1, len(groups))), F.col(f"{prefix}0"))
    return counted.withColumns(at_risk).withColumns({"_d": total("d"), "_r": total("r")}).where("_d > 0")


def logrank_parts(df: DataFrame, stratum: str, groups: list[str]) -> DataFrame:
    """One row: observed minus expected events z0.. and their covariances v00, v01, .. for all but
    the last group."""
    free = range(len(groups) - 1)
    d, r = F.col("_d").cast("double"), F.col("_r").cast("double")
    spread = F.when(r > 1, d * (r - d) / (r * r * (r - 1))).otherwise(0.0)
    aggs = [F.sum(F.col(f"d{i}") - d * F.col(f"r{i}") / r).alias(f"z{i}") for i in free]
    for i in free:
        for j in free:
            if j >= i:
                own = F.col(f"r{i}") * ((r if i == j else 0.0) - F.col(f"r{j}"))
                aggs.append(F.sum(spread * own).alias(f"v{i}{j}"))
    return _day_grid(df, stratum, groups).agg(*aggs)


def logrank_test(df: DataFrame, groups: list[str], stratum: str = "stratum") -> DataFrame:
    """Multivariate log-rank test for two or three groups: statistic, degrees of freedom, p-value."""
    parts = logrank_parts(df, stratum, groups)
    if len(groups) == 2:
        statistic = F.try_divide(F.pow("z0", 2), F.col("v00"))
    elif len(groups) == 3:
        z0, z1, a, b, c = (F.col(x) for x in ("z0", "z1", "v00", "v01", "v11"))
        statistic = F.try_divide(z0 * z0 * c - z0 * z1 * b * 2 + z1 * z1 * a, a * c - b * b)
    else:
        raise ValueError("log-rank is provided for two or three groups")
    return parts.select(statistic.alias("chi2"), F.lit(len(groups) - 1).alias("df")).withColumn(
        "p_value", chi2_tail(F.col("chi2"), len(groups) - 1))
