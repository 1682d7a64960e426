"""Statistical comparison of models over folds, on the long (modelo, fold, metrics...) table.

That table has one row per model and fold: every window below sees one fold or one model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.functions.tails import chi2_tail, studentized_range_tail
from outlast.sources.schema import METRICS

# 5 % critical values of the studentised range divided by sqrt(2), by model count.
Q_ALPHA = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850}
LOWER_IS_BETTER = {"ibs"}


def model_names(metrics: DataFrame) -> list[str]:
    return sorted(r["modelo"] for r in metrics.select("modelo").distinct().collect())


def metric_pivot(metrics: DataFrame, metric: str, models: list[str] | None = None) -> DataFrame:
    """fold x model matrix; a (fold, model) pair that occurs twice is an error."""
    models = models or model_names(metrics)
    pairs = metrics.groupBy("fold", "modelo").agg(F.max(metric).alias("value"), F.count("*").alias("n"))
    once = F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate (fold, modelo)")).cast("double"))
    checked = pairs.select("fold", "modelo", once.otherwise(F.col("value")).alias("value"))
    return checked.groupBy("fold").pivot("modelo", models).agg(F.first("value"))


def fold_ranks(metrics: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Rank of each model inside each fold, ties sharing their average rank; 1 is best."""
    value = F.col(metric)
    fold = Window.partitionBy("fold")
    peers = F.count("*").over(Window.partitionBy("fold", metric))
    first = F.rank().over(fold.orderBy(value.desc() if higher_is_better else value.asc()))
    return metrics.select("modelo", "fold", metric, peers.alias("peers"), (first + (peers - 1) / 2).alias("rank"))


def mean_ranks(metrics: DataFrame, metric: str) -> DataFrame:
    ranks = fold_ranks(metrics, metric, metric not in LOWER_IS_BETTER)
    return ranks.groupBy("modelo").agg(F.avg("rank").alias("mean_rank"))


def _shape(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count_distinct("modelo").alias("k"), F.count_distinct("fold").alias("n"))


def friedman(metrics: DataFrame, metric: str, n_models: int | None = None) -> DataFrame:
    """Friedman chi-square with tie correction and its p-value, one row."""
    n_models = n_models or len(model_names(metrics))
    ranks = fold_ranks(metrics, metric)
    k, n = F.lit(float(n_models)), F.col("n")
    # Each of the p members of a tie contributes p^2 - 1; together p^3 - p.
    ties = ranks.agg(F.sum(F.pow("peers", 2) - 1)).scalar()
    sums = ranks.groupBy("modelo").agg(F.sum("rank").alias("r"), F.count("*").cast("double").alias("n"))
    parts = sums.agg(F.sum(F.col("r") * F.col("r")).alias("squares"), F.max("n").alias("n")).withColumn("ties", ties)
    raw = F.col("squares") * 12 / (k * n * (k + 1)) - n * 3 * (k + 1)
    correction = 1 - F.col("ties") / (k * (k * k - 1) * n)
    return parts.select(F.try_divide(raw, correction).alias("statistic")).withColumn(
        "p_value", chi2_tail(F.col("statistic"), n_models - 1))


def nemenyi_q(metrics: DataFrame, metric: str) -> DataFrame:
    """Every ordered pair of models with its rank difference in standard errors.

    The output is the k x k table of the test, k being the number of models.
    """
    ranks = mean_ranks(metrics, metric)
    board = ranks.agg(F.sort_array(F.collect_list(F.struct("modelo", "mean_rank"))).alias("a"))
    pairs = (board.withColumn("x", F.explode("a")).withColumn("y", F.explode("a"))
             .withColumn("_s", _shape(metrics).select(F.struct("*")).scalar()))
    k, n = F.col("_s.k"), F.col("_s.n")
    error = F.sqrt(k * (k + 1) / (n * 6.0))
    return pairs.select(
        F.col("x.modelo").alias("modelo_a"), F.col("y.modelo").alias("modelo_b"),
        (F.abs(F.col("x.mean_rank") - F.col("y.mean_rank")) / error).alias("q"), k.alias("k"))


def nemenyi_p(metrics: DataFrame, metric: str) -> DataFrame:
    """Pairwise p-values from the studentised range with infinite degrees of freedom."""
    pairs = nemenyi_q(metrics, metric)
    return pairs.select("modelo_a", "modelo_b", studentized_range_tail(
        F.col("q") * F.lit(2.0 ** 0.5), F.col("k")).alias("p_value"))


def critical_difference(k: Column, n: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in Q_ALPHA.items() for v in pair])
    known = F.try_element_at(table, k.cast("int"))
    fail = F.raise_error(F.lit("critical distance is tabulated for 2 to 6 models")).cast("double")
    return F.when(known.isNull(), fail).otherwise(known) * F.sqrt(k * (k + 1) / (n * 6.0))


def critical_distance(metrics: DataFrame) -> DataFrame:
    return _shape(metrics).select(
        F.col("k").alias("n_models"), F.col("n").alias("n_folds"),
        critical_difference(F.col("k"), F.col("n")).alias("critical_distance"))


def cd_groups(metrics: DataFrame, metric: str) -> DataFrame:
    """Models not told apart: from the best rank on, a group takes all ranks within the critical
    distance of its first member; the next group starts after it."""
    board = mean_ranks(metrics, metric).agg(
        F.sort_array(F.collect_list(F.struct(F.col("mean_rank").alias("rank"), "modelo"))).alias("a"))
    cd = critical_distance(metrics).select("critical_distance").scalar()
    group = lambda start, end, members: F.struct(
        start.alias("start"), end.alias("end"), members.alias("members"))

    def extend(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = group(last["start"], x["rank"], F.concat(last["members"], F.array(x["modelo"])))
        fresh = group(x["rank"], x["rank"], F.array(x["modelo"]))
        near = F.coalesce(x["rank"] - last["start"] <= F.col("cd"), F.lit(False))
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(fresh)))

    empty = F.array().cast("array<struct<start:double,end:double,members:array<string>>>")
    folded = board.withColumn("cd", cd).select(F.aggregate("a", empty, extend).alias("g"))
    return folded.select(F.posexplode("g").alias("grupo", "g")).select(
        "grupo", "g.start", "g.end", F.array_join("g.members", ",").alias("modelos"),
        (F.col("g.end") > F.col("g.start")).alias("linked"))


@dataclass(frozen=True)
class Comparison:
    summary: DataFrame
    ranks: DataFrame
    nemenyi: DataFrame
    groups: DataFrame


def compare_models(metrics: DataFrame, metric: str = "c_uno", n_models: int | None = None) -> Comparison:
    """Everything the comparison of one metric needs, rounded to four decimals."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    test = friedman(metrics, metric, n_models)
    cd = critical_distance(metrics).select("critical_distance").scalar()
    summary = test.select(
        F.lit(metric).alias("metrica"), F.round("statistic", 4).alias("friedman_estat"),
        F.round("p_value", 4).alias("friedman_p"), F.round(cd, 4).alias("distancia_critica"))
    nemenyi = nemenyi_p(metrics, metric).withColumn("p_value", F.round("p_value", 4))
    return Comparison(summary, mean_ranks(metrics, metric), nemenyi, cd_groups(metrics, metric))


def metric_summary(metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """Mean and sample deviation of each metric per model, four decimals."""
    return metrics.groupBy("modelo").agg(*[
        F.round(f(c), 4).alias(f"{c}_{s}") for c in columns
        for s, f in (("mean", F.avg), ("std", F.stddev_samp))])


def best_model(metrics: DataFrame, metric: str = "c_uno") -> DataFrame:
    """Model with the largest mean metric (ties: first name)."""
    means = metrics.groupBy("modelo").agg(F.avg(metric).alias("mean"))
    return means.orderBy(F.desc("mean"), "modelo").limit(1)
