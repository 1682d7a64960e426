import numpy as np
import pytest
from frames import scattered
from pyspark.sql import functions as F

from outlast.functions.hashing import PRIME, poisson_one, shuffle_key, unit_uniform
from outlast.functions.ordering import column_quantiles, grouped_quantiles, number_rows, rank_by_range, slot_of


@pytest.mark.parametrize("small_group", [10, 100_000])
def test_quantiles_match_numpy_with_a_dominant_group_and_ties(spark, small_group):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=6000), 1: rng.integers(0, 3, 300).astype(float), 2: np.array([7.0]),
              3: np.full(500, 2.5)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, None), (9, None)]
    df = scattered(spark.createDataFrame(rows, "g INT, v DOUBLE"))
    probs = [0.05, 1 / 3, 0.5, 0.9]
    got = {r["g"]: [r[f"_q{i}"] for i in range(4)] for r in grouped_quantiles(df, ["g"], "v", probs, small_group).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for g, values in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_bracketed_quantiles_keep_only_a_sliver(spark):
    """Above the limit the refine step must still hit the exact rank."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = column_quantiles(df, ["v"], [0.25, 0.5], small_group=1000).first()
    values = np.arange(200_000) * 7919 % 200_003
    assert [got["_q0"], got["_q1"]] == list(np.quantile(values, [0.25, 0.5]))


def test_numbering_is_a_permutation_in_hash_order(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    ranked = number_rows(scattered(df), shuffle_key(F.col("id"), 7), F.col("id"), ["g"], slices=16)
    again = number_rows(df, shuffle_key(F.col("id"), 7), F.col("id"), ["g"], slices=1)
    a = {r["id"]: (r["g"], r["_rank"]) for r in ranked.collect()}
    assert a == {r["id"]: (r["g"], r["_rank"]) for r in again.collect()}
    for g in (0, 1):
        ranks = sorted(rank for group, rank in a.values() if group == g)
        assert ranks == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("by,slices", [([], 8), (["g"], 4), (["g"], 64)])
def test_ranks_by_range_equal_sorting(spark, by, slices):
    """Ranges are far smaller than the groups, which differ in size; one group is a single row."""
    values = np.unique(np.random.default_rng(2).exponential(50, 300))
    rows = [("a" if i < 250 else "b", float(v)) for i, v in enumerate(values[:-1])] + [("c", float(values[-1]))]
    found = rank_by_range(spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5), by, "v", slices).collect()
    groups = {}
    for g, v in rows:
        groups.setdefault(g if by else "", []).append(v)
    wanted = {v: i for members in groups.values() for i, v in enumerate(sorted(members), 1)}
    assert {r["v"]: r["_rank"] for r in found} == wanted and len(found) == len(rows)


def test_shuffle_key_spreads_neighbours(spark):
    keys = [r[0] for r in spark.range(4000).select(shuffle_key(F.col("id"), 1)).collect()]
    assert len(set(keys)) == 4000
    counts = np.histogram(keys, bins=16, range=(0, PRIME))[0]
    assert counts.min() > 150 and counts.max() < 350
    assert abs(np.corrcoef(keys[:-1], keys[1:])[0, 1]) < 0.1


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(20_000).select(poisson_one(unit_uniform(F.col("id"), F.lit(5))).alias("w")).toPandas()["w"]
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05)


def test_slot_of(spark):
    bounds = F.array(*[F.lit(float(b)) for b in (1, 2, 2, 5, 6, 7, 9)])
    values = [0.0, 1.0, 2.0, 4.9, 9.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert [r[0] for r in df.select(slot_of(F.col("v"), bounds, 7)).collect()] == [0, 1, 3, 3, 7, 7]
