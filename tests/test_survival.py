import math

import numpy as np
import pytest
from frames import survival
from pyspark.sql import functions as F

from outlast.functions.tails import chi2_tail, studentized_range_tail
from outlast.operators import compare as cp
from outlast.operators import survival as sv
from outlast.sources.schema import METRICS_DDL


def column(df, name, order="tempo"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_kaplan_meier_by_hand(spark):
    df = survival(spark, [(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)])
    assert column(sv.kaplan_meier(df), "survival") == pytest.approx([0.8, 0.8, 0.8 / 3, 0.8 / 3])
    assert column(sv.nelson_aalen(df), "cum_hazard") == pytest.approx([0.2, 0.2, 0.2 + 2 / 3, 0.2 + 2 / 3])
    assert column(sv.censoring_survival(df), "g") == pytest.approx([1, 0.75, 0.75, 0])


def test_without_censoring_it_is_the_empirical_curve(spark):
    times = np.random.default_rng(1).integers(0, 20, 200)
    got = sv.kaplan_meier(survival(spark, [(t, 1) for t in times]))
    expected = [1 - np.mean(times <= t) for t in sorted(set(times))]
    assert column(got, "survival") == pytest.approx(expected, abs=1e-12)


def test_band_encloses_the_curve(spark):
    rng = np.random.default_rng(2)
    df = survival(spark, zip(rng.integers(1, 30, 100), rng.random(100) < 0.6))
    for r in sv.kaplan_meier(df, band=True).collect():
        assert r["lower"] <= r["survival"] + 1e-12 and r["survival"] <= r["upper"] + 1e-12


def test_splits_keep_equal_values_together(spark):
    df = spark.createDataFrame([(float(v), 1.0, True) for v in (0, 1, 1, 1, 2, 3)] + [(None, 1.0, True)],
                               "v DOUBLE, tempo DOUBLE, evento BOOLEAN")
    halves = {(r["v"], r["stratum"]) for r in sv.median_split(df, "v").collect()}
    assert halves == {(1.0, "low"), (2.0, "high"), (3.0, "high")}
    thirds = {(r["v"], r["stratum"]) for r in sv.tercile_split(df, "v").collect()}
    assert len({v for v, _ in thirds}) == len(thirds) == 4


def test_logrank_two_groups(spark):
    a, b = [(6, 1), (13, 1), (21, 1), (30, 1), (31, 0)], [(37, 1), (38, 1), (47, 0), (49, 1), (50, 1)]
    df = spark.createDataFrame([(float(t), bool(e), g) for g, rows in (("a", a), ("b", b)) for t, e in rows],
                               "tempo DOUBLE, evento BOOLEAN, stratum STRING")
    r = sv.logrank_test(df, ["a", "b"]).first()
    z, v = 0.0, 0.0
    for t in sorted({t for t, e in a + b if e}):
        n = [sum(x >= t for x, _ in g) for g in (a, b)]
        d = [sum(x == t and e for x, e in g) for g in (a, b)]
        total, dead = sum(n), sum(d)
        z += d[0] - dead * n[0] / total
        v += dead * n[0] * n[1] * (total - dead) / (total ** 2 * (total - 1)) if total > 1 else 0
    assert r["chi2"] == pytest.approx(z * z / v)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(z * z / v / 2)))


def test_tails(spark):
    known = {(3.841458820694124, 1): 0.05, (5.991464547107979, 2): 0.05, (7.814727903251179, 3): 0.05,
             (9.487729036781154, 4): 0.05, (18.420680743952367, 2): 1e-4, (15.136705226623606, 1): 1e-4}
    for (x, df), p in known.items():
        assert spark.range(1).select(chi2_tail(F.lit(x), df)).first()[0] == pytest.approx(p, rel=1e-8)
    tail = lambda rows: [r[0] for r in spark.createDataFrame(rows, "w DOUBLE, k BIGINT").select(
        studentized_range_tail(F.col("w"), F.col("k"))).collect()]
    for p in tail([(q * math.sqrt(2), k) for k, q in cp.Q_ALPHA.items()]):
        assert p == pytest.approx(0.05, abs=2e-4)
    widths = [0.0, 0.01, 1.0, 3.7, 9.0, 25.0]  # of two normals: the range is |N(0, 2)|
    assert tail([(w, 2) for w in widths]) == pytest.approx([math.erfc(w / 2) for w in widths], abs=1e-9)


# ---- comparison of models -------------------------------------------------------------------

def metrics(spark, matrix):
    rows = [(m, f, 0.0, float(v), 0.0, -float(v)) for m, values in matrix.items() for f, v in enumerate(values)]
    return spark.createDataFrame(rows, METRICS_DDL)


def test_comparison_tables(spark):
    m = metrics(spark, {"a": range(10), "b": [x + 0.5 for x in range(10)], "c": [x - 0.5 for x in range(10)]})
    assert cp.critical_distance(m).first()["critical_distance"] == pytest.approx(1.0478, abs=1e-4)
    assert {r["modelo"]: r["mean_rank"] for r in cp.mean_ranks(m, "c_uno").collect()} == {"b": 1, "a": 2, "c": 3}
    assert {r["modelo"]: r["mean_rank"] for r in cp.mean_ranks(m, "ibs").collect()} == {"b": 1, "a": 2, "c": 3}
    r = cp.friedman(m, "c_uno").first()
    assert (r["statistic"], r["p_value"]) == (pytest.approx(20.0), pytest.approx(math.exp(-10)))
    groups = [r["modelos"] for r in cp.cd_groups(m, "c_uno").orderBy("grupo").collect()]
    assert groups == ["b,a", "c"]
    assert cp.best_model(m).first()["modelo"] == "b"


def test_ties_share_ranks_and_duplicates_fail(spark):
    m = metrics(spark, {"a": [1, 1], "b": [1, 0], "c": [0, 0]})
    assert {r["modelo"]: r["mean_rank"] for r in cp.mean_ranks(m, "c_uno").collect()} == {"a": 1.25, "b": 2.0, "c": 2.75}
    with pytest.raises(Exception, match="duplicate"):
        cp.metric_pivot(m.union(m), "c_uno").collect()
