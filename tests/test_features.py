from functools import partial

import math

import numpy as np
import pytest
from frames import at, by_key, enabled, incidents, jobs, taskers
from pyspark.sql import functions as F

from outlast.functions.scalar import age_years, haversine_km, ntz, whole_days
from outlast.functions.text import plain
from outlast.operators import cohort as co
from outlast.operators import features as ft
from outlast.session import cut_lineage

RULES = co.CohortRules(cutoff=str(at(360)), city=None, state=None)
SAO = {"latitude": -23.55, "longitude": -46.63}


def build(spark, work, conduct=(), profile=None, keys=(1,)):
    rows = [enabled(k, **{**SAO, **(profile or {})}) for k in keys]
    work = [{"latitude": -23.5, "longitude": -46.6, **w} for w in work]
    work += [{"tasker_id": k, "job_date": at(299), "work_time": 1e6} for k in keys]  # far outside the window
    t, j, i = taskers(spark, rows), jobs(spark, work), incidents(spark, list(conduct))
    cohort = cut_lineage(co.build_cohort(t, j, i, RULES))
    return cohort, j, i


def test_window_ends_are_inside(spark):
    cohort, j, i = build(spark, [{"tasker_id": 1, "job_date": at(d)} for d in (-0.01, 0, 30, 30.01)])
    r = by_key(ft.feature_matrix(cohort, j, i))[1]
    assert r["n_diarias"] == 2.0
    assert r["tempo_trabalhado_total"] == 0.0 and r["tempo_trabalhado_medio"] is None


def test_one_job_has_no_spread(spark):
    cohort, j, i = build(spark, [{"tasker_id": 1, "job_date": at(1)}])
    r = by_key(ft.distance_stats(cohort, j))[1]
    assert r["distancia_desvio_km"] is None and r["distancia_mediana_km"] == r["distancia_max_km"]


def test_ratings_count_only_real_ones(spark):
    rated = [(5.0, True), (0.0, False), (3.0, None), (4.0, False), (2.0, False)]
    cohort, j, _ = build(spark, [{"tasker_id": 1, "job_date": at(1), "feedback_score": s,
                                  "performed_by_preferential": p} for s, p in rated])
    r = by_key(ft.genuine_rating(cohort, j))[1]
    assert (r["nota_media_diarias"], r["n_diarias_avaliadas"]) == (3.0, 2.0)


def test_no_jobs_and_no_incidents(spark):
    cohort, j, i = build(spark, [])
    r = by_key(ft.window_features(cohort, j, i))[1]
    assert r["n_diarias"] == r["taxa_no_show"] == r["n_incidentes"] == r["bonus_total"] == 0.0
    assert r["remuneracao_total"] is None and r["nota_media_diarias"] is None


def test_conduct_leaves_out_critical_incidents(spark):
    conduct = [{"tasker_id": 1, "incident_at": at(3), "disable_tasker": d, "time_delta": 120.0, "type": t}
               for d, t in ((True, "delayed"), (None, "delayed"), (False, "no_show"))]
    cohort, j, i = build(spark, [{"tasker_id": 1, "job_date": at(1)}] * 2, conduct)
    r = by_key(ft.window_features(cohort, j, i))[1]
    assert (r["n_incidentes"], r["n_atraso"], r["taxa_no_show"], r["atraso_max_min"]) == (2.0, 1.0, 0.5, 2.0)


def test_service_scores(spark):
    cases = {
        "mean": {"score_limpeza": 4.0, "n_aval_limpeza": 3, "score_montagem": 2.0, "n_aval_montagem": 1},
        "gap": {"score_limpeza": 4.0, "n_aval_limpeza": None, "n_aval_montagem": 1},
        "scoreless": {"n_aval_limpeza": 2},
    }
    t = taskers(spark, [enabled(k, **c) for k, c in enumerate(cases.values())])
    work = jobs(spark, [{"tasker_id": k, "job_date": at(299)} for k in range(3)])
    got = by_key(ft.service_scores(co.build_cohort(t, work, incidents(spark, []), RULES)))
    assert (got[0]["nota_media_servicos"], got[0]["nota_max_servico"], got[0]["n_servicos_avaliados"]) == (3.5, 4.0, 2.0)
    assert got[1]["nota_media_servicos"] is None and got[1]["nota_max_servico"] == 4.0
    assert got[2]["nota_media_servicos"] is None and got[2]["nota_max_servico"] == -math.inf


def test_window_features_do_not_see_the_future(spark):
    work = [{"tasker_id": 1, "job_date": at(d), "final_payout": 10.0} for d in (1, 2)]
    later = [{"tasker_id": 1, "job_date": at(31), "final_payout": 99.0}]
    a = by_key(ft.window_features(*build(spark, work)))[1]
    b = by_key(ft.window_features(*build(spark, work + later, [
        {"tasker_id": 1, "incident_at": at(31), "disable_tasker": False}])))[1]
    assert a == b


def test_hot_keys_take_the_distributed_quantiles(spark, monkeypatch):
    """A key far above the limit gets the same numbers from the sketch-and-refine path."""
    spots = np.random.default_rng(0).normal(0, 0.1, (400, 2)).tolist()
    work = [{"tasker_id": 1 + (n % 40 == 0), "job_date": at(n % 30), "latitude": -23.5 + a, "longitude": -46.6 + b}
            for n, (a, b) in enumerate(spots)]
    cohort, j, _ = build(spark, work, keys=(1, 2))
    usual = by_key(ft.distance_stats(cohort, j))
    monkeypatch.setattr(ft, "grouped_quantiles", partial(ft.grouped_quantiles, small_group=50))
    split = by_key(ft.distance_stats(cohort, j))
    for key in (1, 2):
        for c in ("distancia_mediana_km", "distancia_p90_km"):
            assert split[key][c] == pytest.approx(usual[key][c], rel=1e-12)


def test_scalars(spark):
    one = spark.range(1)
    lit = lambda v: F.lit(v).cast("double")
    quarter = one.select(haversine_km(lit(0), lit(0), lit(0), lit(90))).first()[0]
    assert quarter == pytest.approx(6371.0 * math.pi / 2)
    assert one.select(haversine_km(lit(0), lit(None), lit(0), lit(0))).first()[0] is None
    assert one.select(whole_days(ntz("2024-01-01"), ntz("2024-01-02 18:00:00"))).first()[0] == 1
    assert one.select(age_years(ntz("1990-01-01"), ntz("2026-01-01"))).first()[0] == 36.0


def test_plain_text():
    assert plain("  ÇÃO Açaí\n") == "cao acai" and plain(None) == "" and plain("İ") == "i"
