"""The stages as plans: every table is written and read again."""

import pytest

from outlast.catalog.queries import RULES
from outlast.models import selection as sel
from outlast.plans import study
from outlast.sources.star import star_tables

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    out, tables = str(tmp_path / "study"), star_tables(spark, SMALL)
    summary = study.build_study(tables, RULES, out).first()
    matrix = spark.read.parquet(f"{out}/cohort.parquet")
    assert summary["n_profissionais"] == matrix.count() == 143
    specs = [sel.cox_spec({"alpha": [10.0, 100.0]})]
    metrics = study.train_and_evaluate(matrix, specs, out, n_folds=2, n_iter=2, inner_folds=2)
    assert [r["fold"] for r in metrics.orderBy("fold").collect()] == [0, 1]
    assert spark.read.parquet(f"{out}/comparacao_modelos").first()["c_uno_mean"] is not None
    assert "alpha" in spark.read.parquet(f"{out}/hiperparametros").first()["hiperparametros"]
    assert spark.read.json(f"{out}/execucoes").first()["nome"] == "treino_avaliacao"
    model = study.best_saved_model(spark, out)
    with pytest.raises(ValueError, match="unknown model"):
        study.load_model(spark, out, "other")
    tests = {r["analise"]: r for r in study.stratified_study(matrix, out).collect()}
    assert set(tests) == {"fidelizacao", "bonus"} and all(0 <= r["p_value"] <= 1 for r in tests.values())
    small = matrix.select("tasker_id", "tempo", "evento", "n_diarias", "idade", "pontualidade")
    assert study.interpret_model(model, matrix, out, n_repeats=1).count() == len(matrix.columns) - 3
    assert {r["atributo"] for r in spark.read.parquet(f"{out}/pdp").select("atributo").distinct().collect()} >= {"pontualidade"}
    assert study.mean_uno_c(small, specs, n_folds=2).keys() == {"Cox PH"}


def test_comparison_stage(spark, tmp_path):
    rows = [(m, f, 0.5 + 0.1 * i + 0.01 * f, 0.6 + 0.1 * i - 0.01 * f, 0.7, 0.2 - 0.05 * i) for i, m in enumerate("abc") for f in range(4)]
    from outlast.sources.schema import METRICS_DDL
    from outlast.sources.tables import write_csv

    write_csv(spark.createDataFrame(rows, METRICS_DDL), str(tmp_path / "metricas_por_fold"))
    found = study.compare_study(spark, str(tmp_path))
    assert found.summary.first()["friedman_estat"] == 8.0
    assert {r["modelo"]: r["mean_rank"] for r in found.ranks.collect()} == {"a": 3.0, "b": 2.0, "c": 1.0}
    assert found.nemenyi.count() == 9 and found.groups.count() >= 1


def test_quick_registry_and_sensitivity(spark, tmp_path):
    assert [s.space for s in sel.quick_registry().values()][0] == {"alpha": [1.0]}
    specs = [sel.cox_spec({"alpha": [100.0]})]
    table = study.sensitivity_study(star_tables(spark, SMALL), RULES, [60], [180], str(tmp_path), specs)
    row = table.first()
    assert row["n_profissionais"] == 143 and row["c_uno[Cox PH]"] == round(row["c_uno[Cox PH]"], 4)
