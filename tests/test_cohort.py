from frames import at, by_key, enabled, incidents, jobs, scattered, taskers

from outlast.operators import cohort as co
from outlast.operators.eda import activation_funnel, time_describe

# The effective end of observation is day 300.
RULES = co.CohortRules(cutoff=str(at(360)), purge_days=60, inactivity_days=60, landmark_days=30)


def job(key, day):
    return {"tasker_id": key, "job_date": at(day)}


def outcomes(spark, history, work, removed=()):
    activated = co.cohort_filter(co.lifecycle(taskers(spark, history)), RULES)
    target = co.survival_target(activated, jobs(spark, work), incidents(
        spark, [{"tasker_id": k, "incident_at": at(d), "disable_tasker": v} for k, d, v in removed]), RULES)
    return {k: (r["evento"], r["data_desfecho"], r["tempo"]) for k, r in by_key(target).items()}


def test_outcome_rules(spark):
    disabled = lambda key, day: {"tasker_id": key, "updated_at": at(day), "state": "disabled"}
    history = [enabled(k) for k in range(1, 11)] + [disabled(2, 100), disabled(7, 200)]
    work = [job(4, 240), job(5, 240 + 1 / 24), job(6, 299), job(7, 310), job(8, 30), job(9, 29.9), job(10, 299)]
    removed = [(1, 5, True), (2, 400, True), (10, 5, None)]
    got = outcomes(spark, history, work, removed)
    assert got[1] == (False, at(300), 270.0)  # for cause, no inactivation, no jobs
    assert got[2] == (False, at(100), 70.0)  # for cause, ends at the inactivation
    assert 3 not in got  # activated, never worked
    assert got[4] == (True, at(240), 210.0)  # exactly 60 days idle
    assert got[5] == (False, at(300), 270.0)  # one hour less
    assert got[6] == (False, at(300), 270.0)
    assert got[7] == (True, at(310), 280.0)  # disabled before, last job after the end
    assert got[8] == (True, at(30), 0.0)  # outcome at the landmark
    assert 9 not in got  # outcome before the landmark
    assert got[10][0] is False  # a null flag does not remove anyone


def test_residence_is_matched_without_case_accents_blanks(spark):
    cities = {1: " são PAULO ", 2: "Sao Paulo", 3: None, 4: "São Paulo do Sul", 5: "SÃO PAULO"}
    states = {5: " SP"}
    rows = [enabled(k, city=c, state_uf=states.get(k, "sp")) for k, c in cities.items()]
    kept = co.cohort_filter(co.lifecycle(taskers(spark, rows)), RULES)
    assert sorted(by_key(kept)) == [1, 2]


def test_last_known_value_per_column(spark):
    rows = [enabled(1, 0, plan="a", gender="f"), enabled(1, 2, plan="b"), enabled(1, 2, plan="c"),
            enabled(1, 1, plan="z", gender="m")]
    r = by_key(co.latest_profile(scattered(taskers(spark, rows))))[1]
    assert (r["plan"], r["gender"]) == ("c", "m")  # equal times: higher rev; nulls never win


def test_snapshot_ignores_the_future(spark):
    rows = [enabled(1, 0, score_punctuality=1.0), enabled(1, 10), enabled(1, 31, score_punctuality=9.0)]
    work = [job(1, 299)]
    def snapshot(history):
        t = taskers(spark, history)
        target = co.survival_target(co.cohort_filter(co.lifecycle(t), RULES), jobs(spark, work),
                                    incidents(spark, []), RULES)
        one = by_key(co.asof_snapshot(t, target))[1]["score_punctuality"]
        whole = by_key(co.build_cohort(t, jobs(spark, work), incidents(spark, []), RULES))[1]["score_punctuality"]
        assert one == whole
        return one
    assert snapshot(rows) == 1.0
    assert snapshot(rows[:2] + [enabled(1, 31, score_punctuality=-5.0)]) == 1.0
    assert snapshot(rows + [enabled(1, 30, score_punctuality=4.0)]) == 4.0


def test_profile_as_of_landmark(spark):
    t = taskers(spark, [enabled(1, 0, plan="old"), enabled(1, 100, plan="new")])
    args = (t, jobs(spark, [job(1, 299)]), incidents(spark, []), RULES)
    assert by_key(co.build_cohort(*args))[1]["plan"] == "new"
    assert by_key(co.build_cohort(*args, profile_asof_landmark=True))[1]["plan"] == "old"


def test_empty_cohort_is_typed(spark):
    t = taskers(spark, [{"tasker_id": 1, "updated_at": at(0), "state": "lead"}])
    cohort = co.build_cohort(t, jobs(spark, []), incidents(spark, []), RULES)
    assert cohort.count() == 0 and dict(cohort.dtypes)["tempo"] == "double"
    s = co.cohort_summary(cohort).first()
    assert s["n_profissionais"] == 0 and s["taxa_evento"] is None and s["tempo_mediano"] is None
    assert time_describe(cohort).first()["count"] in (0, None)


def test_grid_equals_single_cohorts(spark):
    history = [enabled(k, k) for k in range(8)]
    work = [job(k, 300 - 15 * k) for k in range(8)]
    args = (taskers(spark, history), jobs(spark, work), incidents(spark, []))
    grid = {(r["W"], r["landmark"]): r for r in co.sensitivity_grid(*args, RULES, [30, 90], [14, 45]).collect()}
    for (w, lm), r in grid.items():
        rules = co.CohortRules(cutoff=RULES.cutoff, inactivity_days=w, landmark_days=lm)
        one = co.cohort_summary(co.build_cohort(*args, rules)).first()
        assert (r["n_profissionais"], r["n_eventos"], r["tempo_mediano"]) == (
            one["n_profissionais"], one["n_eventos"], one["tempo_mediano"])
    assert len(grid) == 4


def test_funnel(spark):
    t = taskers(spark, [enabled(1), enabled(1), {"tasker_id": 2, "updated_at": at(0), "state": "lead"}])
    assert activation_funnel(t).first().asDict() == {"n_profissionais": 2, "n_ativados": 1, "taxa_ativacao": 0.5}
