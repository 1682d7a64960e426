"""SQL counterparts of the named queries, for an independent engine on the same tables.

Statements are assembled from named common table expressions; each lists the ones it needs.
"""

from __future__ import annotations

import json

from outlast.catalog.queries import IMPUTED, MONEY, RULES
from outlast.sources.schema import CATEGORICAL, METRICS, REPUTATION, REPUTATION_INPUTS, SERVICES, ZERO_WHEN_ABSENT

CUT = "TIMESTAMP '2001-09-02 00:00:00'"
PRIME = 2147483647


def r(expression: str, name: str) -> str:
    digits, nudge = (4, "3.1e-7") if name in MONEY else (6, "3.1e-9")
    return f"round(({expression}) + {nudge}, {digits}) + 0.0 AS {name}"


def rs(*names: str, alias: str = "") -> str:
    return ", ".join(r(alias + n, n) for n in names)


def _score(modulus: int, scale: float) -> str:
    return f"1 + (o_orderkey % {modulus}) / {float(scale)}"


def _coordinate(base: float, number: str) -> str:
    return f"({base} + (({number}) % 1000 - 500) / 4000.0)"



PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], sql: str) -> None:
    PARTS[name] = (needs, sql)


def sql(needs: list[str], body: str, recursive: bool = False) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in ordered) + "\n" + body


# ---- views over the star schema -------------------------------------------------------------

part("taskers", [], f"""
SELECT o_custkey AS tasker_id, o_orderdate AS updated_at, o_orderkey AS rev,
  CASE WHEN o_orderstatus = 'O' THEN 'onboarding' WHEN o_orderstatus = 'P' THEN 'enabled'
       WHEN o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0 THEN 'disabled' ELSE 'suspended' END AS state,
  TIMESTAMP '1995-01-01' - to_days(CAST(o_custkey % 60 AS INTEGER)) AS created_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 8 HOUR END AS current_sign_in_at,
  r_name AS city, 'R' || r_regionkey AS state_uf,
  CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 'masculino' ELSE 'feminino' END AS gender,
  CASE WHEN o_custkey % 12 <> 0 THEN TIMESTAMP '1960-01-01' + to_days(CAST((o_custkey * 37) % 14600 AS INTEGER)) END AS birthdate,
  n_name AS category, c_mktsegment AS plan, o_orderpriority AS indication,
  CASE WHEN o_custkey % 20 <> 0 THEN {_coordinate(-23.55, 'o_custkey * 7919')} END AS latitude,
  CASE WHEN o_custkey % 20 <> 0 THEN {_coordinate(-46.63, 'o_custkey * 104729')} END AS longitude,
  CAST(1 + o_custkey % 5 AS INTEGER) AS n_servicos_oferecidos,
  CASE WHEN o_custkey % 10 < 7 THEN 'approved' WHEN o_custkey % 10 < 9 THEN 'pending' END AS photo_identity_state,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) / 100.0 END AS photo_identity_score,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS photo_identity_checked_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN 1 + o_totalprice * 4 / 500000.0 END AS score_punctuality,
  CASE WHEN o_orderkey % 6 <> 0 THEN {_score(31, 7.5)} END AS score_friendliness,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 67) / 66.0 END AS retention_rate,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 101) / 100.0 ELSE 0.0 END AS preferential_rate,
  CASE WHEN o_orderkey % 2 = 0 THEN {_score(41, 10)} END AS score_limpeza,
  CAST(o_orderkey % 20 AS INTEGER) AS n_aval_limpeza,
  CASE WHEN o_orderkey % 4 = 1 THEN {_score(29, 7)} END AS score_limpeza_express,
  CAST(o_orderkey % 5 AS INTEGER) AS n_aval_limpeza_express,
  CASE WHEN o_orderkey % 5 = 2 THEN {_score(23, 6)} END AS score_limpeza_pesada,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 3 AS INTEGER) END AS n_aval_limpeza_pesada,
  CASE WHEN o_orderkey % 3 = 0 THEN {_score(37, 10)} END AS score_montagem,
  CAST(o_orderkey % 7 AS INTEGER) AS n_aval_montagem,
  CASE WHEN o_orderkey % 7 = 3 THEN {_score(19, 5)} END AS score_passadoria,
  CAST(o_orderkey % 2 AS INTEGER) AS n_aval_passadoria
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")

part("jobs", [], f"""
SELECT o_custkey AS tasker_id, l_orderkey * 10 + l_linenumber AS job_id, l_shipdate AS job_date,
  l_quantity * 10 AS work_time, CAST(l_partkey % 6 AS DOUBLE) AS feedback_score,
  l_extendedprice * (1 - l_discount) AS final_payout,
  {_coordinate(-23.55, 'l_partkey * 31')} AS latitude, {_coordinate(-46.63, 'l_partkey * 17')} AS longitude,
  l_returnflag = 'A' AS preferential, l_linestatus = 'O' AS performed_by_preferential,
  CAST(l_linenumber % 5 AS VARCHAR) AS service, l_suppkey % 2 = 0 AS subscription,
  CASE WHEN l_tax >= 0.06 THEN l_extendedprice * l_tax ELSE 0.0 END AS bonus_payout,
  CASE WHEN l_partkey % 7 <> 0 THEN l_shipdate - to_days(CAST(l_linenumber % 5 AS INTEGER)) END AS confirmed_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

part("incidents", [], """
SELECT o_custkey AS tasker_id, l_orderkey * 10 + l_linenumber AS incident_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'no_show' WHEN 1 THEN 'delayed' ELSE 'cancel' END AS type,
  l_shipdate AS incident_at, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity * 60 ELSE 0.0 END AS time_delta,
  l_extendedprice * l_discount AS penalty_amount,
  l_quantity >= 50 AND l_linenumber = 1 AND l_discount >= 0.09 AS disable_tasker
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")

part("metrics", [], """
SELECT o_orderstatus AS modelo, CAST(o_orderkey % 10 AS INTEGER) AS fold, max(o_totalprice) / 500000 AS c_harrell,
  avg(o_totalprice) / 500000 AS c_uno, min(o_totalprice) / 500000 AS auc_media,
  stddev_samp(o_totalprice) / 500000 AS ibs
FROM orders GROUP BY 1, 2""")

# ---- cohort ---------------------------------------------------------------------------------

MILESTONES = """min(created_at) AS criacao_at,
  min(updated_at) FILTER (WHERE state = 'onboarding') AS onboarding_at,
  min(updated_at) FILTER (WHERE state = 'enabled') AS ativacao_at,
  min(updated_at) FILTER (WHERE state = 'suspended') AS suspensao_at,
  min(updated_at) FILTER (WHERE state = 'disabled') AS inativacao_at,
  min(current_sign_in_at) AS primeiro_login_at"""
PROFILE = ["created_at", "city", "state_uf", "gender", "birthdate", "category", "plan", "indication", "latitude",
           "longitude", "n_servicos_oferecidos", "photo_identity_state", "photo_identity_score",
           "photo_identity_checked_at"]
DOUBLES = {"latitude", "longitude", "photo_identity_score"}


def latest(columns: list[str]) -> str:
    return ", ".join(f"arg_max({c}, struct_pack(u := updated_at, r := rev)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
                     for c in columns)


part("lifecycle", ["taskers"], f"SELECT tasker_id, {MILESTONES}, {latest(PROFILE)} FROM taskers GROUP BY tasker_id")
part("last_job", ["jobs"], """SELECT tasker_id, max(job_date) AS ultima_atividade_at, count(*) AS n_jobs_total
FROM jobs GROUP BY tasker_id""")
part("removed", ["incidents"], "SELECT DISTINCT tasker_id FROM incidents WHERE disable_tasker")


def _target(extra: str, inactivity: str, landmark: str, source: str) -> str:
    return f"""
SELECT * EXCLUDE (event_kind), CAST(date_sub('day', landmark_at, data_desfecho) AS DOUBLE) AS tempo, event_kind = 2 AS evento
FROM (SELECT *, CASE event_kind WHEN 1 THEN least(coalesce(inativacao_at, {CUT}), {CUT})
                     WHEN 2 THEN ultima_atividade_at WHEN 3 THEN {CUT} END AS data_desfecho
      FROM (SELECT l.*, ultima_atividade_at, n_jobs_total, {extra}
              ativacao_at + to_days(CAST({landmark} AS INTEGER)) AS landmark_at,
              CASE WHEN x.tasker_id IS NOT NULL THEN 1 WHEN ultima_atividade_at IS NULL THEN 0
                   WHEN date_sub('day', ultima_atividade_at, {CUT}) >= {inactivity}
                        OR coalesce(inativacao_at <= {CUT}, false) THEN 2 ELSE 3 END AS event_kind
            FROM {source} LEFT JOIN last_job j ON l.tasker_id = j.tasker_id
            LEFT JOIN removed x ON l.tasker_id = x.tasker_id WHERE ativacao_at IS NOT NULL))
WHERE data_desfecho >= landmark_at"""


part("target", ["lifecycle", "last_job", "removed"], _target("", "60", "180", "lifecycle l"))
part("snapshot", ["target", "taskers"], f"""
SELECT t.tasker_id, {latest(REPUTATION_INPUTS)}
FROM taskers t JOIN target c ON t.tasker_id = c.tasker_id WHERE t.updated_at <= c.landmark_at GROUP BY t.tasker_id""".replace(
    "updated_at, r", "t.updated_at, r"))
part("cohort", ["target", "snapshot"], """SELECT t.*, s.* EXCLUDE (tasker_id)
FROM target t LEFT JOIN snapshot s ON t.tasker_id = s.tasker_id""")
part("days", ["target"], """SELECT tempo, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE evento) AS BIGINT) AS d
FROM target GROUP BY tempo""")

SUMMARY = f"""CAST(count(*) AS BIGINT) AS n_profissionais, CAST(count(*) FILTER (WHERE evento) AS BIGINT) AS n_eventos,
  CAST(count(*) FILTER (WHERE NOT evento) AS BIGINT) AS n_censurados,
  {r("avg(CAST(evento AS INTEGER))", "taxa_evento")}, {r("median(tempo)", "tempo_mediano")}, {r("max(tempo)", "tempo_max")}"""

# ---- features -------------------------------------------------------------------------------

SCORE = {s: (f"score_{s}", f"CAST(n_aval_{s} AS DOUBLE)") for s in SERVICES}
WEIGHT = {s: f"CASE WHEN {a} IS NULL THEN 0.0 ELSE {b} END" for s, (a, b) in SCORE.items()}
TOTAL = " + ".join(f"({w})" for w in WEIGHT.values())
POINTS = " + ".join(f"coalesce({SCORE[s][0]} * ({w}), 0.0)" for s, w in WEIGHT.items())
REVIEWED = [f"coalesce({b} > 0, false)" for _, b in SCORE.values()]
BEST = "greatest(" + ", ".join(a for a, _ in SCORE.values()) + ")"
IN_TIME = "photo_identity_checked_at <= landmark_at"

PROFILE_FEATURES = {
    "idade": "round_even(date_sub('day', birthdate, TIMESTAMP '2026-01-01') / 365.25, 1)",
    "genero": "gender", "plano": "plan", "canal_indicacao": "indication",
    "n_servicos_oferecidos": "CAST(n_servicos_oferecidos AS DOUBLE)",
}
FUNNEL = {
    name: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST(greatest(date_sub('day', {a}, {b}), 0) AS DOUBLE) END"
    for name, a, b in (("dias_cad_onb", "criacao_at", "onboarding_at"), ("dias_onb_atv", "onboarding_at", "ativacao_at"),
                       ("dias_cadastro_ativacao", "criacao_at", "ativacao_at"))}
IDENTITY = {
    "dias_ate_verificacao_identidade":
        f"CASE WHEN {IN_TIME} THEN CAST(greatest(date_sub('day', ativacao_at, photo_identity_checked_at), 0) AS DOUBLE) END",
    "identidade_verificada":
        f"CASE WHEN photo_identity_state = 'approved' AND {IN_TIME} THEN 1.0 ELSE 0.0 END",
}
REPUTATION_FEATURES = {new: old for old, new in REPUTATION.items()}
SERVICE_FEATURES = {
    "nota_media_servicos": f"CASE WHEN {TOTAL} > 0 THEN ({POINTS}) / ({TOTAL}) END",
    "n_servicos_avaliados": " + ".join(f"CAST({c} AS DOUBLE)" for c in REVIEWED),
    "nota_max_servico": f"CASE WHEN {' OR '.join(REVIEWED)} THEN coalesce({BEST}, CAST('-inf' AS DOUBLE)) END",
}
TEXTS = {"genero", "plano", "canal_indicacao"}


def project(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" if n in TEXTS else r(e, n) for n, e in columns.items())


def raw(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


part("inside", ["jobs", "cohort"], """
SELECT j.*, 2 * 6371.0 * asin(sqrt(sin(radians(j.latitude - c.latitude) / 2) ** 2
    + cos(radians(c.latitude)) * cos(radians(j.latitude)) * sin(radians(j.longitude - c.longitude) / 2) ** 2)) AS distancia_km,
  CASE WHEN confirmed_at IS NOT NULL THEN CAST(greatest(date_sub('day', confirmed_at, job_date), 0) AS DOUBLE) END
    AS antecedencia_confirmacao_dias
FROM jobs j JOIN cohort c ON j.tasker_id = c.tasker_id AND job_date BETWEEN ativacao_at AND landmark_at""")
PRODUCTIVITY = {
    "n_diarias": "CAST(count(job_id) AS DOUBLE)", "n_diarias_pref": "CAST(sum(CAST(preferential AS INTEGER)) AS DOUBLE)",
    "tempo_trabalhado_total": "coalesce(sum(work_time), 0.0)", "tempo_trabalhado_medio": "avg(work_time)",
    "remuneracao_total": "coalesce(sum(final_payout), 0.0)", "remuneracao_media": "avg(final_payout)",
    "fracao_assinatura": "avg(CAST(subscription AS INTEGER))", "n_tipos_servico": "CAST(count(DISTINCT service) AS DOUBLE)",
    "bonus_total": "coalesce(sum(bonus_payout), 0.0)",
    "antecedencia_media_confirmacao_dias": "avg(antecedencia_confirmacao_dias)",
}
RATED = "FILTER (WHERE performed_by_preferential = false AND feedback_score > 0)"
RATING = {"nota_media_diarias": f"avg(feedback_score) {RATED}",
          "n_diarias_avaliadas": f"CAST(count(feedback_score) {RATED} AS DOUBLE)"}
DISTANCE = {
    "distancia_media_km": "avg(distancia_km)", "distancia_max_km": "max(distancia_km)",
    "distancia_desvio_km": "stddev_samp(distancia_km)", "distancia_mediana_km": "quantile_cont(distancia_km, 0.5)",
    "distancia_p90_km": "quantile_cont(distancia_km, 0.9)",
}
CONDUCT = {
    "n_incidentes": "CAST(count(incident_id) AS DOUBLE)",
    "n_no_show": "CAST(count(*) FILTER (WHERE type = 'no_show') AS DOUBLE)",
    "n_atraso": "CAST(count(*) FILTER (WHERE type = 'delayed') AS DOUBLE)",
    "n_cancelamento": "CAST(count(*) FILTER (WHERE type = 'cancel') AS DOUBLE)",
    "atraso_medio_min": "avg(time_delta / 60.0)", "atraso_max_min": "max(time_delta / 60.0)",
    "penalidade_total": "coalesce(sum(penalty_amount), 0.0)",
}
RATES = {"taxa_no_show": "n_no_show", "taxa_atraso": "n_atraso", "taxa_cancelamento": "n_cancelamento",
         "fracao_preferencial": "n_diarias_pref"}
part("work", ["inside"], f"SELECT tasker_id, {raw({**PRODUCTIVITY, **RATING, **DISTANCE})} FROM inside GROUP BY tasker_id")
part("conduct", ["incidents", "cohort"], f"""
SELECT i.tasker_id, {raw(CONDUCT)} FROM incidents i JOIN cohort c ON i.tasker_id = c.tasker_id
  AND incident_at BETWEEN ativacao_at AND landmark_at WHERE disable_tasker IS DISTINCT FROM true GROUP BY i.tasker_id""")
WINDOW = [*PRODUCTIVITY, *RATING, *DISTANCE, *CONDUCT]
part("filled", ["cohort", "work", "conduct"], "SELECT c.tasker_id, " + ", ".join(
    f"coalesce({n}, 0.0) AS {n}" if n in ZERO_WHEN_ABSENT else n for n in WINDOW) + """
FROM cohort c LEFT JOIN work w ON c.tasker_id = w.tasker_id LEFT JOIN conduct k ON c.tasker_id = k.tasker_id""")
part("window_block", ["filled"], "SELECT *, " + ", ".join(
    f"coalesce({n} / nullif(n_diarias, 0), 0.0) AS {t}" for t, n in RATES.items()) + " FROM filled")
OWN = {**PROFILE_FEATURES, **FUNNEL, **IDENTITY}
LATE = {**REPUTATION_FEATURES, **SERVICE_FEATURES}
part("matrix", ["cohort", "window_block"], f"""
SELECT c.tasker_id, tempo, evento, {raw({**OWN, **LATE})}, w.* EXCLUDE (tasker_id)
FROM cohort c JOIN window_block w ON c.tasker_id = w.tasker_id""")
WINDOW_ALL = [*WINDOW, *RATES]
NUMERIC = [c for c in [*OWN, *WINDOW_ALL, *LATE] if c not in TEXTS]


# ---- folds, preprocessing -------------------------------------------------------------------

def shuffled(seed: int, salt: str = "0") -> str:
    first = f"((((tasker_id + {seed * 7919 + 1} + ({salt}) * 15485863) % {PRIME}) * 48271) % {PRIME})"
    return f"({first} * {first}) % {PRIME}"


def folds(source: str, k: int, by: str = "", seed: int = 42) -> str:
    first = f"(((tasker_id + {seed * 7919 + 1}) % {PRIME}) * 48271) % {PRIME}"
    partition = f"PARTITION BY {by} " if by else ""
    return f"""SELECT * EXCLUDE (h1), CAST((row_number() OVER ({partition}ORDER BY
  (h1 * h1) % {PRIME}, tasker_id) - 1) % {k} AS INTEGER) AS fold
FROM (SELECT *, {first} AS h1 FROM {source})"""


part("folded", ["matrix"], folds("matrix", 3, "evento"))
part("risky", ["target"], "SELECT tasker_id, tempo, evento, round(sin(tasker_id) * 3, 1) AS risk FROM target")
part("risky_folds", ["risky"], folds("risky", 3, "evento"))
part("train_set", ["risky_folds"], "SELECT * FROM risky_folds WHERE fold <> 0")
part("test_set", ["risky_folds"], "SELECT * FROM risky_folds WHERE fold = 0")


def finite(c: str) -> str:
    return f"CASE WHEN abs({c}) < CAST('inf' AS DOUBLE) THEN {c} END"


def long_matrix(columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT tasker_id, fold, '{c}' AS feature, {finite(c)} AS value FROM folded" for c in columns)


part("long_all", ["folded"], long_matrix(NUMERIC))
part("medians", ["long_all"], """SELECT feature, median(value) AS m, count(value) < count(*) AS gaps
FROM long_all WHERE fold <> 0 GROUP BY feature""")
part("imputed", ["long_all", "medians"], """
SELECT tasker_id, fold, l.feature, coalesce(value, m) AS value FROM long_all l JOIN medians s ON l.feature = s.feature
WHERE m IS NOT NULL
UNION ALL SELECT tasker_id, fold, l.feature || '_missing', CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END
FROM long_all l JOIN medians s ON l.feature = s.feature WHERE gaps""")
part("moments", ["imputed"], """SELECT feature, avg(value) AS center, stddev_pop(value) AS spread
FROM imputed WHERE fold <> 0 GROUP BY feature""")
part("scaled", ["imputed", "moments"], """
SELECT tasker_id, i.feature, (value - center) / CASE WHEN spread > 1e-12 * greatest(1.0, abs(center)) THEN spread ELSE 1.0 END
  AS value FROM imputed i JOIN moments m ON i.feature = m.feature""")
part("levels", ["folded"], "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level, count(*) AS n FROM folded WHERE fold <> 0 AND {c} IS NOT NULL GROUP BY {c}"
    for c in CATEGORICAL))
part("modes", ["levels"], "SELECT feature, level AS mode FROM levels QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) = 1")
part("texts", ["folded"], "\nUNION ALL ".join(
    f"SELECT tasker_id, '{c}' AS feature, {c} AS level FROM folded" for c in CATEGORICAL))
part("hot", ["texts", "levels", "modes"], r"""
SELECT tasker_id, t.feature || '_' || regexp_replace(l.level, '\W', '_', 'g') AS feature,
  CASE WHEN coalesce(t.level, mode) = l.level THEN 1.0 ELSE 0.0 END AS value
FROM texts t JOIN modes m ON t.feature = m.feature JOIN levels l ON t.feature = l.feature""")


def widen(source: str, columns: list[str]) -> str:
    cells = ", ".join(r(f"max(value) FILTER (WHERE feature = '{c}')", c) for c in columns)
    return f"SELECT tasker_id, {cells} FROM {source} GROUP BY tasker_id"


# ---- survival -------------------------------------------------------------------------------

def risk_sets(days: str, by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    return f"""SELECT *, CAST(sum(n) OVER ({p}ORDER BY tempo DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_risk FROM {days}"""


def product_limit(d: str, risk: str, by: str = "") -> str:
    w = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY tempo ROWS UNBOUNDED PRECEDING)"
    return f"""CASE WHEN max(CASE WHEN {d} > 0 AND {d} >= {risk} THEN 1 ELSE 0 END) {w} = 1 THEN 0.0
  ELSE exp(sum(CASE WHEN {d} > 0 AND {d} < {risk} THEN ln(1 - ({d}) / CAST({risk} AS DOUBLE)) ELSE 0.0 END) {w}) END"""


part("risk", ["days"], risk_sets("days"))
part("km", ["risk"], f"""SELECT *, {product_limit("d", "at_risk")} AS survival,
  sum(CASE WHEN d < at_risk THEN d / (CAST(at_risk AS DOUBLE) * (at_risk - d)) END)
    OVER (ORDER BY tempo ROWS UNBOUNDED PRECEDING) AS spread FROM risk""")
part("loyal", ["cohort"], """SELECT tempo, evento, CASE WHEN preferential_rate <= median(preferential_rate) OVER ()
  THEN 'low' ELSE 'high' END AS stratum FROM cohort WHERE preferential_rate > 0""")
part("bonus", ["matrix"], """SELECT tempo, evento, CASE WHEN bonus_total <= (SELECT quantile_cont(bonus_total, 1.0 / 3) FROM matrix)
  THEN 'low' WHEN bonus_total <= (SELECT quantile_cont(bonus_total, 2.0 / 3) FROM matrix) THEN 'mid' ELSE 'high' END AS stratum
FROM matrix""")


def stratified_km(source: str) -> str:
    return sql([source], f"""SELECT stratum, tempo, n, d, at_risk, {r(product_limit("d", "at_risk", "stratum"), "survival")},
  CAST(sum(n) OVER (PARTITION BY stratum) AS BIGINT) AS stratum_size
FROM ({risk_sets(f'''(SELECT stratum, tempo, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE evento) AS BIGINT) AS d
  FROM {source} GROUP BY stratum, tempo)''', "stratum")})""")


SIMPSON = 2000  # intervals of the normal integral


def logrank(source: str, groups: list[str]) -> str:
    g = range(len(groups))
    counts = ", ".join(f"count(*) FILTER (WHERE stratum = '{x}') AS n{i}, count(*) FILTER (WHERE stratum = '{x}' AND evento) AS d{i}"
                       for i, x in enumerate(groups))
    at = ", ".join(f"CAST(sum(n{i}) OVER (ORDER BY tempo DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS r{i}" for i in g)
    dd, rr = " + ".join(f"d{i}" for i in g), " + ".join(f"r{i}" for i in g)
    free = range(len(groups) - 1)
    z = ", ".join(f"sum(d{i} - d * r{i} / r) AS z{i}" for i in free)
    v = ", ".join(f"sum(CASE WHEN r > 1 THEN d * (r - d) / (r - 1) * (r{i} / r) * ({1 if i == j else 0} - r{j} / r) ELSE 0.0 END) AS v{i}{j}"
                  for i in free for j in free if j >= i)
    if len(groups) == 2:
        chi2, step = "z0 * z0 / v00", f"sqrt(z0 * z0 / v00) / {SIMPSON}"
        tail = f"""1 - 2 * {step} / 3 / sqrt(2 * pi()) * list_sum(list_transform(range({SIMPSON} + 1), lambda i:
    (CASE WHEN i IN (0, {SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i * {step}, 2) / 2)))"""
    else:
        chi2 = "(z0 * z0 * v11 - 2 * z0 * z1 * v01 + z1 * z1 * v00) / (v00 * v11 - v01 * v01)"
        tail = f"exp(-({chi2}) / 2)"
    columns = f"{r(chi2, 'chi2')}, {len(groups) - 1} AS df" + (f", {r(tail, 'p_value')}" if tail else "")
    return sql([source], f"""SELECT {columns} FROM (SELECT {z}, {v} FROM (SELECT *, CAST({dd} AS DOUBLE) AS d, {rr} AS r FROM
  (SELECT *, {at} FROM (SELECT tempo, {counts} FROM {source} GROUP BY tempo))) WHERE d > 0)""")


# ---- evaluation -----------------------------------------------------------------------------

part("span", ["train_set", "test_set"], """
SELECT greatest(a.f, b.f) AS low, least(a.c, b.c, a.l, b.l) AS tau, b.c AS max_censored FROM
 (SELECT min(tempo) FILTER (WHERE evento) AS f, max(tempo) FILTER (WHERE evento) AS l,
         coalesce(max(tempo) FILTER (WHERE NOT evento), max(tempo)) AS c FROM train_set) a,
 (SELECT min(tempo) FILTER (WHERE evento) AS f, max(tempo) FILTER (WHERE evento) AS l,
         coalesce(max(tempo) FILTER (WHERE NOT evento), max(tempo)) AS c FROM test_set) b""")
part("times", ["span", "test_set"], """
SELECT DISTINCT low, tau, least(greatest(t, low + 0.001), low + 0.95 * (tau - low)) AS t FROM
 (SELECT low, tau, unnest(quantile_cont(tempo, [0.25, 0.5, 0.75])) AS t FROM test_set, span
  WHERE evento AND tempo > low AND tempo < low + 0.95 * (tau - low) GROUP BY low, tau)""")
for _name in ("train", "test"):
    part(f"{_name}_cut", [f"{_name}_set", "span"], f"""SELECT tasker_id, least(tempo, tau) AS tempo,
  evento AND tempo < tau AS evento, risk FROM {_name}_set, span""")
part("train_days", ["train_cut"], """SELECT tempo, count(*) AS n, count(*) FILTER (WHERE evento) AS d FROM train_cut GROUP BY tempo""")
part("censoring", ["train_days"], f"""SELECT tempo, {product_limit("(n - d)", "(at_risk - d)")} AS g FROM ({risk_sets("train_days")})""")
part("weights", ["test_cut", "censoring"], """SELECT t.*, coalesce((SELECT arg_max(g, c.tempo) FROM censoring c WHERE c.tempo <= t.tempo), 1.0) AS g
FROM test_cut t""")
PAIR = "(b.tempo > a.tempo OR (b.tempo = a.tempo AND NOT b.evento))"
part("harrell", ["test_cut"], f"""
SELECT (sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END)) / count(*) AS c_harrell
FROM test_cut a JOIN test_cut b ON a.evento AND {PAIR}""")
part("uno", ["weights", "span"], f"""
SELECT sum((CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / (a.g * a.g)) / sum(1 / (a.g * a.g)) AS c_uno
FROM weights a JOIN test_cut b ON a.evento AND {PAIR} WHERE a.tempo < (SELECT tau FROM span)""")
part("auc", ["weights", "times"], """
SELECT x.t, sum((CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / a.g) / sum(1 / a.g) AS auc
FROM times x JOIN weights a ON a.evento AND a.tempo <= x.t JOIN test_cut b ON b.tempo > x.t GROUP BY x.t""")
part("test_days", ["test_cut"], "SELECT tempo, count(*) AS n, count(*) FILTER (WHERE evento) AS d FROM test_cut GROUP BY tempo")
part("test_km", ["test_days"], f"""SELECT tempo, {product_limit("d", "at_risk")} AS s FROM ({risk_sets("test_days")})""")
part("auc_steps", ["auc", "test_km"], """SELECT t, auc, s, lag(s, 1, 1.0) OVER (ORDER BY t) - s AS fall FROM
 (SELECT t, auc, coalesce((SELECT arg_max(k.s, k.tempo) FROM test_km k WHERE k.tempo <= t), 1.0) AS s FROM auc)""")
part("auc_average", ["auc_steps"], """SELECT CASE WHEN count(*) = 1 THEN max(auc) ELSE sum(auc * fall) / (1 - min(s)) END AS auc_media
FROM auc_steps""")
part("brier", ["weights", "times", "censoring"], """
SELECT t, avg(CASE WHEN evento AND tempo <= t THEN s * s / g WHEN tempo > t THEN (1 - s) * (1 - s) / gt ELSE 0.0 END) AS brier
FROM (SELECT w.*, x.t, exp(-(x.t / 4000) * exp(risk / 3)) AS s,
        coalesce((SELECT arg_max(c.g, c.tempo) FROM censoring c WHERE c.tempo <= x.t), 1.0) AS gt
      FROM weights w, times x) GROUP BY t""")
part("brier_area", ["brier"], """SELECT sum(area) / (max(t) - min(t)) AS ibs FROM (SELECT t,
  (lead(t) OVER (ORDER BY t) - t) * (lead(brier) OVER (ORDER BY t) + brier) / 2 AS area FROM brier)""")

# ---- comparison -----------------------------------------------------------------------------

AVERAGE_RANK = "rank() OVER (PARTITION BY fold ORDER BY {m} {o}) + (count(*) OVER (PARTITION BY fold, {m}) - 1) / 2.0"


def ranks(metric: str, order: str = "DESC") -> str:
    return f"""SELECT modelo, fold, {AVERAGE_RANK.format(m=metric, o=order)} AS rk,
  count(*) OVER (PARTITION BY fold, {metric}) AS peers FROM metrics"""


part("uno_ranks", ["metrics"], ranks("c_uno"))
part("uno_mean_ranks", ["uno_ranks"], "SELECT modelo, avg(rk) AS mean_rank FROM uno_ranks GROUP BY modelo")
part("shape", ["metrics"], "SELECT count(DISTINCT modelo) AS k, count(DISTINCT fold) AS n FROM metrics")
CD = "CASE k WHEN 2 THEN 1.960 WHEN 3 THEN 2.343 WHEN 4 THEN 2.569 WHEN 5 THEN 2.728 WHEN 6 THEN 2.850 END * sqrt(k * (k + 1) / (6.0 * n))"


def friedman(source: str) -> str:
    return f"""SELECT (12.0 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / CAST(k * (k * k - 1) * n AS DOUBLE)) AS statistic
FROM (SELECT sum(total * total) AS ss FROM (SELECT sum(rk) AS total FROM {source} GROUP BY modelo)),
     (SELECT sum(peers * peers - 1) AS ties FROM {source}), shape"""


part("uno_friedman", ["uno_ranks", "shape"], friedman("uno_ranks"))
part("ibs_ranks", ["metrics"], ranks("ibs"))
part("ibs_friedman", ["ibs_ranks", "shape"], friedman("ibs_ranks"))
part("ordered_ranks", ["uno_mean_ranks"], """SELECT modelo, mean_rank, row_number() OVER (ORDER BY mean_rank, modelo) AS i
FROM uno_mean_ranks""")
part("walk", ["ordered_ranks", "shape"], f"""
SELECT i, modelo, mean_rank, mean_rank AS start, 0 AS grupo FROM ordered_ranks WHERE i = 1
UNION ALL SELECT o.i, o.modelo, o.mean_rank, CASE WHEN o.mean_rank - w.start <= {CD} THEN w.start ELSE o.mean_rank END,
  CASE WHEN o.mean_rank - w.start <= {CD} THEN w.grupo ELSE w.grupo + 1 END
FROM walk w JOIN ordered_ranks o ON o.i = w.i + 1, shape""")

RISK = "coalesce(pontualidade, 0.0) * coalesce(taxa_preferencial, 0.0) - coalesce(n_diarias, 0.0) * 0.25"
part("importance_like", ["matrix"], "\nUNION ALL ".join(
    f"SELECT '{c}' AS atributo, avg({c}) AS m FROM matrix" for c in ("pontualidade", "simpatia", "n_diarias", "idade", "taxa_preferencial")))


def _melted(source: str) -> str:
    return f"SELECT tasker_id, feature, {r('value', 'value')} FROM {source}"


# ---- a regression stump on the residuals of a zero score, cuts at 32 quantiles ---

part("stump_residuals", ["folded"], """
SELECT tasker_id, CAST(evento AS INTEGER) - h AS residual FROM folded f JOIN (
  SELECT tempo, sum(d / n) OVER (ORDER BY tempo ROWS UNBOUNDED PRECEDING) AS h FROM (
    SELECT tempo, d, CAST(sum(n) OVER (ORDER BY tempo DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS n FROM (
      SELECT tempo, count(*) FILTER (WHERE evento) AS d, count(*) AS n FROM folded WHERE fold <> 0 GROUP BY tempo))) y
ON f.tempo = y.tempo WHERE fold <> 0""")
part("stump_values", ["imputed", "hot", "stump_residuals"], """
SELECT feature, value, count(*) AS n, sum(residual) AS s
FROM (SELECT tasker_id, feature, value FROM imputed WHERE fold <> 0 UNION ALL SELECT tasker_id, feature, value FROM hot) v
JOIN stump_residuals r ON r.tasker_id = v.tasker_id GROUP BY feature, value""")
part("stump_cuts", ["stump_values"], """
SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS na, sum(s) OVER (PARTITION BY feature) AS sa
FROM stump_values WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)""")

# ---- cuts of a column by the log-rank statistic: every distinct value against every event day ---

part("cut_rows", ["long_all", "target"], f"""
SELECT feature, CASE WHEN feature IN ({", ".join(f"'{c}'" for c in sorted(MONEY))})
  THEN round(value + 3.1e-7, 4) ELSE round(value + 3.1e-9, 6) END AS value, tempo, evento
FROM long_all l JOIN target t ON l.tasker_id = t.tasker_id WHERE value IS NOT NULL""")
part("cut_days", ["cut_rows"], """
SELECT m.feature, day, any_value(dead) AS dead, CAST(count(*) AS DOUBLE) AS risk
FROM (SELECT feature, tempo AS day, count(*) AS dead FROM cut_rows WHERE evento GROUP BY feature, tempo) m
JOIN cut_rows s ON s.feature = m.feature AND s.tempo >= day GROUP BY m.feature, day""")
part("cut_sizes", ["cut_rows"], "SELECT feature, value, count(*) AS n FROM cut_rows GROUP BY feature, value")
part("cut_cells", ["cut_rows", "cut_days", "cut_sizes"], """
SELECT z.feature, z.value, day, any_value(dead) AS dead, any_value(risk) AS risk, count(s.tempo) AS here,
  count(*) FILTER (WHERE s.tempo = day AND s.evento) AS fell
FROM cut_sizes z JOIN cut_days t ON t.feature = z.feature
LEFT JOIN cut_rows s ON s.feature = z.feature AND s.value = z.value AND s.tempo >= day GROUP BY z.feature, z.value, day""")
part("cut_upto", ["cut_cells"], """SELECT *, sum(here) OVER w AS l, sum(fell) OVER w AS e FROM cut_cells
WINDOW w AS (PARTITION BY feature, day ORDER BY value)""")
part("cut_tests", ["cut_upto"], """SELECT feature, value, sum(e - dead * l / risk) AS z,
  sum(CASE WHEN risk > 1 THEN dead * (risk - dead) / (risk - 1) * (l / risk) * (1 - l / risk) END) AS v
FROM cut_upto GROUP BY feature, value""")
part("cut_counts", ["cut_sizes"], """SELECT feature, value, sum(n) OVER (PARTITION BY feature ORDER BY value) AS before,
  sum(n) OVER (PARTITION BY feature) AS every FROM cut_sizes""")


def oracle_statements() -> dict[str, str]:
    cohort_times = ["ativacao_at", "landmark_at", "data_desfecho", "criacao_at", "onboarding_at", "suspensao_at",
                    "inativacao_at", "primeiro_login_at"]
    profile = ", ".join(r(c, c) if c in DOUBLES else c for c in PROFILE)
    reputation = ", ".join(r(c, c) if not c.startswith("n_aval") else f"CAST({c} AS DOUBLE) AS {c}" for c in REPUTATION_INPUTS)
    q: dict[str, str] = {}
    q["csv_roundtrip"] = sql(["metrics"], f"SELECT modelo, fold, {rs(*METRICS)} FROM metrics")
    q["table_counts"] = sql(["taskers", "jobs", "incidents"], "\nUNION ALL ".join(
        f"SELECT '{t}' AS tabela, CAST(count(*) AS BIGINT) AS linhas FROM {t}" for t in ("taskers", "jobs", "incidents")))
    labels = ["Profissionais", "Eventos (churn)", "Censurados", "Taxa de evento", "Tempo mediano (dias)",
              "Tempo máximo (dias)", "Atributos preditores"]
    values = ["CAST(count(*) AS VARCHAR)", "CAST(count(*) FILTER (WHERE evento) AS VARCHAR)",
              "CAST(count(*) FILTER (WHERE NOT evento) AS VARCHAR)",
              "printf('%.1f%%', 100 * avg(CAST(evento AS INTEGER)))", "printf('%.0f', round_even(median(tempo), 0))",
              "printf('%.0f', max(tempo))", f"CAST({len(NUMERIC) + len(TEXTS)} + 0 * count(*) AS VARCHAR)"]
    q["descriptive_table"] = sql(["target"], "\nUNION ALL ".join(
        f"SELECT {i} AS ordem, '{a}' AS indicador, {v} AS valor FROM target" for i, (a, v) in enumerate(zip(labels, values))))
    q["milestones"] = sql(["taskers"], f"SELECT tasker_id, {MILESTONES} FROM taskers GROUP BY tasker_id")
    q["latest_profile"] = sql(["lifecycle"], f"SELECT tasker_id, {profile} FROM lifecycle")
    blanks = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
    plain = lambda c: f"trim(strip_accents(lower({c})), {blanks})"
    q["normalize_text_documents"] = f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT doc_id, {plain('text')} AS t FROM documents)"""
    q["normalize_text_regions"] = f"SELECT r_regionkey, {plain('r_name')} AS name FROM region"
    q["cohort_filter"] = sql(["lifecycle"], """SELECT tasker_id, ativacao_at, city, state_uf FROM lifecycle
WHERE ativacao_at IS NOT NULL AND strip_accents(lower(trim(city))) = 'middle east' AND upper(state_uf) = 'R4'""")
    q["last_activity"] = sql(["last_job"], "SELECT * FROM last_job")
    q["involuntary_keys"] = sql(["removed"], "SELECT tasker_id FROM removed")
    q["survival_target"] = sql(["target"], "SELECT tasker_id, tempo, evento, ativacao_at, landmark_at, data_desfecho FROM target")
    q["asof_snapshot"] = sql(["snapshot"], f"SELECT tasker_id, {reputation} FROM snapshot")
    q["cohort"] = sql(["cohort"], f"""SELECT tasker_id, {r('tempo', 'tempo')}, evento, {', '.join(cohort_times)},
  {profile}, n_jobs_total, {reputation} FROM cohort""")
    q["cohort_summary"] = sql(["target"], f"SELECT {SUMMARY} FROM target")
    q["cohort_summary_residents"] = sql(["target"], f"""SELECT {SUMMARY} FROM target
WHERE lower(city) = 'middle east' AND upper(state_uf) = 'R4'""")
    grid = "lifecycle l, (SELECT unnest([30, 60, 90]) AS w) gw, (SELECT unnest([90, 180, 270]) AS lm) gl"
    q["sensitivity_grid"] = sql(["lifecycle", "last_job", "removed"], f"""
SELECT CAST(w AS INTEGER) AS W, CAST(lm AS INTEGER) AS landmark, {SUMMARY}
FROM ({_target("w, lm,", "w", "lm", "(SELECT l.*, w, lm FROM " + grid + ") l")}) GROUP BY w, lm""")
    q["time_describe"] = sql(["target"], f"""SELECT {r("round(avg(CAST(evento AS INTEGER)), 3)", "taxa_evento")},
  CAST(count(*) AS BIGINT) AS count, {r("avg(tempo)", "mean")}, {r("stddev_samp(tempo)", "std")}, {r("min(tempo)", "min")},
  {r("quantile_cont(tempo, 0.25)", "p25")}, {r("quantile_cont(tempo, 0.5)", "p50")}, {r("quantile_cont(tempo, 0.75)", "p75")},
  {r("max(tempo)", "max")} FROM target""")
    q["activation_funnel"] = sql(["taskers"], f"""SELECT CAST(n AS BIGINT) AS n_profissionais, CAST(a AS BIGINT) AS n_ativados,
  {r("a / n", "taxa_ativacao")} FROM (SELECT CAST(count(DISTINCT tasker_id) AS DOUBLE) AS n,
  CAST(count(DISTINCT CASE WHEN state = 'enabled' THEN tasker_id END) AS DOUBLE) AS a FROM taskers)""")

    km = """2 * 6371.0 * asin(sqrt(sin(radians(j.latitude - h.latitude) / 2) ** 2
  + cos(radians(h.latitude)) * cos(radians(j.latitude)) * sin(radians(j.longitude - h.longitude) / 2) ** 2))"""
    q["haversine_distance"] = sql(["jobs", "lifecycle"], f"""SELECT j.tasker_id, job_id, {r(km, 'km')}
FROM jobs j JOIN lifecycle h ON j.tasker_id = h.tasker_id""")
    q["age_in_years"] = sql(["lifecycle"], f"SELECT tasker_id, {r(PROFILE_FEATURES['idade'], 'idade')} FROM lifecycle")
    for name, columns in (("profile_features", PROFILE_FEATURES), ("funnel_intervals", FUNNEL),
                          ("identity_features", IDENTITY), ("reputation_features", REPUTATION_FEATURES),
                          ("service_scores", SERVICE_FEATURES)):
        q[name] = sql(["cohort"], f"SELECT tasker_id, {project(columns)} FROM cohort")
    q["window_jobs"] = sql(["inside"], f"""SELECT tasker_id, job_id, job_date, {rs('final_payout', 'distancia_km',
        'antecedencia_confirmacao_dias')} FROM inside""")
    for name, columns in (("window_productivity", PRODUCTIVITY), ("genuine_rating", RATING), ("distance_stats", DISTANCE)):
        q[name] = sql(["work"], f"SELECT tasker_id, {rs(*columns)} FROM work")
    q["conduct_features"] = sql(["conduct"], f"SELECT tasker_id, {rs(*CONDUCT)} FROM conduct")
    q["window_features"] = sql(["window_block"], f"SELECT tasker_id, {rs(*WINDOW_ALL)} FROM window_block")
    q["feature_matrix"] = sql(["matrix"], f"SELECT tasker_id, {r('tempo', 'tempo')}, evento, {rs(*NUMERIC)}, {', '.join(CATEGORICAL)} FROM matrix")

    flagged = [f"{c}_missing" for c in IMPUTED]
    q["impute_median"] = sql(["imputed"], widen("imputed", IMPUTED + flagged))
    q["zscore"] = sql(["scaled"], widen("scaled", IMPUTED + flagged))
    q["impute_mode"] = sql(["folded", "modes"], "SELECT tasker_id, " + ", ".join(
        f"coalesce({c}, (SELECT mode FROM modes WHERE feature = '{c}')) AS {c}" for c in CATEGORICAL) + " FROM folded")
    q["one_hot"] = sql(["hot"], _melted("hot"))
    q["preprocess_matrix"] = sql(["scaled", "hot"], _melted("scaled") + "\nUNION ALL " + _melted("hot"))

    q["kaplan_meier"] = sql(["km"], f"SELECT tempo, n, d, at_risk, {rs('survival')} FROM km")
    edge = lambda sign: f"CASE WHEN survival > 0 AND survival < 1 THEN pow(survival, exp({sign} 1.959963984540054 * sqrt(spread) / ln(survival))) ELSE survival END"
    q["kaplan_meier_ci"] = sql(["km"], f"""SELECT tempo, n, d, at_risk, {rs('survival')}, {r(edge('-'), 'lower')}, {r(edge('+'), 'upper')} FROM km""")
    q["censoring_km"] = sql(["risk"], f"""SELECT tempo, n, d, at_risk, {r(product_limit('(n - d)', '(at_risk - d)'), 'g')} FROM risk""")
    q["nelson_aalen"] = sql(["risk"], f"""SELECT tempo, n, d, at_risk,
  {r('sum(d / CAST(at_risk AS DOUBLE)) OVER (ORDER BY tempo ROWS UNBOUNDED PRECEDING)', 'cum_hazard')} FROM risk""")
    q["km_by_median_split"] = stratified_km("loyal")
    q["km_by_tercile"] = stratified_km("bonus")
    q["logrank_2_p"] = logrank("loyal", ["low", "high"])
    q["logrank_2"] = f"SELECT chi2, df FROM ({q['logrank_2_p']})"
    q["logrank_3"] = logrank("bonus", ["low", "mid", "high"])

    q["eval_horizon"] = sql(["span"], "SELECT low, tau, max_censored FROM span")
    q["eval_times"] = sql(["times"], f"SELECT low, tau, {rs('t')} FROM times")
    q["admin_censor"] = sql(["test_cut"], "SELECT tasker_id, tempo, evento FROM test_cut")
    pairs = f"FROM risky a JOIN risky b ON a.evento AND {PAIR}"
    wins = "CAST(count(*) FILTER (WHERE a.risk > b.risk) AS BIGINT)"
    even = "CAST(count(*) FILTER (WHERE a.risk = b.risk) AS BIGINT)"
    q["harrell_c"] = sql(["risky"], f"""SELECT CAST(count(*) AS BIGINT) AS comparable, {wins} AS concordant, {even} AS tied,
  {r(f"({wins} + {even} / 2.0) / count(*)", "c_harrell")} {pairs}""")
    quartered = "(SELECT * REPLACE (tempo + tasker_id % 4 / 4.0 AS tempo) FROM risky)"
    q["harrell_c_fractional"] = sql(["risky"], f"""SELECT CAST(count(*) AS BIGINT) AS comparable, {wins} AS concordant, {even} AS tied,
  {r(f"({wins} + {even} / 2.0) / count(*)", "c_harrell")} FROM {quartered} a JOIN {quartered} b ON a.evento AND {PAIR}""")
    q["pair_counts"] = sql(["risky"], f"""SELECT e.tempo, coalesce(comparable, 0) AS comparable, coalesce(concordant, 0) AS concordant,
  coalesce(tied, 0) AS tied FROM (SELECT DISTINCT tempo FROM risky WHERE evento) e LEFT JOIN (
  SELECT a.tempo, CAST(count(*) AS BIGINT) AS comparable, {wins} AS concordant, {even} AS tied {pairs} GROUP BY a.tempo) p
  ON e.tempo = p.tempo""")
    q["uno_c"] = sql(["uno"], f"SELECT {rs('c_uno')} FROM uno")
    q["auc_t"] = sql(["auc"], f"SELECT {rs('t', 'auc')} FROM auc")
    q["auc_mean"] = sql(["auc_average"], f"SELECT {rs('auc_media')} FROM auc_average")
    q["brier_t"] = sql(["brier"], f"SELECT {rs('t', 'brier')} FROM brier")
    q["ibs"] = sql(["brier_area"], f"SELECT {rs('ibs')} FROM brier_area")
    q["evaluate"] = sql(["harrell", "uno", "auc_average", "brier_area"],
                        f"SELECT {rs(*METRICS)} FROM harrell, uno, auc_average, brier_area")

    q["cox_partial_loglik_at_zero"] = sql(["risk"], f"SELECT {r('sum(-d * ln(at_risk))', 'loglik')} FROM risk WHERE d > 0")
    q["cox_gradient_formula"] = sql(["risky"], f"""
SELECT tasker_id, {r('CAST(evento AS INTEGER) - exp(risk / 3) * h', 'residual')} FROM risky x JOIN (
  SELECT tempo, sum(d / s) OVER (ORDER BY tempo ROWS UNBOUNDED PRECEDING) AS h FROM (
    SELECT tempo, d, sum(e) OVER (ORDER BY tempo DESC ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT tempo, count(*) FILTER (WHERE evento) AS d, sum(exp(risk / 3)) AS e FROM risky GROUP BY tempo))) y
ON x.tempo = y.tempo""")
    q["gbm_first_stump"] = sql(["stump_cuts"], f"""
SELECT {r('least(sl / nl, (sa - sl) / (na - nl))', 'low')}, {r('greatest(sl / nl, (sa - sl) / (na - nl))', 'high')}
FROM stump_cuts WHERE nl < na AND least(31, floor(nl * 32.0 / na)) > (nl - n) * 32.0 / na
ORDER BY round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na, 9) DESC LIMIT 1""")
    q["logrank_best_cuts"] = sql(["cut_tests", "cut_counts"], """
SELECT feature, round(max(round(z * z / v, 8)) + 3.1e-9, 6) AS score
FROM cut_tests JOIN cut_counts USING (feature, value)
WHERE v > 1e-12 AND before >= 15 AND every - before >= 15 GROUP BY feature""")
    q["stratified_folds"] = sql(["target"], f"SELECT tasker_id, evento, fold FROM ({folds('target', 10, 'evento')})")
    q["unstratified_folds"] = sql(["target"], f"SELECT tasker_id, fold FROM ({folds('target', 3)})")

    q["metric_summary"] = sql(["metrics"], "SELECT modelo, " + ", ".join(
        f"round({f}({m}), 4) AS {m}_{s}" for m in METRICS for s, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM metrics GROUP BY modelo")
    q["best_model"] = sql(["metrics"], f"SELECT modelo, {r('avg(c_uno)', 'mean')} FROM metrics GROUP BY modelo ORDER BY avg(c_uno) DESC, modelo LIMIT 1")
    q["metric_pivot"] = sql(["metrics"], "SELECT fold, " + ", ".join(
        r(f"max(c_uno) FILTER (WHERE modelo = '{m}')", m) for m in "FOP") + " FROM metrics GROUP BY fold")
    q["friedman"] = sql(["uno_friedman"], f"SELECT {rs('statistic')}, {r('exp(-statistic / 2)', 'p_value')} FROM uno_friedman")
    q["mean_ranks"] = sql(["metrics"], "\nUNION ALL ".join(
        f"SELECT modelo, {r('avg(rk)', 'mean_rank')}, '{m}' AS metrica FROM ({ranks(m, 'ASC' if m == 'ibs' else 'DESC')}) GROUP BY modelo"
        for m in METRICS))
    q["nemenyi_q"] = sql(["uno_mean_ranks", "shape"], f"""SELECT a.modelo AS modelo_a, b.modelo AS modelo_b,
  {r("abs(a.mean_rank - b.mean_rank) / sqrt(k * (k + 1) / (6.0 * n))", "q")} FROM uno_mean_ranks a, uno_mean_ranks b, shape""")
    # The same integral by window sums: the difference of two normal distributions, then the area, both by Simpson's rule.
    phi = lambda z: f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi())"
    slope = lambda z: f"({phi(z)} - {phi(z + ' - w')})"
    q["nemenyi_p"] = sql(["uno_mean_ranks", "shape"], f"""SELECT modelo_a, modelo_b, {r("greatest(0.0, least(1.0, 1 - any_value(k) * sum(part) * any_value(h) / 3))", "p_value")}
FROM (SELECT modelo_a, modelo_b, k, h, CASE WHEN i IN (0, 2000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * {phi("z")}
    * pow(greatest(coalesce(sum(rise) OVER (PARTITION BY modelo_a, modelo_b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0), k - 1) AS part
  FROM (SELECT *, ({slope("z")} + 4 * {slope("z + h / 2")} + {slope("z + h")}) * h / 6 AS rise
    FROM (SELECT *, i * h - 8.0 AS z FROM (SELECT *, (w + 16.0) / 2000 AS h FROM (
      SELECT a.modelo AS modelo_a, b.modelo AS modelo_b, k, unnest(range(2001)) AS i,
        abs(a.mean_rank - b.mean_rank) / sqrt(k * (k + 1) / (6.0 * n)) * sqrt(2) AS w
      FROM uno_mean_ranks a, uno_mean_ranks b, shape)))))
GROUP BY modelo_a, modelo_b""")
    q["critical_distance"] = sql(["shape"], f"""SELECT CAST(k AS BIGINT) AS n_models, CAST(n AS BIGINT) AS n_folds,
  {r(CD, 'critical_distance')} FROM shape""")
    q["cd_groups"] = sql(["walk"], f"""SELECT grupo, {r('min(start)', 'start')}, {r('max(mean_rank)', '"end"')},
  string_agg(modelo, ',' ORDER BY i) AS modelos, max(mean_rank) > min(start) AS linked FROM walk GROUP BY grupo""", recursive=True)
    q["compare_models"] = sql(["ibs_friedman", "shape"], f"""SELECT 'ibs' AS metrica, round(statistic, 4) AS friedman_estat,
  round(exp(-statistic / 2), 4) AS friedman_p, round({CD}, 4) AS distancia_critica FROM ibs_friedman, shape""")

    q["hash_sample"] = sql(["target"], f"""SELECT tasker_id, tempo, evento FROM target
ORDER BY {shuffled(42)}, tasker_id LIMIT 100""")
    # Doubles below 0.001 are written with an exponent.
    number = lambda v: f"""CASE WHEN {v} > 0 AND {v} < 0.001 THEN CAST(round({v} * 10000) AS INTEGER) || '.0E-4'
  ELSE CAST({v} AS VARCHAR) END"""
    pieces = " || ".join(["'{\"modelo\":\"' || modelo || '\"'"] + [
        f"',\"{m}_{s}\":' || {number(f'round({f}({m}), 4)')}" for m in METRICS for s, f in (("mean", "avg"), ("std", "stddev_samp"))]
        + ["'}'"])
    config = json.dumps({"rules": vars(RULES)}, default=str, ensure_ascii=False, sort_keys=True).replace("'", "''")
    q["run_log"] = sql(["metrics"], f"""SELECT 'treino_avaliacao' AS nome, '{config}' AS config,
  '[' || string_agg(piece, ',' ORDER BY modelo) || ']' AS metricas FROM (SELECT modelo, {pieces} AS piece FROM metrics GROUP BY modelo)""")
    swapped = ["pontualidade", "taxa_preferencial", "n_diarias"]
    sent = ", ".join(f"{{'atributo': '{f}', 'place': {i}, 'donated': {'NULL' if f in CATEGORICAL else f}::DOUBLE}}"
                     for i, f in enumerate(sorted([*NUMERIC, *CATEGORICAL])))
    moved = """SELECT v.atributo, v.place * 10 + rep + 1 AS salt, rep, v.donated AS donated, rk - 1 AS p FROM
    (SELECT rk, unnest([""" + sent + """]) AS v FROM takers), (SELECT unnest(range(10)) AS rep)"""
    moved = f"SELECT moved.*, n FROM ({moved}) moved, size"
    for i in range(24):
        hashed = lambda key: shuffled(42, f"salt * 24 + {i}").replace("tasker_id", key)
        moved = f"""SELECT * EXCLUDE (p, m), CASE WHEN ({hashed('greatest(p, m)')}) % 2 = 1 THEN m ELSE p END AS p FROM
    (SELECT *, ((({hashed('-1')}) - p) % n + n) % n AS m FROM ({moved}))"""
    mixed = RISK
    for f in swapped:
        mixed = mixed.replace(f"coalesce({f},", f"coalesce(CASE WHEN atributo = '{f}' THEN donated ELSE {f} END,")
    c = lambda of: f"""(SELECT {of} sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / count(*) AS c"""
    q["permutation_importance"] = sql(["matrix"], f"""
SELECT atributo, {r('avg(plain - c)', 'importancia_media')}, {r('stddev_pop(plain - c)', 'importancia_desvio')} FROM (
  WITH takers AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {shuffled(42)}, tasker_id) AS rk FROM matrix),
  size AS (SELECT count(*) AS n FROM takers),
  scored AS (SELECT atributo, rep, tempo, evento, {mixed} AS risk FROM takers JOIN ({moved}) sent ON rk = sent.p + 1),
  base AS (SELECT tempo, evento, {RISK} AS risk FROM matrix)
  SELECT * FROM {c('a.atributo, a.rep,')} FROM scored a JOIN scored b ON a.atributo = b.atributo AND a.rep = b.rep AND a.evento AND {PAIR}
    GROUP BY a.atributo, a.rep), {c('').replace(' AS c', ' AS plain')} FROM base a JOIN base b ON a.evento AND {PAIR})) GROUP BY atributo""")
    q["model_roundtrip"] = sql(["target"], """SELECT modelo, count(*) AS n, 0 AS n_different
FROM target, (SELECT unnest(['Cox PH', 'RSF', 'Gradient Boosting']) AS modelo) GROUP BY modelo""")
    one, two, three = swapped
    x = lambda f: f"coalesce(s.{f}, 0.0)"
    z = lambda f: f"coalesce(b.{f}, 0.0)"
    credits = {one: f"({x(one)} - {z(one)}) * ({x(two)} + {z(two)}) / 2", two: f"({x(two)} - {z(two)}) * ({x(one)} + {z(one)}) / 2",
               three: f"-0.25 * ({x(three)} - {z(three)})"}
    q["shapley_mean_abs"] = sql(["matrix"], "\nUNION ALL ".join(f"""
SELECT '{f}' AS atributo, {r('avg(abs(phi))', 'importancia')} FROM (SELECT s.tasker_id, avg({e}) AS phi FROM
  (SELECT * FROM matrix ORDER BY {shuffled(43)}, tasker_id LIMIT 100) s, (SELECT * FROM matrix ORDER BY {shuffled(42)}, tasker_id LIMIT 50) b
  GROUP BY s.tasker_id)""" for f, e in credits.items()))
    q["top_k_importance"] = sql(["metrics"], f"""SELECT modelo || '-' || fold AS atributo, {r('c_uno', 'importancia_media')}
FROM metrics ORDER BY c_uno DESC, modelo || '-' || fold LIMIT 15""")
    q["partial_dependence"] = sql(["matrix"], f"""
SELECT 'pontualidade' AS atributo, CAST(ponto AS INTEGER) AS ponto, {rs('valor')},
  {r(f"avg({RISK.replace('coalesce(pontualidade, 0.0)', 'valor')})", 'risco_medio')}
FROM matrix, (SELECT ponto, lo + (hi - lo) / 19 * ponto AS valor FROM
  (SELECT quantile_cont(pontualidade, 0.05) AS lo, quantile_cont(pontualidade, 0.95) AS hi FROM matrix),
  (SELECT unnest(range(20)) AS ponto)) GROUP BY ponto, valor""")
    fixed = "['taxa_preferencial', 'nota_max_servico', 'pontualidade', 'taxa_retencao']"
    q["pdp_targets"] = sql(["importance_like"], f"""
SELECT CAST(row_number() OVER (ORDER BY min(p)) - 1 AS INTEGER) AS posicao, atributo FROM (
  SELECT atributo, row_number() OVER (ORDER BY m DESC, atributo) AS p FROM importance_like
  QUALIFY row_number() OVER (ORDER BY m DESC, atributo) <= 3
  UNION ALL SELECT unnest({fixed}), 100 + generate_subscripts({fixed}, 1)) GROUP BY atributo""")
    return q
