"""Names and types of the input tables and of the derived columns other tools read."""

from __future__ import annotations

# Column names of the data model, kept as users of the pipeline know them.
STATES = {
    "onboarding_at": "onboarding",
    "ativacao_at": "enabled",
    "suspensao_at": "suspended",
    "inativacao_at": "disabled",
}
PROFILE = [
    "created_at", "city", "state_uf", "gender", "birthdate", "category", "plan", "indication",
    "latitude", "longitude", "n_servicos_oferecidos", "photo_identity_state",
    "photo_identity_score", "photo_identity_checked_at",
]
SERVICES = ["limpeza", "limpeza_express", "limpeza_pesada", "montagem", "passadoria"]
REPUTATION = {
    "score_punctuality": "pontualidade",
    "score_friendliness": "simpatia",
    "retention_rate": "taxa_retencao",
    "preferential_rate": "taxa_preferencial",
}
CATEGORICAL = ["genero", "plano", "canal_indicacao"]
NOT_PREDICTORS = ["tasker_id", "tempo", "evento"]
ZERO_WHEN_ABSENT = [
    "n_incidentes", "n_no_show", "n_atraso", "n_cancelamento", "atraso_medio_min",
    "atraso_max_min", "penalidade_total", "n_diarias", "n_diarias_pref", "bonus_total",
    "n_diarias_avaliadas",
]
METRICS = ["c_harrell", "c_uno", "auc_media", "ibs"]

SCORES = [f"score_{s}" for s in SERVICES]
SCORE_COUNTS = [f"n_aval_{s}" for s in SERVICES]
REPUTATION_INPUTS = list(REPUTATION) + [c for pair in zip(SCORES, SCORE_COUNTS) for c in pair]

TASKERS_DDL = (
    "tasker_id BIGINT, updated_at TIMESTAMP_NTZ, rev BIGINT, state STRING, created_at TIMESTAMP_NTZ, "
    "current_sign_in_at TIMESTAMP_NTZ, city STRING, state_uf STRING, gender STRING, "
    "birthdate TIMESTAMP_NTZ, category STRING, plan STRING, indication STRING, latitude DOUBLE, "
    "longitude DOUBLE, n_servicos_oferecidos INT, photo_identity_state STRING, "
    "photo_identity_score DOUBLE, photo_identity_checked_at TIMESTAMP_NTZ, "
    + ", ".join(f"{c} DOUBLE" for c in REPUTATION)
    + "".join(f", {s} DOUBLE, {n} INT" for s, n in zip(SCORES, SCORE_COUNTS))
)
JOBS_DDL = (
    "tasker_id BIGINT, job_id BIGINT, job_date TIMESTAMP_NTZ, work_time DOUBLE, feedback_score DOUBLE, "
    "final_payout DOUBLE, latitude DOUBLE, longitude DOUBLE, preferential BOOLEAN, "
    "performed_by_preferential BOOLEAN, service STRING, subscription BOOLEAN, bonus_payout DOUBLE, "
    "confirmed_at TIMESTAMP_NTZ"
)
INCIDENTS_DDL = (
    "tasker_id BIGINT, incident_id BIGINT, type STRING, incident_at TIMESTAMP_NTZ, time_delta DOUBLE, "
    "penalty_amount DOUBLE, disable_tasker BOOLEAN"
)
METRICS_DDL = "modelo STRING, fold INT, " + ", ".join(f"{m} DOUBLE" for m in METRICS)
