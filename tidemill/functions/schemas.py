"""Schemas of the service tables and of the audit inputs (fixed values)."""

ETL_TASKS = (
    "id int, created_at timestamp_ntz, started_at timestamp_ntz, task_description string, output_format string, "
    "status string, source_tables array<string>, error_message string, etl_pattern string, generation_time_ms int, "
    "dag_schedule string"
)
GENERATED_ARTIFACTS = (
    "id int, task_id int, artifact_type string, code string, language string, is_valid boolean, "
    "validation_error string, attempts int, created_at timestamp_ntz"
)
EXECUTION_LOGS = (
    "id int, artifact_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string, log_output string, "
    "airflow_run_id string"
)
SERVICE_TABLES = {
    "etl_tasks": ETL_TASKS,
    "generated_artifacts": GENERATED_ARTIFACTS,
    "execution_logs": EXECUTION_LOGS,
}

SCRIPTS = "script_id bigint, language string, code string"
SCRIPT_STEPS = "script_id bigint, step int, statement string"
DAG_TASKS = "dag_id bigint, task_id string, operator string, sql_text string"
DAG_EDGES = "dag_id bigint, src string, dst string"
