"""Fixed schemas of the stored tables (DDL strings)."""

FINDING = (
    "severity:string, category:string, message:string, suggestion:string, reasoning:string, file:string, "
    "line_number:int, rule_id:string"
)
RUN_METRICS = (
    "id bigint, repository string, project_id string, workflow_run_id string, ts timestamp_ntz, api_token_hash string, "
    "request_count bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint, latency_ms bigint, "
    "status string, error_message string, files_reviewed bigint, issues_found bigint, critical_count bigint, "
    "high_count bigint, model string, cost_usd double, pr_number bigint, branch string, triggered_by string, "
    "source string"
)
# Nested columns are stored as JSON text, as the writers send them.
RUN_DETAILS = (
    "run_id string, metric_id bigint, repository string, pr_number bigint, commit_sha string, actor string, "
    "branch string, base_branch string, workflow_run_id string, project_id string, gate_status string, status string, "
    "validation_failures string, llm_findings string, per_file_results string, severity_distribution string, "
    "total_issues bigint, critical_count bigint, high_count bigint, medium_count bigint, low_count bigint, "
    "files_reviewed bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost_usd double, "
    "model string, latency_ms bigint, ts timestamp_ntz, runtime_ms bigint, source string"
)
FINDINGS_JSON = f"array<struct<{FINDING}>>"
PER_FILE_JSON = (
    "array<struct<file:string, language:string, validation_count:bigint, llm_count:bigint, "
    f"issues:array<struct<{FINDING}>>, error:string>>"
)
SEVERITY_JSON = "struct<critical:bigint, high:bigint, medium:bigint, low:bigint, info:bigint>"
TRAINING_RECORDS = (
    "id bigint, run_id string, schema_version string, created_at timestamp_ntz, repository string, commit_sha string, "
    "pr_number bigint, branch string, base_branch string, actor string, workflow_run_id string, project_id string, "
    "full_diff string, files_reviewed_json string, rendered_prompt string, prompt_template_version string, "
    "validation_rules_config string, model_version string, analysis_type string, validation_failures string, "
    "llm_findings string, per_file_results string, severity_breakdown string, gate_status string, status string, "
    "total_issues bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost_usd double, "
    "latency_ms bigint, source string"
)
TRAINING_FEEDBACK = (
    "record_id bigint, run_id string, finding_index int, finding_type string, action string, reason string, "
    "corrected_findings string, reviewer_id string, feedback_channel string, created_at timestamp_ntz"
)
TRAINING_LABELS = (
    "record_id bigint, true_positives bigint, false_positives bigint, false_negatives bigint, precision_score double, "
    "recall_score double, gate_correct int, rl_reward double, supervised_label string"
)
REVIEW_RESULT = (
    "workflow_run_id string, repository string, timestamp timestamp_ntz, duration bigint, "
    "summary struct<totalFiles:bigint, filesWithIssues:bigint, totalIssues:bigint, criticalCount:bigint, "
    "highCount:bigint, mediumCount:bigint, lowCount:bigint, infoCount:bigint, averageScore:double, "
    "passThreshold:boolean>, files array<struct<path:string, score:double>>, "
    "tokenUsage struct<inputTokens:bigint, outputTokens:bigint, model:string>"
)
EVENT_POSTS = "event_id bigint, event string, body string"
