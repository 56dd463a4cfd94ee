"""Schemas of the lake's documents."""

from __future__ import annotations

CLOUD_EVENT = (
    "insertId string, timestamp string, severity string, "
    "resource struct<type:string,labels:map<string,string>>, jsonPayload map<string,string>"
)
METRICS = (
    "status string, data struct<resultType:string,"
    "result:array<struct<metric:map<string,string>,values:array<array<string>>>>>"
)
MANIFEST = (
    "metadata struct<dbt_version:string,project_name:string>, "
    "nodes map<string,struct<name:string,resource_type:string,original_file_path:string,"
    "depends_on:struct<nodes:array<string>>,raw_code:string,"
    "columns:map<string,struct<name:string,data_type:string>>>>"
)
RUN_RESULTS = (
    "metadata struct<dbt_version:string,generated_at:string>, "
    "results array<struct<status:string,timing:array<struct<name:string,duration:double>>,"
    "thread_id:string,unique_id:string,message:string,"
    "adapter_response:struct<code:string,rows_affected:bigint>>>"
)
CATALOG = (
    "repositories map<string,struct<repo_name:string,repo_url:string,default_branch:string,"
    "code_subpath:string,team_owner:string,slack_channel:string,matching_dags:array<string>,framework:string>>"
)
ALERT = (
    "event_type string, cluster string, dag_id string, task_id string, run_id string, try_number int, "
    "operator string, pod_name string, execution_date string, exception_type string, "
    "exception_message string, prompt string, received_at timestamp"
)
LABEL = (
    "scenario_id string, cluster string, dag_id string, task_id string, run_id string, operator string, "
    "pod_name string, failing_model string, upstream_cluster string, upstream_dag_id string, "
    "root_cause string, recommended_action string, suggested_memory_limit string, "
    "suggested_memory_request string, backoff_seconds int, is_transient boolean"
)
