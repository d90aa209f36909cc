"""Explicit schemas; files are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

ANSWER = "struct<type:string,value:string,level_id:string,p_true:double,expected_value:double,probabilities:map<string,double>,calibration_status:string,disposition:string,order_discrepancy:double>"
QUESTION = "struct<type:string,instructions:string,proposition:string,options:array<struct<id:string,description:string>>,levels:array<struct<id:string,description:string,value:double>>>"



DDL = {
    "example": (
        "example_id string, source_group_id string, near_duplicate_cluster_id string, workload_id string, task_id string, template_id string,"
        f" request struct<state:string,questions:map<string,{QUESTION}>,profile:string,order_debias_passes:int>,"
        " reference_answers map<string,string>, rubric string, provenance struct<kind:string,author:string>,"
        " annotations array<struct<annotator_id:string,annotator_kind:string,answers:map<string,string>,independent:boolean>>,"
        " annotation_status string, adjudicator_id string, task_template_holdout boolean,"
        " public_source struct<dataset:string,revision:string,file_sha256:string,source_url:string,license:string,annotation_documentation:string,upstream_id:string,upstream_split:string,original_label:string>,"
        " evaluation_split string"
    ),
    "prediction": f"example_id string, question_id string, workload_id string, primitive string, reference string, prediction string, answer {ANSWER}, request_total_ms double, inference_ms double",
    "profile": (
        "schema_version int, profile_id string, workload_id string, primitive string, artifact_id string, model_id string, revision string, precision string,"
        " prompt_version string, label_version string, card_min int, card_max int, method string, temperature double, bias array<double>,"
        " policy struct<type:string,threshold:double,metric:string,max_order_discrepancy:double>, dataset_sha256 string, split string, fitted_at string,"
        " metrics struct<brier_score:double,ece:double,coverage:double,accepted_error_rate:double,sample_count:int,accepted_count:int,errors_in_accepted:int,"
        "gate_ece_passed:boolean,gate_brier_passed:boolean,gate_selective_passed:boolean,samples_sufficient_for_gate:boolean,prevalence_brier_score:double,accepted_error_95_upper_bound:double>"
    ),
    "request": f"state string, questions map<string,{QUESTION}>, profile string, order_debias_passes int",
    "exemplar": "task_id string, state string, selected_id string, reasoning string",
    "probe": "task_id string, category string, state string, instructions string, ground_truth string, decision_tree string, candidates array<struct<id:string,description:string>>, exemplars_8shot array<struct<state:string,selected:string>>",
    "shadow": "timestamp string, request_id string, artifact_id string, profile_id string, metadata map<string,string>, decisions map<string,struct<type:string,value:string,probabilities:map<string,double>,calibration_status:string,disposition:string>>, timing_ms struct<queue:double,inference:double,total:double>",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
