"""Schemas of the records."""

MESSAGES = "array<struct<role:string,content:string>>"
SFT = (
    "id string, instruction string, response string, language string, task string, "
    "source struct<dataset:string,original_id:string,source:string,url:string,split:string>, "
    "clinical_context struct<clinical_case:string,symptoms:array<string>,history:array<string>,vitals:array<string>,"
    "diagnosis:string,medications:array<string>,allergies:array<string>>, "
    "source_specific struct<question_type:string,question_focus:string,synonyms:array<string>,umls_cui:array<string>,"
    "choices:map<string,string>,correct_answers:array<string>,semantic_types:array<string>,semantic_group:string,medical_subject:string>, "
    "quality struct<confidence:double,validated:boolean>, provenance struct<source_license:string,processing_version:string>"
)
SIDE = "struct<score:double,rank:int,evaluation:string>"
RAW_PREFERENCE = (
    f"prompt string, prompt_id string, label_type string, chosen {MESSAGES}, rejected {MESSAGES}, feedback string, "
    f"metadata struct<chosen:{SIDE},rejected:{SIDE},golden_answer:string>, split string"
)
PREFERENCE = (
    f"id string, prompt string, chosen {MESSAGES}, rejected {MESSAGES}, source struct<dataset:string,split:string,label_type:string>, "
    "quality struct<preference_valid:boolean,clinically_validated:boolean,clinical_validation_status:string>, "
    "provenance struct<source_id:string,processing_version:string,dpo_split:string>"
)
PREDICTION = (
    "id string, instruction string, reference string, prediction string, language string, task string, "
    "source struct<dataset:string,original_id:string>, token_f1 double, exact_match int, generated_tokens int"
)
EVENT = "timestamp_utc timestamp, event string, status string, request_id string, model string, latency_ms double"
