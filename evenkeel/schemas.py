"""Declared schemas of the tables that the engine reads."""

from __future__ import annotations

CLINICAL_LONG = "Index bigint, dataset string, dataset_id int, context_id string, original_patient_gender string, clinical_context string"
TRIAGE_ANSWER = "struct<seeds:array<int>,model_responses:array<string>,extractor_outputs:array<string>,extraction_methods:array<string>,binary_answers:array<int>,logit_probs:double>"
SCORE_LONG = "case_id string, variant string, task string, binary_answers array<int>, logit_probs double"
LOGODDS = "bio_id bigint, profession int, gender int, swap_direction int, logit_original double, logit_swapped double, logit_fixed_sentence double, logit_paraphrase double"
BIOGRAPHY = "hard_text string, profession int, gender int"
CONTRAST_SOURCE = "decision_question_id int, age double, race string, gender string, filled_template string"
CONTRAST_EVAL = "decision_question_id int, logit_reference double, contrasts map<string,struct<logit_contrast:double,logit_paraphrase:double>>"
VIGNETTE = "Vignette string, Question string, Answer string, Dosage string, Explanation string"
SUBGROUP_SCORE = "vignette_id int, context string, subgroup string, variant_type string, comparison string, prob_no double, prob_yes double"
PARAPHRASE = "struct<paraphrase:string,target_pct:double,actual_pct:double,deviation:double,retries_used:int>"
AGE_EDIT = "context_id string, dataset string, original_text string, age_swapped_text string, original_age int, new_age int, token_change_pct double, age_extraction_failed boolean"
SIMULATION = "metric string, sigma_pert double, sigma double, condition string, detection_rate double, mean_p_value double"

#: Variant codes of CLINICAL_LONG: name, role, and the targeted edit that a benign one is matched to.
VARIANTS = (
    (1, "original", "original", None),
    (2, "gender_swap", "targeted", None),
    (3, "gender_remove", "targeted", None),
    (4, "uncertain", "targeted", None),
    (5, "colorful", "targeted", None),
    (6, "baseline_gender_swap", "benign", "gender_swap"),
    (7, "baseline_gender_remove", "benign", "gender_remove"),
    (8, "baseline_uncertain", "benign", "uncertain"),
    (9, "baseline_colorful", "benign", "colorful"),
)
