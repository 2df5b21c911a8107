"""Fixed schemas of the raw records and of the canonical instance."""

QA_RAW = "id string, question string, answer string, type string, level string, supporting_facts struct<title: array<string>, sent_id: array<int>>, context struct<title: array<string>, sentences: array<array<string>>>"
CLAIM_RAW = "id int, label string, claim string, evidence_annotation_id int, evidence_id int, evidence_wiki_url string, evidence_sentence_id int"
PARAGRAPH_RAW = "id string, question string, answer string, answerable boolean, answer_aliases array<string>, paragraphs array<struct<idx: int, title: string, paragraph_text: string, is_supporting: boolean>>"
WIKI_PAGE = "id string, lines string"
WIKI_SENTENCE = "page_id string, sent_id int, text string"

PROVENANCE = "struct<dataset: string, source_type: string, doc_title: string, paragraph_index: int, sentence_index: int, source_url: string, timestamp: string, version: string, provenance_granularity: string>"
UNIT = (
    "struct<evidence_id: string, text: string, doc_title: string, source_doc_id: string, canonical_unit_type: string, native_unit_type: string, paragraph_index: int, sentence_index: int, "
    f"text_status: string, is_gold_evidence: boolean, support_role: string, native_label: string, label_strength: string, supervision_weight: double, provenance: {PROVENANCE}>"
)
EVIDENCE_SET = "struct<condition: string, created_by: string, canonical_granularity: string, native_granularity: string, num_evidence_units: int, num_gold_evidence_units: int, num_sources: int>"
INSTANCE = (
    "example_id string, dataset string, task_type string, input_text string, input_type string, target_answer string, target_label string, evidence_state_label string, "
    f"evidence_set {EVIDENCE_SET}, evidence_units array<{UNIT}>, agent_action_label string"
)
