"""Closed vocabularies: stop words, evidence states, the actions that follow from them."""

# Results depend on them.
STOPWORDS_EVIDENCE = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into through during before after and but or not no if then than that "
    "this which who whom what where when how all each every both few more most other some such only own same "
    "so very it its they them their he she him her his we us our you your"
).split()
STOPWORDS_UNIT = (
    "the a an is are was were be been have has had do does did will would to of in for on with at by from "
    "and but or not no if that this which who what where when how it its"
).split()
STOPWORDS_CONTEXT = (
    "the a an is are was were be been have has had do does did will would to of in for on with at by from "
    "and but or not that this it its what who how"
).split()
STATES = ["sufficient", "insufficient", "contradicted", "superseded"]
ACTIONS = ["answer", "retrieve_more", "flag_conflict", "verify"]
FEATURES = ["source_diversity", "text_resolution_rate", "avg_evidence_length", "min_evidence_length", "duplicate_rate", "document_overlap_rate", "entity_overlap", "evidence_count"]
# End of fixed values.
