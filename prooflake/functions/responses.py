"""Prompts for models and parsers of their answers, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prooflake.functions.text import _col, strip


def first_line(response: Column | str) -> Column:
    return strip(F.element_at(F.split(strip(response), "\n"), 1))


def clean_answer(response: Column | str) -> Column:
    """The first line without the usual lead-ins, each removed once, in this order, whatever their case."""
    answer = first_line(response)
    for lead in ("answer:", "the answer is", "a:"):
        answer = F.when(F.startswith(F.lower(answer), F.lit(lead)), strip(F.substring(answer, len(lead) + 1, 1 << 30))).otherwise(answer)
    return answer


def parse_state(response: Column | str) -> Column:
    """0 sufficient, 1 insufficient, 2 contradicted, 3 superseded; the longer word is looked for first, 0 if none occurs."""
    line = F.lower(first_line(response))
    has = lambda word: F.contains(line, F.lit(word))
    return F.when(has("insufficient"), 1).when(has("superseded"), 3).when(has("contradict"), 2).otherwise(0)


def rating_vote(responses: Column | str) -> Column:
    """Per-passage ratings to a state: any incorrect 2, more ambiguous than correct 1, all correct (or none given) 0, else 1."""
    upper = F.transform(_col(responses), lambda r: F.upper(strip(r)))
    wrong = F.size(F.filter(upper, lambda r: F.contains(r, F.lit("INCORRECT"))))
    unsure = F.size(F.filter(upper, lambda r: ~F.contains(r, F.lit("INCORRECT")) & F.contains(r, F.lit("AMBIGUOUS"))))
    right = F.size(upper) - wrong - unsure
    return F.when(wrong > 0, 2).when(unsure > right, 1).when(right == F.size(upper), 0).otherwise(1)


def critic_state(response: Column | str) -> Column:
    """Relevance from the first line, support from the last line that names it: 0 full, 1 partial or irrelevant, 2 relevant without support."""
    lines = F.split(F.upper(strip(response)), "\n")
    relevant = F.contains(F.element_at(lines, 1), F.lit("YES"))
    judge = lambda line: F.when(F.contains(line, F.lit("FULLY")), "FULLY").when(F.contains(line, F.lit("PARTIAL")), "PARTIALLY").otherwise("NO")
    support = F.aggregate(lines, F.lit("NO"), lambda so_far, line: F.when(F.contains(line, F.lit("SUPPORT")), judge(line)).otherwise(so_far))
    return F.when(relevant & (support == "FULLY"), 0).when(~relevant, 1).when(support == "NO", 2).otherwise(1)


def entailment_state(label: Column | str) -> Column:
    """Entailment 2 to sufficient 0, neutral 1 to insufficient 1, contradiction 0 to contradicted 2, all else 1."""
    return F.when(_col(label) == 2, 0).when(_col(label) == 0, 2).otherwise(1)


def argmax_state(logits: Column | str) -> Column:
    """The state of the first largest of three logits (contradiction, neutral, entailment)."""
    return entailment_state(F.array_position(_col(logits), F.array_max(_col(logits))) - 1)


def state_prompt(structured: Column | str) -> Column:
    return F.concat(
        F.lit("Question with retrieved evidence:\n"), F.substring(_col(structured), 1, 2000),
        F.lit("\n\nIs the evidence sufficient, insufficient, contradicted or superseded? Reply with one of these words:"),
    )


def passage_prompt(question: Column | str, passage: Column | str) -> Column:
    return F.concat(F.lit("Question: "), _col(question), F.lit("\nPassage: "), F.substring(_col(passage), 1, 500), F.lit("\n\nRate the passage: CORRECT, AMBIGUOUS or INCORRECT."))


def critic_prompt(question: Column | str, passages: Column) -> Column:
    text = F.substring(F.array_join(F.slice(passages, 1, 5), "\n"), 1, 1000)
    return F.concat(F.lit("Question: "), _col(question), F.lit("\nEvidence:\n"), text, F.lit("\n\nFirst line RELEVANT: YES or NO. Second line SUPPORT: FULLY, PARTIALLY or NO."))


def answer_prompt(evidence: Column | str) -> Column:
    return F.concat(F.lit("Evidence:\n"), _col(evidence), F.lit("\n\nGive the answer in a few words:"))


def verdict_prompt(evidence: Column | str) -> Column:
    return F.concat(F.lit("Evidence:\n"), _col(evidence), F.lit("\n\nIs the claim SUPPORTS, REFUTES or NOT ENOUGH INFO? Verdict:"))


#: Passages that a rating vote looks at.
RATED = 3


def rated_passages(passages: Column) -> Column:
    return F.slice(passages, 1, RATED)


def generation_prompt(dataset: Column | str, evidence: Column | str, claims: tuple[str, ...] = ("fever",)) -> Column:
    """A verdict is asked for of datasets of claims, an answer of all others."""
    return F.when(_col(dataset).isin(*claims), verdict_prompt(evidence)).otherwise(answer_prompt(evidence))
