"""DuckDB statements that compute the catalogue's results independently, on the same tables."""

from __future__ import annotations

from prooflake.functions.vocabulary import FEATURES, STATES, STOPWORDS_CONTEXT, STOPWORDS_EVIDENCE, STOPWORDS_UNIT
from prooflake.sources.fixtures import CANNED


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return _words(f"lower({x})")


def _set(x: str) -> str:
    return f"list_distinct({_tokens(x)})"


def _content(x: str, stop: list[str]) -> str:
    return f"list_filter(list_distinct({x}), lambda w: NOT list_contains({_list(stop)}, w))"


def _plain(x: str) -> str:
    return _words(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _blank(x: str) -> str:
    return rf"coalesce(NOT regexp_matches({x}, '\S'), true)"


def _overlap(q: str, o: str) -> str:
    return f"CASE WHEN len({q}) = 0 OR len({o}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({q}, {o}))::DOUBLE / len({q}) END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _answer(x: str) -> str:
    # an article next to an accented letter is part of a word: RE2's \b is ASCII, so letters are marked off first
    bare = rf"regexp_replace(regexp_replace({_strip(f'lower({x})')}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])(a|an|the)($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1 \3', 'g'), '(^|[^\p{{L}}\p{{N}}\p{{M}}_])(a|an|the)($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1 \3', 'g')"
    return rf"array_to_string({_words(rf'''translate({bare}, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')''')}, ' ')"


def _rank(stream: str, *keys: str) -> str:
    joined = " || '|' || ".join([_text(stream), *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"('0x' || substr(md5({joined}), 1, 8))::BIGINT"


UNITS = """units AS (
SELECT b.item_id, CAST(b.item_id % 3 AS INT) AS ds, b.text AS input_text, d.doc_id,
       CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE d.text END AS text,
       CASE WHEN d.doc_id % 23 = 0 THEN 'none' ELSE d.source END AS doc_title,
       CAST(row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) - 1 AS INT) AS pos,
       coalesce(l.quality, 0) = 1 AS is_gold
FROM benchmark b
LEFT JOIN (SELECT x.*, CAST(x.doc_id * 7 + floor(x.doc_id / 20) * 3 + floor(x.doc_id / 40) * x.doc_id AS BIGINT) % (c.n - 2) AS slot
           FROM documents x CROSS JOIN (SELECT count(*) AS n FROM benchmark) c) d ON d.slot = b.item_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

FEATURED = f"""{UNITS}, t AS (
  SELECT *, doc_id IS NOT NULL AND NOT {_blank('text')} AS filled, {_set("coalesce(text, '')")} AS s, len({_words("coalesce(text, '')")}) AS len_,
         count(*) FILTER (doc_title <> 'none') OVER (PARTITION BY item_id, doc_title) AS same_title
  FROM units
), pairs AS (
  SELECT a.item_id, count(*) AS n_pairs, count(*) FILTER ({_jaccard('a.s', 'b.s')} > 0.5) AS n_dup
  FROM t a JOIN t b ON a.item_id = b.item_id AND a.pos < b.pos AND a.filled AND b.filled GROUP BY a.item_id
), agg AS (
  SELECT item_id, ds, any_value(input_text) AS input_text, count(doc_id) AS n,
         count(DISTINCT doc_title) FILTER (doc_title NOT IN ('', 'none')) AS source_diversity, count(*) FILTER (filled) AS n_text,
         avg(len_) FILTER (filled) AS mean_len, min(len_) FILTER (filled) AS min_len,
         count(*) FILTER (doc_title <> 'none' AND same_title > 1) AS shared, flatten(list(s) FILTER (filled)) AS all_tokens
  FROM t GROUP BY item_id, ds
), feat AS (
  SELECT agg.item_id, 'ds' || ds AS dataset, CAST(source_diversity AS INT) AS source_diversity, round(n_text::DOUBLE / greatest(n, 1), 4) AS text_resolution_rate,
         coalesce(round_even(mean_len * 100, 0) / 100, 0.0) AS avg_evidence_length, CAST(coalesce(min_len, 0) AS INT) AS min_evidence_length,
         round(coalesce(n_dup, 0)::DOUBLE / greatest(coalesce(n_pairs, 0), 1), 4) AS duplicate_rate, round(shared::DOUBLE / greatest(n, 1), 4) AS document_overlap_rate,
         round({_overlap(_content(_tokens('input_text'), STOPWORDS_EVIDENCE), _content("coalesce(all_tokens, [])", STOPWORDS_EVIDENCE))}, 4) AS entity_overlap,
         CAST(n AS INT) AS evidence_count, {_list(STATES)}[agg.item_id % 4 + 1] AS state
  FROM agg LEFT JOIN pairs ON pairs.item_id = agg.item_id
)"""

_F = ", ".join(FEATURES)
_LONG = "long AS (UNPIVOT (SELECT item_id, dataset, state, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in FEATURES) + f" FROM feat) ON {_F} INTO NAME feature VALUE value)"
_TOP = f"""{UNITS}, cut AS (
  SELECT item_id, doc_id, pos, input_text, ds, left({_strip('text')}, 300) AS text FROM units WHERE doc_id IS NOT NULL AND NOT {_blank('text')}
), top AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS k
  FROM (SELECT *, {_overlap(_content(_tokens('input_text'), STOPWORDS_UNIT), _content(_tokens('text'), STOPWORDS_UNIT))} AS score FROM cut) QUALIFY k <= 10
), proc AS (
  SELECT u.item_id, format('item_{{:06d}}_gold_full', u.item_id) AS example_id, 'ds' || any_value(u.ds) AS dataset, any_value(u.input_text) AS input_text, count(DISTINCT u.doc_id) AS total,
         (SELECT coalesce(list(text ORDER BY k), []) FROM top WHERE top.item_id = u.item_id) AS passages
  FROM units u GROUP BY u.item_id
), full_ AS (
  SELECT *, array_to_string(list_concat([input_text], passages), ' [SEP] ') AS structured_input, input_text || ' ' || array_to_string(passages, ' ') AS plain_input,
         string_split(input_text, ' ')[1] AS target_answer FROM proc
), passage_list AS (
  SELECT *, list_filter(list_transform(string_split(structured_input, '[SEP]')[2:], lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM full_
)"""

_UNIT_COLUMNS = "example_id, evidence_state_label, agent_action_label, condition, num_evidence_units, num_gold_evidence_units, num_sources, pos, evidence_id, text_md5, doc_title, source_doc_id, sentence_index, paragraph_index, text_status, is_gold_evidence, support_role, label_strength, supervision_weight, provenance_granularity"


def _instance_units(rows: str) -> str:
    """rows: a CTE x with one row per unit in order ord (unit columns null for an empty instance)."""
    return f"""{rows} SELECT {_UNIT_COLUMNS} FROM (
  SELECT *, CASE WHEN evidence_id IS NOT NULL THEN CAST(row_number() OVER w - 1 AS INT) END AS pos,
         CAST(count(evidence_id) OVER (PARTITION BY example_id) AS INT) AS num_evidence_units, CAST(count(*) FILTER (is_gold_evidence) OVER (PARTITION BY example_id) AS INT) AS num_gold_evidence_units,
         CAST(count(DISTINCT doc_title) OVER (PARTITION BY example_id) AS INT) AS num_sources
  FROM x WINDOW w AS (PARTITION BY example_id ORDER BY ord)) ORDER BY 1"""


_MULTI_HOP = rf"""firsts AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'user' GROUP BY conv_id),
turns AS (SELECT c.*, f FROM conversations c JOIN firsts USING (conv_id)),
lines AS (
  SELECT conv_id, turn, role, i - 1 AS i, string_split(text, chr(10))[i] AS s FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM turns WHERE turn <> f)
),
hop AS (
  SELECT *, role = 'assistant' AND i = 0 AS gold, count(*) FILTER (role = 'assistant' AND i = 0 AND regexp_matches(s, '\S')) OVER (PARTITION BY conv_id) AS n_gold FROM lines
)"""

_PARAGRAPHS = rf"""{UNITS}, para AS (
  SELECT *, item_id % 4 <> 0 AS answerable, doc_id IS NOT NULL AND regexp_matches(coalesce(text, ''), '\S') AS ok,
         count(*) FILTER (is_gold AND regexp_matches(coalesce(text, ''), '\S')) OVER (PARTITION BY item_id) AS n_gold, count(*) FILTER (doc_id IS NOT NULL AND regexp_matches(coalesce(text, ''), '\S')) OVER (PARTITION BY item_id) AS n_ok
  FROM units
)"""

_PREDICTIONS = "p AS (SELECT doc_id, 'ds' || (doc_id % 3) AS dataset, quality AS true_, 1 - toxic AS pred FROM labels)"


def _macro(table: str, by: str = "") -> str:
    """Metrics of a CTE with by, true_ and pred."""
    comma = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""sides AS (
  SELECT {comma}true_ AS label, 1 AS t, 0 AS p_, CASE WHEN true_ = pred THEN 1 ELSE 0 END AS hit FROM {table} UNION ALL SELECT {comma}pred, 0, 1, 0 FROM {table}
), rep AS (
  SELECT {comma}label, sum(t) AS support, CASE WHEN sum(p_) > 0 THEN sum(hit) / sum(p_) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN sum(t) > 0 THEN sum(hit) / sum(t) ELSE 0.0 END::DOUBLE AS recall,
         (2.0::DOUBLE * sum(hit) / (sum(t) + sum(p_)))::DOUBLE AS f1 FROM sides GROUP BY {comma}label
), mac AS (
  SELECT * FROM (SELECT {comma}avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM rep {group}) JOIN
  (SELECT {comma}avg(CASE WHEN true_ = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM {table} {group}) {on}
)"""


_MACRO_OUT = "round(accuracy, 6) AS accuracy, n, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1"

_SCORES = """scores AS (
  SELECT a.vec_id // 2 AS pair_id, a.label % 4 AS true_,
         round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) /
         ((sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8) * (sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8)), 9) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0
)"""

_VARIANTS = f"""v AS (
  SELECT 'q' || (conv_id // 3) AS question, conv_id * 100 + turn AS ordinal, ['insufficient', 'sufficient', 'contradicted', 'superseded'][(turn + conv_id) % 4 + 1] AS state,
         'ds' || ((conv_id // 3) % 3) AS dataset, text AS evidence FROM conversations
), g AS (
  SELECT question, max(ordinal) FILTER (state = 'sufficient') AS last, count(*) AS n_variants, count(DISTINCT state) AS n_states FROM v GROUP BY question HAVING last IS NOT NULL
), e AS (
  SELECT v.*, s.evidence AS best, {_list(STATES)}[v.ordinal % 4 + 1] AS predicted FROM v JOIN g USING (question) JOIN v s ON s.question = v.question AND s.ordinal = g.last
  WHERE v.state <> 'sufficient' OR v.ordinal = g.last
), answers AS (
  SELECT *, predicted = state AS detector_correct, best AS gold, evidence AS naive_answer,
         CASE WHEN predicted = 'sufficient' THEN evidence ELSE best END AS guided_answer,
         CASE WHEN state = 'sufficient' THEN evidence ELSE best END AS oracle_answer
  FROM e
)"""


def _f1(p: str, g: str) -> str:
    """Token F1 of two columns with answer tokens."""
    common = f"list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w)))))"
    return f"CASE WHEN len({g}) = 0 THEN CASE WHEN len({p}) = 0 THEN 1.0 ELSE 0.0 END WHEN len({p}) = 0 OR coalesce({common}, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * {common} / (len({p}) + len({g})) END::DOUBLE"


_SCORED = f"""{_VARIANTS}, tok AS (
  SELECT *, {_words(_answer('gold'))} AS tg, {_words(_answer('naive_answer'))} AS tn, {_words(_answer('guided_answer'))} AS tu, {_words(_answer('oracle_answer'))} AS t_o FROM answers
), scored AS (
  SELECT *, {_f1('tn', 'tg')} AS f1_naive, {_f1('tu', 'tg')} AS f1_guided, {_f1('t_o', 'tg')} AS f1_oracle,
         (tn = tg)::INT::DOUBLE AS em_naive, (tu = tg)::INT::DOUBLE AS em_guided, (t_o = tg)::INT::DOUBLE AS em_oracle FROM tok
)"""


def _summary(level: str, value: str, group: str) -> str:
    return f"""SELECT '{level}' AS level, {value} AS value, count(*) AS n, avg(detector_correct::INT::DOUBLE) AS detector_accuracy, avg(f1_naive) AS f1_naive, avg(f1_guided) AS f1_guided, avg(f1_oracle) AS f1_oracle,
  avg(em_naive) AS em_naive, avg(em_guided) AS em_guided, avg(em_oracle) AS em_oracle FROM scored {group}"""


def _variant_units(kind: str) -> str:
    """CTEs: cand (item, the chosen place) for one of the variants."""
    need = "is_gold" if kind == "insufficient" else "is_gold AND coalesce(text, '') <> ''"
    rank = _rank(f"42|{kind}", "format('item_{:06d}_gold_full', item_id)")
    return f"""{UNITS}, golds AS (SELECT item_id, list(pos ORDER BY pos) AS places FROM units WHERE doc_id IS NOT NULL AND {need} GROUP BY item_id),
picked AS (SELECT item_id, places[{rank} % len(places) + 1] AS at FROM golds)"""


def _appended(kind: str, action: str, condition: str, suffix: str, role: str, version: str, outdated: str, wording: str) -> str:
    return f"""WITH {_variant_units(kind)}, base AS (
  SELECT u.item_id, count(*) AS n, count(*) FILTER (is_gold) AS g, count(DISTINCT doc_title) AS s FROM units u WHERE doc_id IS NOT NULL GROUP BY u.item_id
), target AS (
  SELECT k.item_id, u.doc_id, u.text, string_split(u.input_text, ' ')[1] AS answer, format('item_{{:06d}}_gold_full', k.item_id) AS old_id FROM picked k JOIN units u ON u.item_id = k.item_id AND u.pos = k.at
), worded AS (SELECT *, {wording} AS new_text FROM target)
SELECT format('item_{{:06d}}_{kind}', w.item_id) AS example_id, '{kind}' AS evidence_state_label, '{action}' AS agent_action_label, '{condition}' AS condition,
       CAST(n + 1 AS INT) AS num_evidence_units, CAST(g AS INT) AS num_gold_evidence_units, CAST(s AS INT) AS num_sources, format('doc_{{:06d}}', w.doc_id) || '{suffix}' AS last_id, '{role}' AS last_role, {version} AS last_version,
       {outdated} AS outdated, md5(new_text) AS wording_md5
FROM worded w JOIN base USING (item_id)"""


_CUT = r"regexp_replace(left(text, 120), '\s+$', '')"
_DISPUTE = f"lower({_CUT} || CASE WHEN length(text) > 120 THEN '...' ELSE '' END)"
_CONTRADICTIONS = f"""list_concat(['Two independent registers deny it: ' || {_DISPUTE}, {_DISPUTE} || ' A recount gave a number that cannot be squared with this.',
 'Letters printed since then say the reverse of "' || {_DISPUTE} || '"', 'Struck from the record, as it did not take place: ' || {_DISPUTE}],
 CASE WHEN length(answer) > 1 THEN ['Whoever it was, it was not ' || answer || '.', answer || ' is out of the question, given the dates in the register.', 'The original record has another name where copies have ' || answer || '.'] ELSE [] END)"""
_SUPERSESSIONS = f"""[lower({_CUT}) || '... - so the edition of 2018; the one in force has another entry here.', 'Valid until the next edition only: ' || lower({_CUT}) || '...', 'This edition settles differently what used to read "' || lower({_CUT}) || '...".']"""


def _drawn(options: str, stream: str) -> str:
    return f"({options})[{_rank(stream, 'old_id')} % len({options}) + 1]"


def _canned(kind: str, key: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in CANNED[kind]) + f"][({key}) % 5 + 1]"


ORACLES: dict[str, str] = {
    "evidence_features": f"WITH {FEATURED} SELECT item_id, {_F} FROM feat",
    "document_overlap_rate": f"WITH {FEATURED} SELECT item_id, document_overlap_rate, source_diversity FROM feat",
    "feature_vectors": f"WITH {FEATURED} SELECT item_id, unnest(range(8))::INT AS place, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURES)}]) AS value FROM feat",
    "evidence_pairs_jaccard": f"""WITH {FEATURED}, p AS (SELECT a.item_id, a.pos AS i, b.pos AS j, {_jaccard('a.s', 'b.s')} AS sim FROM t a JOIN t b ON a.item_id = b.item_id AND a.pos < b.pos AND a.filled AND b.filled)
SELECT item_id, i, j, round(sim, 6) AS similarity, sim > 0.5 AS duplicate FROM p WHERE sim > 0.3""",
    "duplicate_rate_by_group": f"""WITH {FEATURED}, c AS (SELECT item_id, CAST(count(*) FILTER (filled) AS INT) AS n FROM t GROUP BY item_id)
SELECT c.item_id, n, CAST(coalesce(n_dup, 0) AS INT) AS duplicates, round(coalesce(n_dup, 0) / greatest(n::DOUBLE * (n - 1) / 2, 1.0), 6) AS duplicate_rate FROM c LEFT JOIN pairs USING (item_id)""",
    "query_word_overlap": f"""WITH o AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations)
SELECT conv_id, turn, round({_overlap(_content(_tokens('text'), STOPWORDS_EVIDENCE), _content(_tokens('gold'), STOPWORDS_EVIDENCE))}, 4) AS word_overlap FROM o WHERE role = 'user' AND gold IS NOT NULL""",
    "evidence_graph_nodes": f"""WITH {UNITS}, x AS (SELECT *, format('item_{{:06d}}_gold_full', item_id) AS example_id FROM units)
SELECT DISTINCT example_id, 'input' AS node, 'input' AS type, left(input_text, 200) AS text, NULL::BOOLEAN AS has_text, NULL::VARCHAR AS title FROM x
UNION ALL SELECT example_id, format('doc_{{:06d}}', doc_id), 'evidence', NULL, coalesce(text, '') <> '', doc_title FROM x WHERE doc_id IS NOT NULL
UNION ALL SELECT DISTINCT example_id, 'ds::' || doc_title, 'source', NULL, NULL::BOOLEAN, doc_title FROM x WHERE doc_id IS NOT NULL""",
    "evidence_graph_edges": f"""WITH {FEATURED}, x AS (SELECT *, format('item_{{:06d}}_gold_full', item_id) AS example_id, format('doc_{{:06d}}', doc_id) AS id FROM t WHERE doc_id IS NOT NULL)
SELECT example_id, id AS src, 'input' AS dst, 'relates_to' AS relation, NULL::DOUBLE AS similarity FROM x
UNION ALL SELECT example_id, id, 'ds::' || doc_title, 'attribution', NULL FROM x
UNION ALL SELECT a.example_id, a.id, b.id, 'text_overlap', round({_jaccard('a.s', 'b.s')}, 6) FROM x a JOIN x b ON a.item_id = b.item_id AND a.pos < b.pos AND a.filled AND b.filled WHERE {_jaccard('a.s', 'b.s')} > 0.3""",
    "topk_evidence": f"WITH {_TOP} SELECT item_id, CAST(k AS INT) AS k, round(score, 6) AS score, text FROM top",
    "structured_input": f"WITH {_TOP} SELECT example_id, dataset, structured_input, plain_input, CAST(len(passages) AS INT) AS num_evidence_selected, CAST(total AS INT) AS num_evidence_total, target_answer FROM full_",
    "light_projection": f"""WITH {UNITS} SELECT format('item_{{:06d}}_gold_full', item_id) AS example_id, 'ds' || any_value(ds) AS dataset,
  left(coalesce(string_agg({_strip('text')}, ' ' ORDER BY pos) FILTER (NOT {_blank('text')}), ''), 3000) AS evidence_text, 'sufficient' AS evidence_state_label FROM units GROUP BY item_id""",
    "question_and_passages": f"""WITH {_TOP} SELECT example_id, CAST(k AS INT) AS k, ps[k + 1] AS passage FROM (SELECT example_id, ps, unnest(CASE WHEN len(ps) = 0 THEN [NULL::BIGINT] ELSE range(len(ps)) END) AS k FROM passage_list)""",
    "text_source_priority": """WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN text END AS structured, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS plain FROM documents)
SELECT doc_id, md5(left(coalesce(nullif(structured, ''), nullif(plain, ''), nullif(concat_ws(' ', lang, plain), '')), 5000)) AS text_md5 FROM r""",
    "text_truncations": "SELECT doc_id, " + ", ".join(f"CAST(least(length(text), {n}) AS INT) AS cut_{n}" for n in (120, 200, 256, 300, 500, 512, 1000, 2000, 3000, 5000, 10000)) + " FROM documents",
    "flatten_gold_units": _instance_units(rf"""WITH {_MULTI_HOP}, x AS (
  SELECT format('hotpotqa_{{:06d}}_gold_full', conv_id) AS example_id, 'sufficient' AS evidence_state_label, 'answer' AS agent_action_label, 'gold_full' AS condition, turn * 100000 + i AS ord,
         format('hotpotqa_{{:06d}}_turn_{{}}_sent_{{}}', conv_id, turn, i) AS evidence_id, md5(s) AS text_md5, 'turn ' || turn AS doc_title, 'hotpotqa::turn ' || turn AS source_doc_id, CAST(i AS INT) AS sentence_index, NULL::INT AS paragraph_index,
         'available' AS text_status, gold AS is_gold_evidence, CASE WHEN gold THEN 'supports' ELSE 'unknown' END AS support_role, CASE WHEN gold THEN 'gold_sentence' ELSE 'none' END AS label_strength,
         CASE WHEN gold THEN 1.0 ELSE 0.0 END::DOUBLE AS supervision_weight, 'sentence' AS provenance_granularity
  FROM hop WHERE n_gold > 0 AND regexp_matches(s, '\S'))"""),
    "paragraph_units": _instance_units(f"""WITH {_PARAGRAPHS}, x AS (
  SELECT DISTINCT ON (item_id, CASE WHEN ok THEN pos ELSE -1 END) format('musique_{{:06d}}_{{}}', item_id, CASE WHEN answerable THEN 'sufficient' ELSE 'insufficient' END) AS example_id, CASE WHEN answerable THEN 'sufficient' ELSE 'insufficient' END AS evidence_state_label,
         CASE WHEN answerable THEN 'answer' ELSE 'retrieve_more' END AS agent_action_label, CASE WHEN answerable THEN 'gold_full' ELSE 'unanswerable' END AS condition, CASE WHEN ok THEN pos ELSE -1 END AS ord,
         CASE WHEN ok THEN format('musique_{{:06d}}_{{}}_para_{{}}', item_id, left(replace(replace(doc_title, ' ', '_'), '''', ''), 30), pos) END AS evidence_id, CASE WHEN ok THEN md5(text) END AS text_md5,
         CASE WHEN ok THEN doc_title END AS doc_title, CASE WHEN ok THEN 'musique::' || doc_title END AS source_doc_id, NULL::INT AS sentence_index, CASE WHEN ok THEN pos END AS paragraph_index, CASE WHEN ok THEN 'available' END AS text_status,
         CASE WHEN ok THEN is_gold END AS is_gold_evidence, CASE WHEN ok THEN CASE WHEN is_gold THEN 'supports' ELSE 'unknown' END END AS support_role, CASE WHEN ok THEN CASE WHEN is_gold THEN 'gold_paragraph' ELSE 'none' END END AS label_strength,
         CASE WHEN ok THEN CASE WHEN is_gold THEN 0.8 ELSE 0.0 END END::DOUBLE AS supervision_weight, CASE WHEN ok THEN 'paragraph' END AS provenance_granularity
  FROM para WHERE (n_gold > 0 OR NOT answerable) AND (ok OR n_ok = 0))"""),
    "claim_reference_lookup": _instance_units(rf"""WITH c AS (
  SELECT d.doc_id, CASE WHEN quality = 1 THEN 'SUPPORTS' WHEN toxic = 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS label, source || '_' || d.doc_id AS page, text, d.doc_id % 4 AS sent FROM labels l JOIN documents d ON d.doc_id = l.doc_id
), r AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN replace(page, '_', ' ') ELSE page END AS url, nullif(string_split(text, chr(10))[sent + 1], '') AS found, label = 'NOT ENOUGH INFO' AS nei FROM c
), x AS (
  SELECT format('fever_{{:06d}}_{{}}', doc_id, CASE label WHEN 'SUPPORTS' THEN 'sufficient' WHEN 'REFUTES' THEN 'contradicted' ELSE 'insufficient' END) AS example_id, CASE label WHEN 'SUPPORTS' THEN 'sufficient' WHEN 'REFUTES' THEN 'contradicted' ELSE 'insufficient' END AS evidence_state_label,
         CASE label WHEN 'SUPPORTS' THEN 'answer' WHEN 'REFUTES' THEN 'flag_conflict' ELSE 'retrieve_more' END AS agent_action_label, CASE label WHEN 'SUPPORTS' THEN 'gold_full' WHEN 'REFUTES' THEN 'refuted' ELSE 'no_evidence' END AS condition, 0 AS ord,
         CASE WHEN nei THEN format('fever_{{:06d}}_no_evidence', doc_id) ELSE format('fever_{{:06d}}_{{}}_sent_{{}}', doc_id, left(replace(url, ' ', '_'), 30), sent) END AS evidence_id, CASE WHEN NOT nei THEN md5(found) END AS text_md5,
         CASE WHEN nei THEN 'none' ELSE url END AS doc_title, 'fever::' || CASE WHEN nei THEN 'none' ELSE url END AS source_doc_id, CASE WHEN NOT nei THEN CAST(sent AS INT) END AS sentence_index, NULL::INT AS paragraph_index,
         CASE WHEN nei THEN 'no_evidence' WHEN found IS NULL THEN 'unresolved_reference' ELSE 'available' END AS text_status, NOT nei AS is_gold_evidence, CASE label WHEN 'SUPPORTS' THEN 'supports' WHEN 'REFUTES' THEN 'refutes' ELSE 'unknown' END AS support_role,
         CASE WHEN nei THEN 'none' ELSE 'gold_sentence' END AS label_strength, CASE WHEN nei THEN 0.0 ELSE 1.0 END::DOUBLE AS supervision_weight, 'sentence' AS provenance_granularity FROM r)"""),
    "json_array_records": """WITH r AS (SELECT doc_id, source, '{"a\\": [}"\\\\' || text || '"}, {' AS t, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, source, md5(t) AS text_md5, CAST(len(l) AS INT) AS n_lines, md5(l[1]) AS first_md5 FROM r""",
    "wiki_line_parse": rf"""WITH l AS (SELECT source || '_' || doc_id AS page_id, unnest(range(len(string_split(text, chr(10))))) AS i, text FROM documents), s AS (SELECT page_id, CAST(i AS INT) AS sent_id, {_strip("string_split(text, chr(10))[i + 1]")} AS t FROM l)
SELECT page_id, sent_id, md5(t) AS text_md5 FROM s WHERE t <> ''""",
    "conversion_statistics": rf"""WITH {_MULTI_HOP}, {_PARAGRAPHS}, a AS (
  SELECT conv_id AS k, 'hotpotqa' AS dataset, count(*) AS u, count(*) FILTER (gold) AS g FROM hop WHERE n_gold > 0 AND regexp_matches(s, '\S') GROUP BY conv_id
  UNION ALL SELECT item_id, 'musique', count(*) FILTER (ok), count(*) FILTER (ok AND is_gold) FROM para WHERE n_gold > 0 OR NOT answerable GROUP BY item_id)
SELECT dataset, count(*) AS instances, CAST(sum(u) AS BIGINT) AS units, CAST(sum(g) AS BIGINT) AS gold, round(avg(u), 6) AS avg_units, round(avg(g), 6) AS avg_gold FROM a GROUP BY dataset""",
    "gold_membership": f"WITH {_MULTI_HOP} SELECT conv_id AS ordinal, count(*) AS sentences, count(*) FILTER (gold) AS gold FROM hop GROUP BY conv_id",
    "variant_insufficient": f"""WITH {_variant_units('insufficient')}, kept AS (SELECT u.* FROM units u JOIN picked k ON k.item_id = u.item_id AND u.pos <> k.at)
SELECT format('item_{{:06d}}_insufficient', k.item_id) AS example_id, 'insufficient' AS evidence_state_label, 'retrieve_more' AS agent_action_label, 'missing_evidence' AS condition, CAST(count(u.doc_id) AS INT) AS num_evidence_units,
       CAST(count(*) FILTER (u.is_gold) AS INT) AS num_gold_evidence_units, CAST(count(DISTINCT u.doc_title) AS INT) AS num_sources, format('doc_{{:06d}}', max_by(u.doc_id, u.pos)) AS last_id,
       max_by(CASE WHEN u.is_gold THEN 'supports' ELSE 'unknown' END, u.pos) AS last_role, NULL::VARCHAR AS last_version, '' AS outdated
FROM picked k LEFT JOIN kept u ON u.item_id = k.item_id GROUP BY k.item_id""",
    "variant_contradicted": _appended("contradicted", "flag_conflict", "contains_contradiction", "_contradicting", "refutes", "NULL::VARCHAR", "''", _drawn(_CONTRADICTIONS, "42|contradicted|wording")),
    "variant_superseded": _appended("superseded", "verify", "contains_outdated", "_v2_current", "supersedes", "'v2_current'", "format('doc_{:06d}', w.doc_id)", _drawn(_SUPERSESSIONS, "42|superseded|wording")),
    "variant_union_counts": f"""WITH {UNITS}, i AS (SELECT item_id, 'ds' || any_value(ds) AS dataset, bool_or(doc_id IS NOT NULL AND is_gold) AS g, bool_or(doc_id IS NOT NULL AND is_gold AND coalesce(text, '') <> '') AS gt FROM units GROUP BY item_id),
a AS (SELECT dataset, 'sufficient' AS state FROM i UNION ALL SELECT dataset, 'insufficient' FROM i WHERE g UNION ALL SELECT dataset, 'contradicted' FROM i WHERE gt UNION ALL SELECT dataset, 'superseded' FROM i WHERE gt)
SELECT 'overall' AS level, 'all' AS value, count(*) AS n FROM a UNION ALL SELECT 'evidence_state_label', state, count(*) FROM a GROUP BY state UNION ALL SELECT 'dataset', dataset, count(*) FROM a GROUP BY dataset""",
    "merge_split_balanced": f"""WITH {UNITS}, i AS (SELECT item_id, 'ds' || any_value(ds) AS dataset, bool_or(doc_id IS NOT NULL AND is_gold) AS g, bool_or(doc_id IS NOT NULL AND is_gold AND coalesce(text, '') <> '') AS gt FROM units GROUP BY item_id),
a AS (SELECT format('item_{{:06d}}_gold_full', item_id) AS example_id, dataset, 'sufficient' AS evidence_state_label FROM i UNION ALL SELECT format('item_{{:06d}}_insufficient', item_id), dataset, 'insufficient' FROM i WHERE g
      UNION ALL SELECT format('item_{{:06d}}_contradicted', item_id), dataset, 'contradicted' FROM i WHERE gt UNION ALL SELECT format('item_{{:06d}}_superseded', item_id), dataset, 'superseded' FROM i WHERE gt),
m AS (SELECT CASE WHEN count(*) = 4 THEN min(n) ELSE 0 END AS least FROM (SELECT count(*) AS n FROM a GROUP BY evidence_state_label))
SELECT example_id, dataset, evidence_state_label FROM a QUALIFY row_number() OVER (PARTITION BY evidence_state_label ORDER BY {_rank('42|balance', 'example_id')}, example_id) <= (SELECT least FROM m)""",
    "row_limit": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents ORDER BY doc_id LIMIT 100",
    "seeded_sample": f"SELECT doc_id, lang, source FROM documents ORDER BY {_rank('42|sample', 'doc_id')}, doc_id LIMIT 200",
    "balanced_classes": f"""WITH m AS (SELECT min(coalesce(n, 0)) AS least FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang))
SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_rank('42|balance', 'doc_id')}, doc_id) <= (SELECT least FROM m)""",
    "shuffled_order": f"SELECT doc_id, row_number() OVER (ORDER BY {_rank('42|shuffle', 'doc_id')}, doc_id) - 1 AS place FROM documents",
    "stratified_split": f"""SELECT doc_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY {_rank('42|split', 'doc_id')}, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY lang, source) * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM documents""",
    "validation_split": f"""SELECT doc_id, lang, source, CASE WHEN row_number() OVER (ORDER BY {_rank('42|validation', 'doc_id')}, doc_id) <= greatest(1, floor(count(*) OVER () * 0.1::DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "holdout_by_dataset": "SELECT h.lang AS held_out, CASE WHEN d.lang = h.lang THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) h GROUP BY 1, 2",
    "cross_validation_folds": "SELECT doc_id, lang, source, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS INT) AS fold FROM documents",
    "minimum_class_size": "SELECT min(n) AS smallest, CAST(sum(n) AS BIGINT) AS n, count(*) AS classes FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "split_statistics": f"""WITH {_TOP}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY {_rank('42|split', 'example_id')}, example_id) <= greatest(1, floor(count(*) OVER (PARTITION BY dataset) * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM full_)
SELECT split, count(*) AS n, round(avg(len(passages)), 6) AS avg_selected, round(avg(total), 6) AS avg_total, count(*) FILTER (coalesce(target_answer, '') <> '') AS with_answer FROM s GROUP BY split""",
    "pooled_splits": "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang",
    "feature_stats": f"WITH {FEATURED}, {_LONG} SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM long GROUP BY feature",
    "feature_means_by_state": f"WITH {FEATURED}, {_LONG} SELECT state, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY state, feature",
    "feature_zscores": f"WITH {FEATURED}, {_LONG}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-8 AS sd FROM long WHERE item_id % 5 <> 0 GROUP BY feature) SELECT item_id, feature, round((value - m) / sd, 6) AS value FROM long JOIN s USING (feature)",
    "normalizer_vector": f"WITH {FEATURED}, {_LONG} SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value) + 1e-8, 6) AS std FROM long GROUP BY feature",
    "feature_ablation": f"WITH {FEATURED}, k AS (SELECT CAST(unnest(range(8)) AS INT) AS dropped) SELECT dropped, " + ", ".join(f"round(sum(CASE WHEN dropped = {i} THEN 0.0::DOUBLE ELSE {c}::DOUBLE END), 4) AS {c}" for i, c in enumerate(FEATURES)) + " FROM feat CROSS JOIN k GROUP BY dropped",
    "feature_corr": f"WITH {FEATURED} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_pop({a}::DOUBLE, {b}::DOUBLE) / nullif(stddev_pop({a}::DOUBLE) * stddev_pop({b}::DOUBLE), 0), 6) AS r FROM feat" for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]),
    "feature_minmax_heatmap": f"WITH {FEATURED}, {_LONG}, m AS (SELECT state, feature, avg(value) AS a FROM long GROUP BY state, feature) SELECT state, feature, round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w + 1e-8), 6) AS scaled FROM m WINDOW w AS (PARTITION BY feature)",
    "feature_boxstats": f"""WITH {FEATURED}, {_LONG}, q AS (SELECT state, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY state, feature)
SELECT state, feature, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM long JOIN q USING (state, feature) GROUP BY state, feature""",
    "class_distribution": f"WITH {FEATURED} SELECT 'overall' AS level, 'all' AS value, count(*) AS n FROM feat UNION ALL SELECT 'state', state, count(*) FROM feat GROUP BY state UNION ALL SELECT 'dataset', dataset, count(*) FROM feat GROUP BY dataset",
    "dataset_state_pivot": f"WITH {FEATURED} SELECT dataset, " + ", ".join(f"round(avg(avg_evidence_length) FILTER (state = '{s}'), 6) AS {s}" for s in STATES) + " FROM feat GROUP BY dataset",
    "dataset_state_counts": f"WITH {FEATURED} SELECT dataset, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + " FROM feat GROUP BY dataset",
    "majority_baseline": f"""WITH p0 AS (SELECT quality AS true_, doc_id FROM labels), b AS (SELECT true_ AS best FROM p0 GROUP BY true_ ORDER BY count(*) DESC, min(doc_id) LIMIT 1), p AS (SELECT true_, best AS pred FROM p0 CROSS JOIN b), {_macro('p')} SELECT {_MACRO_OUT} FROM mac""",
    "confusion_matrix": f'WITH {_PREDICTIONS} SELECT true_ AS "true", pred, count(*) AS n FROM p GROUP BY true_, pred',
    "class_report": f"WITH {_PREDICTIONS}, {_macro('p')} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep",
    "macro_metrics": f"WITH {_PREDICTIONS}, {_macro('p')} SELECT {_MACRO_OUT} FROM mac",
    "per_dataset_metrics": f"WITH {_PREDICTIONS}, {_macro('p', 'dataset')} SELECT dataset, {_MACRO_OUT} FROM mac",
    "action_accuracy": f"""WITH {_PREDICTIONS}, n AS (SELECT {_list(STATES)}[true_ + 1] AS state, ['answer', 'retrieve_more', 'flag_conflict', 'verify'][true_ + 1] AS wanted, ['answer', 'retrieve_more', 'flag_conflict', 'verify'][pred + 1] AS taken FROM p)
SELECT state, wanted, count(*) AS n, round(avg((wanted = taken)::INT::DOUBLE), 6) AS accuracy FROM n GROUP BY state, wanted""",
    "running_accuracy": f"""WITH {_PREDICTIONS}, o AS (SELECT row_number() OVER w AS rows_seen, avg((true_ = pred)::INT::DOUBLE) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS a FROM p WINDOW w AS (ORDER BY doc_id))
SELECT rows_seen, round(a, 6) AS accuracy FROM o WHERE rows_seen % 100 = 0""",
    "token_f1_em": f"""WITH o AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations), a AS (SELECT conv_id, turn, {_words(_answer('text'))} AS p, {_words(_answer('gold'))} AS g FROM o WHERE role = 'user' AND gold IS NOT NULL)
SELECT conv_id, turn, round({_f1('p', 'g')}, 6) AS f1, (p = g)::INT::DOUBLE AS em FROM a""",
    "context_metrics": f"""WITH {_TOP}, m AS (
  SELECT example_id, ps, list_distinct({_plain('target_answer')}) AS g, {_content(_plain('input_text'), STOPWORDS_CONTEXT)} AS q, list_transform(ps, lambda p: list_distinct({_plain('p')})) AS s FROM passage_list
)
SELECT example_id,
  round(CASE WHEN len(s) = 0 OR len(g) = 0 THEN 0 ELSE len(list_filter(s, lambda p: len(list_intersect(p, g)) > 0))::DOUBLE / len(s) END, 6) AS context_precision,
  round(CASE WHEN len(s) = 0 OR len(g) = 0 THEN 0 ELSE len(list_intersect(g, flatten(s)))::DOUBLE / len(g) END, 6) AS context_recall,
  round(CASE WHEN len(s) = 0 OR len(q) = 0 THEN 0 ELSE list_sum(list_transform(s, lambda p: {_overlap('q', _content('p', STOPWORDS_CONTEXT))})) / len(s) END, 6) AS context_relevancy,
  round(CASE WHEN len(s) = 0 THEN 0 ELSE len(list_filter(ps, lambda p: length({_strip('p')}) > 10))::DOUBLE / len(s) END, 6) AS context_utilization,
  round(CASE WHEN len(s) = 0 OR len(g) = 0 THEN 0 ELSE list_max(list_transform(s, lambda p: len(list_intersect(g, p))::DOUBLE / len(g))) END, 6) AS answer_coverage FROM m""",
    "embedding_cosine": f"WITH {_SCORES} SELECT pair_id, round(score, 6) AS score FROM scores",
    "binary_threshold_sweep": f"""WITH {_SCORES}, p AS (SELECT k AS step, true_, CASE WHEN score >= k / 100.0::DOUBLE THEN 0 ELSE 1 END AS pred FROM scores CROSS JOIN (SELECT CAST(unnest(range(100)) AS INT) AS k)), {_macro('p', 'step')}
SELECT step, step / 100.0::DOUBLE AS threshold, round(macro_f1, 6) AS macro_f1 FROM mac""",
    "quartile_multithreshold": f"""WITH {_SCORES}, q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM scores)
SELECT true_ AS "true", CASE WHEN score >= c THEN 0 WHEN score >= b THEN 1 WHEN score >= a THEN 2 ELSE 3 END AS pred, count(*) AS n FROM scores CROSS JOIN q GROUP BY 1, 2""",
    "threshold_strategy": f"""WITH {_SCORES}, q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM scores),
p AS (SELECT CAST(k AS INT) AS step, true_, CASE WHEN score >= k / 100.0::DOUBLE THEN 0 ELSE 1 END AS pred FROM scores CROSS JOIN (SELECT unnest(range(100)) AS k)
      UNION ALL SELECT 100, true_, CASE WHEN score >= c THEN 0 WHEN score >= b THEN 1 WHEN score >= a THEN 2 ELSE 3 END FROM scores CROSS JOIN q), {_macro('p', 'step')},
b1 AS (SELECT step, macro_f1 FROM mac WHERE step < 100 ORDER BY macro_f1 DESC, step LIMIT 1), m1 AS (SELECT macro_f1 FROM mac WHERE step = 100)
SELECT CASE WHEN b1.macro_f1 > m1.macro_f1 THEN 'binary_threshold' ELSE 'multi_threshold' END AS strategy, step / 100.0::DOUBLE AS threshold, round(b1.macro_f1, 6) AS binary_f1, round(m1.macro_f1, 6) AS quartile_f1 FROM b1 CROSS JOIN m1""",
    "similarity_stats": f'WITH {_SCORES} SELECT true_ AS "true", round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS median, count(*) AS n FROM scores GROUP BY true_',
    "nli_argmax": """WITH l AS (SELECT vec_id, [list_max(list_filter(embedding, lambda v, i: i % 3 = 1)), list_max(list_filter(embedding, lambda v, i: i % 3 = 2)), list_max(list_filter(embedding, lambda v, i: i % 3 = 0))] AS x FROM embeddings) SELECT vec_id, CASE list_position(x, list_max(x)) - 1 WHEN 2 THEN 0 WHEN 0 THEN 2 ELSE 1 END AS state FROM l""",
    "passage_prompts": f"""WITH {_TOP}, k AS (SELECT example_id, input_text, ps, unnest(range(least(3, len(ps)))) AS k FROM passage_list)
SELECT example_id, CAST(k AS INT) AS k, md5('Question: ' || input_text || chr(10) || 'Passage: ' || left(ps[k + 1], 500) || chr(10) || chr(10) || 'Rate the passage: CORRECT, AMBIGUOUS or INCORRECT.') AS prompt_md5 FROM k""",
    "generation_prompts": f"""WITH {_TOP}, f AS (SELECT *, coalesce(ps[1], '') AS first FROM passage_list)
SELECT example_id, md5('Evidence:' || chr(10) || first || CASE WHEN dataset = 'ds0' THEN chr(10) || chr(10) || 'Is the claim SUPPORTS, REFUTES or NOT ENOUGH INFO? Verdict:' ELSE chr(10) || chr(10) || 'Give the answer in a few words:' END) AS prompt_md5 FROM f""",
    "named_entity_overlap": rf"""WITH {UNITS}, e AS (
  SELECT item_id, any_value(input_text) AS q, left(coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (doc_id IS NOT NULL AND NOT {_blank('text')}), ''), 10000) AS told FROM units GROUP BY item_id
), w AS (SELECT {_plain('text')} AS t FROM benchmark), names AS (SELECT DISTINCT ' ' || array_to_string(t[1:n], '  ') || ' ' AS title FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE len(t) > 0
), p AS (SELECT string_agg(title, '|' ORDER BY length(title) DESC, title) AS pattern FROM names
), x AS (SELECT item_id, list_distinct(regexp_extract_all(' ' || array_to_string({_plain('q')}, '  ') || ' ', pattern)) AS a, list_distinct(regexp_extract_all(' ' || array_to_string({_plain('told')}, '  ') || ' ', pattern)) AS b FROM e CROSS JOIN p)
SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 4) AS entity_overlap FROM x""",
    "running_macro_f1": f"""WITH {_PREDICTIONS}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM p), e AS (SELECT unnest(range(1, (SELECT count(*) FROM o) // 100 + 1)) * 100 AS rows_seen),
c AS (SELECT rows_seen, true_, pred, count(*) AS n FROM e JOIN o ON k <= rows_seen GROUP BY ALL),
sides AS (SELECT rows_seen, true_ AS label, n AS t, 0 AS q, CASE WHEN true_ = pred THEN n ELSE 0 END AS hit FROM c UNION ALL SELECT rows_seen, pred, 0, n, 0 FROM c),
r AS (SELECT rows_seen, label, 2.0::DOUBLE * sum(hit) / (sum(t) + sum(q)) AS f1 FROM sides GROUP BY ALL)
SELECT rows_seen, round(avg(f1), 6) AS macro_f1 FROM r GROUP BY rows_seen""",
    "dataset_key_features": f"WITH {FEATURED}, k AS (UNPIVOT (SELECT dataset, state, entity_overlap::DOUBLE AS entity_overlap, text_resolution_rate::DOUBLE AS text_resolution_rate, duplicate_rate::DOUBLE AS duplicate_rate, evidence_count::DOUBLE AS evidence_count FROM feat) ON entity_overlap, text_resolution_rate, duplicate_rate, evidence_count INTO NAME feature VALUE value) SELECT dataset, feature, "
    + ", ".join(f"round(avg(value) FILTER (state = '{s}'), 6) AS {s}" for s in STATES)
    + " FROM k GROUP BY dataset, feature",
    "detector_split": f"""WITH {UNITS}, i AS (SELECT item_id, 'ds' || any_value(ds) AS dataset, bool_or(doc_id IS NOT NULL AND is_gold) AS g, bool_or(doc_id IS NOT NULL AND is_gold AND coalesce(text, '') <> '') AS gt FROM units GROUP BY item_id),
a AS (SELECT format('item_{{:06d}}_gold_full', item_id) AS example_id, dataset, 0 AS label FROM i UNION ALL SELECT format('item_{{:06d}}_insufficient', item_id), dataset, 1 FROM i WHERE g
      UNION ALL SELECT format('item_{{:06d}}_contradicted', item_id), dataset, 2 FROM i WHERE gt UNION ALL SELECT format('item_{{:06d}}_superseded', item_id), dataset, 3 FROM i WHERE gt),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label, dataset ORDER BY {_rank('42|split', 'example_id')}, example_id) <= greatest(1, floor(count(*) OVER (PARTITION BY label, dataset) * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM a),
c AS (SELECT label, count(*) AS k FROM r WHERE split = 'train' GROUP BY label), s AS (SELECT sum(k) AS n, count(*) AS m FROM c)
SELECT r.example_id, r.dataset, r.label, r.split, round(CASE WHEN r.split = 'train' THEN n::DOUBLE / (m * k) END, 6) AS weight FROM r LEFT JOIN c USING (label) CROSS JOIN s""",
    "nli_label_map": "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 2 THEN 0 WHEN 0 THEN 2 ELSE 1 END AS state FROM conversations",
    "llm_label_parse": f"""WITH r AS (SELECT conv_id, turn, lower({_strip(f"string_split({_strip(_canned('state', 'conv_id + turn'))}, chr(10))[1]")}) AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(l, 'insufficient') THEN 1 WHEN contains(l, 'superseded') THEN 3 WHEN contains(l, 'contradict') THEN 2 ELSE 0 END AS state FROM r""",
    "rating_vote": f"""WITH r AS (SELECT conv_id, upper({_canned('rating', 'conv_id * 3 + turn')}) AS u FROM conversations), c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (contains(u, 'INCORRECT')) AS bad, count(*) FILTER (NOT contains(u, 'INCORRECT') AND contains(u, 'AMBIGUOUS')) AS unsure FROM r GROUP BY conv_id)
SELECT conv_id, CASE WHEN bad > 0 THEN 2 WHEN unsure > n - unsure THEN 1 WHEN unsure = 0 THEN 0 ELSE 1 END AS state FROM c""",
    "critic_parse": "SELECT conv_id, turn, [0, 1, 2, 1, 1][(conv_id + turn) % 5 + 1] AS state FROM conversations",
    "answer_cleanup": "SELECT conv_id, turn, ['Paris', 'Rome', 'answer: x', 'plain', 'y'][(conv_id + turn) % 5 + 1] AS answer FROM conversations",
    "prompt_texts": f"""WITH {_TOP}, f AS (SELECT *, coalesce(ps[1], '') AS first FROM passage_list)
SELECT example_id, md5('Question with retrieved evidence:' || chr(10) || left(structured_input, 2000) || chr(10) || chr(10) || 'Is the evidence sufficient, insufficient, contradicted or superseded? Reply with one of these words:') AS state_md5,
  md5('Question: ' || input_text || chr(10) || 'Passage: ' || left(first, 500) || chr(10) || chr(10) || 'Rate the passage: CORRECT, AMBIGUOUS or INCORRECT.') AS passage_md5,
  md5('Question: ' || input_text || chr(10) || 'Evidence:' || chr(10) || left(array_to_string(ps[1:5], chr(10)), 1000) || chr(10) || chr(10) || 'First line RELEVANT: YES or NO. Second line SUPPORT: FULLY, PARTIALLY or NO.') AS critic_md5,
  md5('Evidence:' || chr(10) || first || chr(10) || chr(10) || 'Give the answer in a few words:') AS answer_md5,
  md5('Evidence:' || chr(10) || first || chr(10) || chr(10) || 'Is the claim SUPPORTS, REFUTES or NOT ENOUGH INFO? Verdict:') AS verdict_md5 FROM f""",
    "question_groups": f"WITH {_VARIANTS} SELECT g.question, g.last AS ordinal, md5(v.evidence) AS evidence_md5, n_variants, n_states, n_states = 4 AS complete FROM g JOIN v ON v.question = g.question AND v.ordinal = g.last",
    "remediation_swap": f"WITH {_VARIANTS} SELECT question, ordinal, state, predicted, detector_correct, gold, naive_answer, guided_answer, oracle_answer FROM answers",
    "end_to_end_details": f"WITH {_SCORED} SELECT question, ordinal, round(f1_naive, 6) AS f1_naive, round(f1_guided, 6) AS f1_guided, round(f1_oracle, 6) AS f1_oracle, em_naive, em_guided, em_oracle FROM scored",
    "end_to_end_summary": f"""WITH {_SCORED}, a AS ({_summary('overall', "'all'", '')} UNION ALL {_summary('state', 'state', 'GROUP BY state')} UNION ALL {_summary('dataset', 'dataset', 'GROUP BY dataset')})
SELECT level, value, n, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("detector_accuracy", "f1_naive", "f1_guided", "f1_oracle", "em_naive", "em_guided", "em_oracle")) + """, round(f1_guided - f1_naive, 6) AS improvement, round(f1_oracle - f1_naive, 6) AS oracle_gap,
  round(CASE WHEN f1_oracle - f1_naive > 0 THEN 100 * (f1_guided - f1_naive) / (f1_oracle - f1_naive) ELSE 0.0 END, 6) AS recovery FROM a""",
    "normalized_answers": f"SELECT conv_id, turn, md5({_answer('text')}) AS answer_md5, CAST(len({_plain('text')}) AS INT) AS plain_tokens, CAST(len({_set('text')}) AS INT) AS distinct_tokens FROM conversations",
    "title_slugs": """SELECT p_partkey, left(replace(replace(t, ' ', '_'), '''', ''), 30) AS slug, left(replace(t, ' ', '_'), 30) AS quoted, format('part_{:06d}', p_partkey * 997) AS name,
  CASE p_partkey % 3 WHEN 2 THEN 'x_y_superseded' ELSE 'x_superseded' END AS variant FROM (SELECT p_partkey, p_name || ' o''x ' || p_brand AS t FROM part)""",
    "daily_event_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
ORACLES["bucketed_reference_lookup"] = ORACLES["claim_reference_lookup"]
