"""The eight label-free features of an evidence set, as expressions over its array of units: no shuffle, no explode.

Titles are compared in order, after a sort; what takes the texts' tokens is measured in operators/similarity.py, in one pass. Where units are rows,
as sets may be too large for an array, from_rows() has the same features from sums (operators/unit_blocks.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prooflake.functions import text as T
from prooflake.functions.vocabulary import STATES, STOPWORDS_EVIDENCE
from prooflake.operators import unit_blocks, variants
from prooflake.operators.similarity import measured, measured_changes, words_of
from prooflake.storage import stored

DUPLICATE, SIMILAR = 0.5, 0.3


def filled_texts(units: Column) -> Column:
    return F.filter(F.transform(units, lambda u: u["text"]), lambda t: ~T.is_blank(t))


def features(query: Column, units: Column, told: Column) -> dict[str, Column]:
    """told: what similarity.measured says of the texts and the query's words (a column, so it is computed once)."""
    titles = F.filter(F.transform(units, lambda u: u["doc_title"]), named)
    # in order, a title that occurs again has an equal neighbour
    same = lambda ts, t, k: F.coalesce(F.get(ts, k) == t, F.lit(False))
    shared = T.let(F.sort_array(titles), lambda ts: F.size(F.filter(ts, lambda t, i: same(ts, t, i - 1) | same(ts, t, i + 1))))
    return _values(F.size(units), F.size(F.array_distinct(titles)), shared, told, F.size(asked_words(query)))


def named(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).isin("", "none") == F.lit(False)


def _values(n: Column, sources: Column, shared: Column, told: Column | dict[str, Column], asked: Column) -> dict[str, Column]:
    """n: units; sources: their different titles; shared: units whose title is that of others too; asked: words asked for."""
    pairs = told["n"].cast("long") * (told["n"] - 1) / 2
    mean = told["total"] / F.greatest(told["n"], F.lit(1))
    return {
        "source_diversity": sources,
        "text_resolution_rate": F.round(T.ratio(told["n"], n), 4),
        "avg_evidence_length": F.rint(mean * 100) / 100,
        "min_evidence_length": F.coalesce(told["least"], F.lit(0)),
        "duplicate_rate": F.round(told["similar"] / F.greatest(pairs, F.lit(1.0)), 4),
        "document_overlap_rate": F.round(T.ratio(shared, n), 4),
        "entity_overlap": F.round(T.ratio(told["met"], asked), 4),
        "evidence_count": n,
    }


def from_rows(told: DataFrame, titles: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, state, graph_features) of each row of keys (key, state, n_asked), from unit_blocks.measured() and counts (key, state, title, n; some may be
    taken off by a negative n). No array of units is built, so a key may have any number."""
    counts = titles.groupBy("key", "state", "title").agg(F.sum("n").alias("n")).where("n > 0")
    is_named = named(F.col("title"))
    of_titles = counts.groupBy("key", "state").agg(
        F.sum("n").alias("units"), F.sum(F.when(is_named, 1).otherwise(0)).alias("sources"), F.sum(F.when(is_named & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("shared"),
    )
    every = told.unionByName(of_titles, allowMissingColumns=True).unionByName(keys.withColumn("present", F.lit(True)), allowMissingColumns=True)
    whole = {c: F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in ("units", "sources", "shared")}
    rows = every.groupBy("key", "state").agg(*(c.alias(f"told_{name}") for name, c in unit_blocks.together().items()), *whole.values(), F.max("n_asked").alias("n_asked"), F.max("present").alias("present"))
    told_ = {name: F.col(f"told_{name}") for name in ("n", "total", "least", "similar")} | {"met": F.when(F.col("n_asked").isNotNull(), F.col("told_met"))}
    found = _values(F.col("units"), F.col("sources"), F.col("shared"), told_, F.col("n_asked"))
    return rows.where("present").select("key", "state", F.struct(*(c.alias(name) for name, c in found.items())).alias("graph_features"))


def asked_words(query: Column) -> Column:
    """Without stop words in the query those of the evidence meet nothing."""
    return T.content(T.token_set(query), STOPWORDS_EVIDENCE)


def with_features(instances: DataFrame, query: str = "input_text", units: str = "evidence_units", words: bool = False) -> DataFrame:
    """instances with a struct graph_features. words: units have a field words (similarity.coded), which is taken instead of their texts."""
    rows = instances.withColumn("_told", measured(words_of(units, words), asked_words(F.col(query)), DUPLICATE))
    return _described(rows, query, units)


def _described(rows: DataFrame, query: str, units: str) -> DataFrame:
    found = features(F.col(query), F.col(units), F.col("_told"))
    return rows.withColumn("graph_features", F.struct(*(c.alias(name) for name, c in found.items()))).drop("_told")


def all_states_with_features(instances: DataFrame, seed: int = 42, words: bool = False) -> DataFrame:
    """with_features(variants.all_states(instances)), from one pass over the texts: a variant differs from its instance by one text, so the sufficient
    instances are stored with what is measured of all four. words: units have a field words, which is taken and dropped; of the texts themselves
    variants.TEXT_TAKEN characters are enough then."""
    base = variants.sufficient_only(instances)
    changes = F.transform(variants.changes(seed), lambda c: F.struct(c["gone"].alias("gone"), F.lower(c["new"]).alias("new")))
    told = measured_changes(words_of("evidence_units", words), asked_words(F.col("input_text")), changes, DUPLICATE)
    base = base.withColumn("_all", told)
    if words:
        base = base.withColumn("evidence_units", F.transform("evidence_units", lambda u: u.dropFields("words")))
    states = variants.all_states(stored(base, "measured-instances"), seed)
    place = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("evidence_state_label")).cast("int")
    return _described(states.withColumn("_told", F.element_at("_all", place)).drop("_all"), "input_text", "evidence_units")


def entity_overlap(instances: DataFrame, extract, query: str = "input_text", units: str = "evidence_units", most: int = 10_000) -> DataFrame:
    """instances with entity_overlap from a pluggable extractor: extract(list of texts) -> list of entity lists, called on Arrow batches.

    The share of the query's entities (lower-cased) among those of the joined evidence, cut to `most` characters; 0 without query entities.
    """
    @F.pandas_udf("array<string>")
    def entities(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({e.lower() for e in found}) for found in extract(texts.fillna("").tolist())])

    joined = F.substring(F.array_join(filled_texts(F.col(units)), " "), 1, most)
    rows = instances.withColumn("_asked", entities(F.col(query))).withColumn("_told", entities(joined))
    share = F.when(F.size("_asked") == 0, 0.0).otherwise(T.ratio(F.size(F.array_intersect("_asked", "_told")), F.size("_asked")))
    return rows.withColumn("entity_overlap", F.round(share, 4)).drop("_asked", "_told")


#: Titles that go along as an automaton; longer lists are met by joins.
MOST_TITLES = 200_000


def _spaced(tokens: Column) -> Column:
    """Tokens with a space on each side of each, so that a title's is found only as whole tokens and neighbours share no space."""
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def titles_by_automaton(tokens: Column, names: DataFrame) -> Column:
    """The different titles (names: title as _spaced has it, of a checked number) in a row's tokens, by an Aho-Corasick automaton that goes along by
    broadcast: from the left, where several begin at one token the longest, none over another."""
    shared = names.sparkSession.sparkContext.broadcast([r[0] for r in names.collect()])

    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for title in shared.value:
            automaton.add_word(title, title)
        if shared.value:
            automaton.make_automaton()

        def longest(text: str) -> list[str]:
            begun: dict[int, str] = {}
            for last, title in automaton.iter(text) if shared.value else ():
                first = last - len(title) + 1
                if len(title) > len(begun.get(first, "")):
                    begun[first] = title
            out, free = set(), 0
            for first in sorted(begun):
                if first >= free:
                    out.add(begun[first])
                    free = first + len(begun[first])
            return sorted(out)

        for part in texts:
            yield part.map(longest)

    return found(_spaced(tokens))


def titles_by_join(rows: DataFrame, key: str, tokens: str, names: DataFrame) -> DataFrame:
    """(key, titles): the same without a bound on the number of titles: every run of tokens up to the longest title's length is looked up."""
    longest = names.agg(F.max(F.size(F.split(F.trim("title"), "  ")))).first()[0] or 0
    runs = rows.select(F.col(key).alias("_key"), F.col(tokens).alias("t")).select("_key", "t", F.posexplode("t").alias("at", "_"))
    runs = runs.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.size("t") - F.col("at")))))
    hits = runs.select("_key", "at", "n", _spaced(F.slice("t", F.col("at") + 1, F.col("n"))).alias("title")).join(names, "title")
    # of those that begin at one token the longest, then from the left what begins behind the last one taken
    first = hits.groupBy("_key", "at").agg(F.max(F.struct("n", "title")).alias("h")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "h.n", "h.title"))).alias("hits"))
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("titles"))
    step = lambda so_far, h: F.when(h["at"] >= so_far["end"], F.struct((h["at"] + h["n"]).alias("end"), F.array_append(so_far["titles"], h["title"]).alias("titles"))).otherwise(so_far)
    return first.select(F.col("_key").alias(key), F.array_distinct(F.aggregate("hits", nothing, step)["titles"]).alias("titles"))


def gazetteer_overlap(instances: DataFrame, titles: DataFrame, key: str, query: str = "input_text", units: str = "evidence_units", most: int = 10_000) -> DataFrame:
    """instances with entity_overlap, whose entities are the titles (one column, text) that occur as whole words: the share of the query's among
    those of the joined evidence, cut to `most` characters; 0 without any in the query. Case and punctuation don't count."""
    names = titles.select(T.plain_tokens(titles.columns[0]).alias("t")).where(F.size("t") > 0).select(_spaced(F.col("t")).alias("title")).distinct()
    names = stored(names, "titles")
    joined = F.substring(F.array_join(filled_texts(F.col(units)), " "), 1, most)
    rows = instances.withColumns({"_q": T.plain_tokens(F.coalesce(F.col(query), F.lit(""))), "_e": T.plain_tokens(F.coalesce(joined, F.lit("")))})
    if names.limit(MOST_TITLES + 1).count() <= MOST_TITLES:
        rows = rows.withColumns({"_asked": titles_by_automaton(F.col("_q"), names), "_told": titles_by_automaton(F.col("_e"), names)})
    else:
        none = F.array().cast("array<string>")
        for column, tokens in (("_asked", "_q"), ("_told", "_e")):
            found = titles_by_join(rows, key, tokens, names).select(F.col(key).alias("_k"), F.col("titles").alias("_t"))
            rows = rows.join(found, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_t", none)).drop("_k", "_t")
    share = F.when(F.size("_asked") == 0, 0.0).otherwise(T.ratio(F.size(F.array_intersect("_asked", "_told")), F.size("_asked")))
    return rows.withColumn("entity_overlap", F.round(share, 4)).drop("_q", "_e", "_asked", "_told")


def ablated(vector: Column, dropped: int) -> Column:
    """A feature array with one entry set to 0."""
    return F.transform(vector, lambda x, i: F.when(i == dropped, F.lit(0.0)).otherwise(x))
