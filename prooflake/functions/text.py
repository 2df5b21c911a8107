"""Text functions as column builders; everything stays in the JVM.

Tokens are split on Unicode white space including 0x1C-0x1F, after lower-casing; sets are distinct tokens in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Pieces between white space, none of them empty."""
    return F.filter(F.split(_col(text), SPACE), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    return words(F.lower(_col(text)))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def content(tokens_: Column, stopwords: list[str]) -> Column:
    """Distinct tokens without the stop words."""
    return F.array_except(tokens_, F.array(*(F.lit(w) for w in stopwords)))


def plain_tokens(text: Column | str) -> Column:
    """Tokens after deletion of all that is neither a word character nor white space (Unicode classes)."""
    return words(F.regexp_replace(F.lower(_col(text)), r"(?U)[^\w\s]", ""))


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(_col(text).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def head(text: Column | str, n: int) -> Column:
    """The first n code points."""
    return F.substring(_col(text), 1, n)


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, 0.0).otherwise(ratio(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))))


def query_overlap(query: Column, other: Column) -> Column:
    """Share of the query's content words among the other's; 0 if either has none."""
    empty = (F.size(query) == 0) | (F.size(other) == 0)
    return F.when(empty, 0.0).otherwise(ratio(F.size(F.array_intersect(query, other)), F.size(query)))


def normalize_answer(text: Column | str) -> Column:
    """Lower case, articles to spaces, ASCII punctuation deleted, white space collapsed, in this order."""
    lowered = strip(F.lower(_col(text)))
    bare = F.regexp_replace(lowered, r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(words(F.translate(bare, PUNCTUATION, "")), " ")


def answer_tokens(text: Column | str) -> Column:
    return words(normalize_answer(text))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it: it is bound as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered_words(tokens_: Column) -> Column:
    """Each token with the number of equal ones before it, so that sets of these are multisets of tokens."""
    return let(F.array_sort(tokens_), lambda words_: F.transform(words_, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(words_, w)).cast("string"))))


def token_f1(prediction: Column | str, gold: Column | str) -> Column:
    def score(both: Column) -> Column:
        p, g = F.size(both["p"]), F.size(both["g"])
        return let(F.size(F.array_intersect(both["p"], both["g"])), lambda common: F.when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).when((p == 0) | (common == 0), 0.0).otherwise(2.0 * common / (p + g)))

    return let(F.struct(numbered_words(answer_tokens(prediction)).alias("p"), numbered_words(answer_tokens(gold)).alias("g")), score)


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return F.when(normalize_answer(prediction) == normalize_answer(gold), 1.0).otherwise(0.0)


def title_slug(title: Column | str, keep_quotes: bool = False) -> Column:
    slug = F.replace(_col(title), F.lit(" "), F.lit("_"))
    return head(slug if keep_quotes else F.replace(slug, F.lit("'"), F.lit("")), 30)


def numbered(prefix: Column | str, ordinal: Column) -> Column:
    """prefix_000123: at least six digits, more if needed."""
    return F.format_string("%s_%06d", prefix if isinstance(prefix, Column) else F.lit(prefix), ordinal)


def renamed_example(example_id: Column | str, state: str) -> Column:
    """The id of a variant: gold_full, else sufficient, is replaced; an id with neither gets a suffix."""
    old = _col(example_id)
    first = F.replace(old, F.lit("gold_full"), F.lit(state))
    second = F.replace(old, F.lit("sufficient"), F.lit(state))
    return F.when(first != old, first).when(second != old, second).otherwise(F.concat(old, F.lit("_" + state)))


def cosine(left: Column | str, right: Column | str) -> Column:
    """With 1e-8 added to either norm."""
    a, b = _col(left), _col(right)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-8) * (F.sqrt(dot(b, b)) + 1e-8))


def hash_rank(stream: str, *keys: Column) -> Column:
    """A portable pseudo-random number below 2^32 of a row's key; each stream of draws has its own."""
    joined = F.concat_ws("|", F.lit(stream), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def structured_input(query: Column | str, passages: Column) -> Column:
    return F.array_join(F.concat(F.array(_col(query)), passages), " [SEP] ")


def first_filled(*texts: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_col(t), F.lit("")) for t in texts))


def passages_of(structured: Column | str) -> Column:
    """What follows the question in a structured input: stripped, empty ones dropped."""
    parts = F.split(_col(structured), r"\[SEP\]")
    return F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip), lambda p: p != "")
