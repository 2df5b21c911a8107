"""Pairs of token sets over a Jaccard similarity, exact: sizes, then the shared rare tokens, rule out nearly all pairs before any is compared.

Sets are put in order of size, so those that a set can be similar to stand together. Of the tokens, those of few sets meet by lists of the
sets that hold them; what two sets share of the others is at most the smaller number of them that either has. Only where both together could
reach the threshold the frequent tokens are compared, as bits. Nothing is hashed or sampled, and rows are taken in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: A token is frequent if over this share of the sets, and over so many, have it.
FREQUENT_SHARE, FREQUENT_SETS = 0.02, 16
#: Meetings of rare tokens, and cells of pairs, that a block of rows has (a single row may have more).
BLOCK = 1 << 18
#: Bytes of text whose words are told apart at once.
TEXT_BLOCK = 1 << 18
_SLACK = 1 - 1e-9


def _bits(rows: np.ndarray, bits: np.ndarray, n: int, width: int) -> np.ndarray:
    """n rows of `width` bits, packed in words."""
    words = np.zeros((n, -(-width // 64)), np.uint64)
    np.bitwise_or.at(words, (rows, bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return words


def similar(tokens: np.ndarray, sizes: np.ndarray, threshold: float, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (i, j, similarity), i < j, over the threshold (above 0). tokens: numbers of the sets' tokens, set after set; sizes: of the sets.
    of: the set of each token, if they are in another order."""
    yield from Index(tokens, sizes, of).own(threshold)


class _Rows:
    """Sets in order of size, with their tokens (row: the rank of its set) in order; place: of each rank its set."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, of: np.ndarray | None) -> None:
        n = len(sizes)
        self.place = np.argsort(sizes, kind="stable")
        self.size = sizes[self.place]
        rank = np.empty(n, np.int64)
        rank[self.place] = np.arange(n)
        bound = int(tokens.max()) + 1 if len(tokens) else 1
        self.row, self.token = np.divmod(_sorted((np.repeat(rank, sizes) if of is None else rank[of]) * bound + tokens), bound)

    def told_apart(self, frequent: np.ndarray, number: np.ndarray, width: int, held: np.ndarray, least: int) -> None:
        """The frequent tokens become bits; of the others those stay that `least` sets of the index hold."""
        often = frequent[self.token]
        self.words = _bits(self.row[often], number[self.token[often]], len(self.size), width)
        self.n_often = np.bincount(self.row[often], minlength=len(self.size))
        rare = ~often & (held[self.token] >= least)
        self.row, self.token = self.row[rare], self.token[rare]
        self.begin = np.searchsorted(self.row, np.arange(len(self.size) + 1))


class Index:
    """Sets that meet each other, or others: lists of the sets that hold a rare token, bits of the frequent ones."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, of: np.ndarray | None = None) -> None:
        n = len(sizes)
        self.rows = _Rows(tokens, sizes, of)
        self.held = np.bincount(self.rows.token) if len(tokens) else np.zeros(0, np.int64)
        self.frequent = self.held > max(FREQUENT_SETS, FREQUENT_SHARE * n)
        self.number, self.width = np.cumsum(self.frequent) - 1, int(self.frequent.sum())
        self.rows.told_apart(self.frequent, self.number, self.width, self.held, 1)
        listed = np.argsort(self.rows.token, kind="stable")
        self.lists = self.rows.row[listed]  # the ranks of a token's sets, ascending
        self.keys = self.rows.token[listed] * (n + 1) + self.lists

    def own(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the sets of the index, i < j."""
        size = self.rows.size
        # a set meets those behind it, up to the size at which their sizes alone rule it out
        for i, j, ratio in self._met(self.rows, np.arange(1, len(size) + 1), np.searchsorted(size * (threshold * _SLACK), size, "right"), threshold):
            yield np.minimum(i, j), np.maximum(i, j), ratio

    def others(self, tokens: np.ndarray, sizes: np.ndarray, of: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, similarity) of other sets i with the sets j of the index. tokens: those that sets of the index have; sizes: of the sets with all tokens."""
        rows = _Rows(tokens, sizes, of)
        rows.told_apart(self.frequent, self.number, self.width, self.held, 1)
        size = self.rows.size
        yield from self._met(rows, np.searchsorted(size, rows.size * (threshold * _SLACK), "left"), np.searchsorted(size * (threshold * _SLACK), rows.size, "right"), threshold)

    def _met(self, rows: _Rows, low: np.ndarray, high: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each row meets the ranks from low to high; both ascend. Rows are taken in runs of tokens, and these in blocks."""
        a, n = 0, len(rows.size)
        while a < n:
            e = max(a + 1, int(np.searchsorted(rows.begin, rows.begin[a] + BLOCK, "right")) - 1)
            row, key = rows.row[rows.begin[a] : rows.begin[e]], rows.token[rows.begin[a] : rows.begin[e]] * (len(self.rows.size) + 1)
            first = np.searchsorted(self.keys, key + low[row])
            many = np.maximum(np.searchsorted(self.keys, key + high[row]) - first, 0)
            at = rows.begin[a : e + 1] - rows.begin[a]
            cost = np.maximum(np.diff(_sums(many)[at]), high[a:e] - low[a:e])
            while a < e:
                b, base = a + 1, e - len(cost)
                spent = int(cost[a - base])
                while b < e and spent + cost[b - base] <= BLOCK and (b + 1 - a) * (int(high[b]) - int(low[a])) <= 2 * BLOCK:
                    spent += int(cost[b - base])
                    b += 1
                if high[b - 1] > low[a]:
                    of = slice(at[a - base], at[b - base])
                    yield from self._block(rows, a, b, low[a:b], high[a:b], row[of], first[of], many[of], threshold)
                a = b

    def _block(self, rows, a, b, low, high, row, first, many, threshold):
        start, width = int(low[0]), int(high[-1] - low[0])
        total = int(many.sum())
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(total)
        met = np.bincount(np.repeat((row - a) * width - start, many) + self.lists[at], minlength=(b - a) * width).reshape(b - a, width)
        x, y = rows.size[a:b, None], self.rows.size[None, start : start + width]
        most = np.minimum(rows.n_often[a:b, None], self.rows.n_often[None, start : start + width])
        most += met
        possible = most > (x + y) * (threshold / (1 + threshold) * _SLACK)
        i, j = np.nonzero(possible)
        ok = (j + start >= low[i]) & (j + start < high[i])
        i, j = i[ok], j[ok]
        for k in range(0, len(i), BLOCK // 8):
            p, q = i[k : k + BLOCK // 8], j[k : k + BLOCK // 8]
            shared = met[p, q]
            for w in range(self.rows.words.shape[1]):
                shared = shared + np.bitwise_count(rows.words[p + a, w] & self.rows.words[q + start, w])
            ratio = shared / (rows.size[p + a] + self.rows.size[q + start] - shared)
            over = ratio > threshold
            yield rows.place[p[over] + a], self.rows.place[q[over] + start], ratio[over]


def _sorted(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values


#: White space of T.SPACE beyond that of ASCII text: characters of two and three bytes (0x1C to 0x1F besides).
_SPACES_2, _SPACES_3 = (np.array([int.from_bytes(chr(c).encode()) for c in codes]) for codes in ((0x85, 0xA0), (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _only_plain_spaces(texts: pa.Array) -> bool:
    """Whether texts have no white space but space and 0x09 to 0x0D, so that those bytes alone part their words."""
    if texts.type != pa.string():
        return False
    ends = np.frombuffer(texts.buffers()[1], np.int32)[[texts.offset, texts.offset + len(texts)]]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[1]]
    if np.any((data >= 28) & (data < 32)):
        return False
    two, three = np.nonzero(data == 0xC2)[0], np.nonzero((data >= 0xE1) & (data <= 0xE3))[0]
    after = lambda at, k: data[at + k].astype(np.int64)
    return not (np.isin(0xC200 | after(two, 1), _SPACES_2).any() or np.isin(after(three, 0) << 16 | after(three, 1) << 8 | after(three, 2), _SPACES_3).any())


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of at most TEXT_BLOCK bytes, or of one text."""
    size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(int(np.searchsorted(size, (size[a - 1] if a else 0) + TEXT_BLOCK, "right")), a + 1)
        yield texts.slice(a, b - a)
        a = b


def _set_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(tokens of the sets as numbers, sizes of the sets, numbers of tokens, different tokens) of lower-cased texts. Arrow's white space is that of
    T.SPACE. Words are told apart in runs of texts, of which only different tokens stay, so that their table is small and repeats don't add up."""
    lengths, sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for part in _parts(texts.fill_null("")):
        words = pc.ascii_split_whitespace(part) if _only_plain_spaces(part) else pc.utf8_split_whitespace(part)
        many = np.asarray(words.value_lengths()).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        bits = len(coded.dictionary).bit_length()
        kind = np.int32 if len(many).bit_length() + bits < 31 else np.int64
        key = _sorted(np.repeat(np.arange(len(many), dtype=kind) << bits, many) | np.asarray(coded.indices))
        # white space at either end, and a text without anything else, give empty words
        empty = pc.index(coded.dictionary, "").as_py()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if empty >= 0:
            blank = (key & ((1 << bits) - 1)) == empty
            many = many - np.bincount(key[blank] >> bits, minlength=len(many))
            new &= ~blank
        key = key[new]
        lengths.append(many)
        sizes.append(np.bincount(key >> bits, minlength=len(many)))
        found.append(pa.DictionaryArray.from_arrays(pa.array((key & ((1 << bits) - 1)).astype(np.int32)), coded.dictionary.cast(pa.string())))
    whole = pa.chunked_array(found, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    tokens = np.concatenate([np.zeros(0, np.int32), *(np.asarray(c.indices) for c in whole.chunks)])
    return tokens, np.concatenate(sizes), np.concatenate(lengths), whole.chunk(0).dictionary if found else pa.array([], pa.string())


#: Words of so many bytes are numbers: their bytes, and above them their length, so 59 bits. Others stay words.
SHORT = 7
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(SHORT + 1)], np.int64)
#: Above a number there is room to tell so many texts apart.
_TOLD, _NUMBER = 32, (1 << 59) - 1
_CODED = pa.struct([("n", pa.int32()), ("short", pa.binary()), ("long", pa.string())])
_CODED_KIND = "struct<n: int, short: binary, long: string>"


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings or binaries."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return (ends - ends[0]).astype(np.int64), np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte and length of each word, words of each text); 0x09 to 0x0D and spaces part words."""
    ends, data = _bytes_of(texts)
    word = ((data - np.uint8(9)) > 4) & (data != 32)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    filled = ends[:-1] < ends[1:]
    for edges, at in ((begins, ends[:-1][filled]), (stops, ends[1:][filled] - 1)):
        edges[at] |= word[at]
    first = np.flatnonzero(begins)
    return data, first, np.flatnonzero(stops) + 1 - first, np.diff(np.searchsorted(first, ends))


def _numbers(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of words of at most SHORT bytes."""
    eight = np.ndarray(len(data) + 1, np.dtype("<i8"), np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    return (eight[first] & _LOW_BYTES[size]) | (size << 56)


def _sums(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _coded_run(texts: pa.Array) -> pa.Array:
    if not _only_plain_spaces(texts):
        texts = pc.binary_join(pc.utf8_split_whitespace(texts), " ")
    data, first, size, many = _words(texts)
    brief = size <= SHORT
    row = np.repeat(np.arange(len(many)), many)
    # short words: sorted inside their text, some texts at once, so that repeats stand together
    own = row[brief]
    key = _numbers(data, first[brief], size[brief]).view(np.uint64) | (own % _TOLD).astype(np.uint64) << np.uint64(59)
    cuts = np.searchsorted(own, np.arange(0, len(many) + _TOLD, _TOLD))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        key[a:b].sort()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    ends = _sums(np.bincount(own[new], minlength=len(many))) * 8
    short = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(key[new] & np.uint64(_NUMBER))])
    # the others: each with a space behind it
    wide = size[~brief] + 1
    last = np.cumsum(wide)
    at = np.repeat(first[~brief] - last + wide, wide) + np.arange(int(wide.sum()))
    copied = np.concatenate([data, np.zeros(1, np.uint8)])[at]
    copied[last - 1] = 32
    ends = _sums(np.bincount(row[~brief], wide, minlength=len(many))).astype(np.int32)
    long = pa.Array.from_buffers(pa.string(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(copied)])
    return pa.StructArray.from_arrays([pa.array(many.astype(np.int32)), short, long], fields=list(_CODED))


def _coded(texts: pa.Array) -> pa.Array:
    """Of each lower-cased text (null: empty) the number of its words, its different short words as numbers, and all others with a space behind each.
    Different words have different codes: nothing is hashed."""
    return pa.concat_arrays([pa.array([], _CODED), *map(_coded_run, _parts(texts.cast(pa.string()).fill_null("")))])


def coded(text: Column) -> Column:
    """A lower-cased text's words, as measured() and similar_rows() take them: made where the texts are read, so that no text has to be shuffled."""

    @F.arrow_udf(_CODED_KIND)
    def code(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(_coded, columns)

    return code(text)


def words_of(units: Column | str, words: bool) -> Column:
    """What measured() and similar_rows() take of an array of units: their field words, made by coded(), or else their texts."""
    return F.transform(units, lambda u: u["words"] if words else F.lower(u["text"]))


class _Sets(NamedTuple):
    """lengths: words of each text; sizes: of its set; of, tokens: the set and the number of each token; short, long: the different tokens."""

    lengths: np.ndarray
    sizes: np.ndarray
    of: np.ndarray
    tokens: np.ndarray
    short: pa.Array
    long: pa.Array

    def similar(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return similar(self.tokens, self.sizes, threshold, self.of)

    def index(self) -> Index:
        return Index(self.tokens, self.sizes, self.of)

    def met_by(self, index: Index, owner: _Sets, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, similarity) of these sets and those of another's index."""
        known = [np.asarray(pc.index_in(own, other).fill_null(-1)).astype(np.int64) for own, other in ((self.short, owner.short), (self.long, owner.long))]
        known[1][known[1] >= 0] += len(owner.short)
        token = np.concatenate(known)[self.tokens]
        yield from index.others(token[token >= 0], self.sizes, self.of[token >= 0], threshold)

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each different token the place of the word that it is, or -1."""
        of_short, of_long = {}, {}
        for k, word in enumerate(words.to_pylist()):
            raw = (word or "").encode()
            if len(raw) <= SHORT:
                of_short[int.from_bytes(raw, "little") | len(raw) << 56] = k
            else:
                of_long[word + " "] = k
        found = []
        for names, kind, known in ((self.short, pa.int64(), of_short), (self.long, pa.string(), of_long)):
            at = np.asarray(pc.index_in(names, pa.array(list(known), kind)).fill_null(-1))
            found.append(np.array([*known.values(), -1], np.int64)[at])
        return np.concatenate(found)


def _sets(words: pa.Array) -> _Sets:
    """words: texts, or what _coded() makes of them."""
    n, short, long = (words if pa.types.is_struct(words.type) else _coded(words)).flatten()
    rows = np.arange(len(n))
    ends, data = _bytes_of(short.fill_null(b"").cast(pa.binary()))
    numbers = pa.array(np.frombuffer(data.tobytes(), np.int64)).dictionary_encode()
    n_short = np.diff(ends) // 8
    ends, data = _bytes_of(long.fill_null("").cast(pa.string()))
    cuts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    words_ = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
    key = _sorted(np.repeat(rows, np.diff(np.searchsorted(cuts, ends))) * max(len(words_.dictionary), 1) + np.asarray(words_.indices))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    row, token = np.divmod(key[new], max(len(words_.dictionary), 1))
    tokens = np.concatenate([np.asarray(numbers.indices).astype(np.int64), token + len(numbers.dictionary)])
    sizes = n_short + np.bincount(row, minlength=len(n))
    return _Sets(np.asarray(n.fill_null(0)).astype(np.int64), sizes, np.concatenate([np.repeat(rows, n_short), row]), tokens, numbers.dictionary, words_.dictionary)


_MEASURES = pa.struct([("n", pa.int32()), ("total", pa.int64()), ("least", pa.int32()), ("similar", pa.int64()), ("met", pa.int32())])
_KIND = "struct<n: int, total: long, least: int, similar: long, met: int>"


def _measures(texts: pa.Array, asked: pa.Array, threshold: float, changes: list[tuple[int | None, str | None]]) -> Iterator[list[dict | None]]:
    """Of each element what measured() says, for each of the changes that are made to its texts: the place of one that goes, one that is added."""
    for k in range(len(texts)):
        if not texts[k].is_valid:
            yield [None] * len(changes[k])
            continue
        own = texts.slice(k, 1).flatten()
        added = [new for _, new in changes[k] if new is not None]
        if added:
            new = pa.array(added, pa.string())
            own = pa.concat_arrays([own.cast(_CODED), _coded(new)]) if pa.types.is_struct(own.type) else pa.concat_arrays([own, new.cast(own.type)])
        sets = _sets(own)
        lengths, n_own = sets.lengths, len(own) - len(added)
        # which texts each change leaves
        inside = np.zeros((len(changes[k]), len(own)), bool)
        inside[:, :n_own] = True
        at = n_own
        for c, (gone, new) in enumerate(changes[k]):
            if gone is not None:
                inside[c, gone] = False
            if new is not None:
                inside[c, at] = True
                at += 1
        pairs = np.zeros(len(changes[k]), np.int64)
        for i, j, _ in sets.similar(threshold):
            pairs += np.array([np.count_nonzero(x[i] & x[j]) for x in inside], np.int64)
        of = sets.places(asked.slice(k, 1).flatten())[sets.tokens]
        row, of = sets.of[of >= 0], of[of >= 0]
        out = []
        for x, similar_pairs in zip(inside, pairs, strict=True):
            filled = lengths[x & (lengths > 0)]
            met = len(np.unique(of[x[row]])) if asked[k].is_valid else None
            out.append({"n": len(filled), "total": int(filled.sum()), "least": int(filled.min()) if len(filled) else 0, "similar": int(similar_pairs), "met": met})
        yield out


def measured(texts: Column, asked: Column, threshold: float) -> Column:
    """Of an array of lower-cased texts, or of what coded() makes of each: the number n of those with tokens, their tokens in total and the fewest, how many pairs of their token sets
    have a Jaccard similarity over the threshold, and how many of the words asked for (an array of different ones) are among the tokens."""

    @F.arrow_udf(_KIND)
    def measure(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, words in columns:
            yield pa.array([m[0] for m in _measures(column, words, threshold, [[(None, None)]] * len(column))], _MEASURES)

    return measure(texts, asked)


def measured_changes(texts: Column, asked: Column, changes: Column, threshold: float) -> Column:
    """The same for each of some changes (an array of structs: the place of a text that goes, and one that is added, or null), as an array: what the
    changes have in common is split and compared once."""

    @F.arrow_udf(f"array<{_KIND}>")
    def measure(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, words, each in columns:
            told = [[(c["gone"], c["new"]) for c in row] for row in each.to_pylist()]
            yield pa.array(list(_measures(column, words, threshold, told)), pa.list_(_MEASURES))

    return measure(texts, asked, changes)


def similar_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: a key and, of the same length, arrays i, id and t (lower-cased texts, or what coded() makes of each). (key, i, j, src, dst, similarity) of the pairs over the threshold,
    which leave a task block by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sets = _sets(batch.column(3).slice(k, 1).flatten())
                place, name = (batch.column(c).slice(k, 1).flatten() for c in (1, 2))
                for i, j, ratio in sets.similar(threshold):
                    if len(i):
                        key = batch.column(0).take(pa.array(np.full(len(i), k)))
                        yield pa.RecordBatch.from_arrays([key, place.take(pa.array(i)), place.take(pa.array(j)), name.take(pa.array(i)), name.take(pa.array(j)), pa.array(ratio)], names=["key", "i", "j", "src", "dst", "similarity"])

    kinds = (("i", IntegerType()), ("j", IntegerType()), ("src", StringType()), ("dst", StringType()), ("similarity", DoubleType()))
    key = rows.columns[0]
    schema = StructType([StructField("key", rows.schema[key].dataType), *(StructField(name, kind) for name, kind in kinds)])
    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)
