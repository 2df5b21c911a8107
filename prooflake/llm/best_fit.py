"""Best-fit packing of token sequences: large pieces are matched in pairs, smaller ones fill the remaining gaps.

Documents become token ids in one narrow pass; those longer than the capacity are cut. How full sequences get depends on lengths alone, and there are at
most `capacity` of them, so the plan is made from the histogram: pieces above a third of the capacity, of which two at most fit a
sequence, are matched greedily, each with the largest that still fits (all of a length at once); then smaller ones, longest first, go where
the gap that is left is smallest, and open new sequences only where no gap fits. A step treats all pieces of one length and all sequences
of one gap alike, so the plan's size is bounded by the capacity and not by the number of documents.

A piece finds its place in the plan by its rank among those of its length: its number in the task that made it, which is stored with it (so
a rerun task can't change it), plus the pieces of that length of earlier tasks. Nothing is sorted, and a length that a third of all pieces
have is no group. The plan and, up to MOST_BASES rows, the tasks' first ranks go along by broadcast.

Rows: a null text is empty and gives the closing id alone; a null doc_id is kept; repeated rows are packed each; special tokens' names in a text
are ordinary text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm.byte_bpe import byte_characters
from prooflake.llm.common import runs, stored, table, texts_of

CAPACITY = 4096
CLOSING_ID = 1
#: Bytes of words with their ids that a task remembers, with so many for an entry itself; longer words are encoded each time.
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 160 << 20, 80, 64
CHUNK_BYTES, CHUNK_CHARS = 4 << 20, 1 << 20
MOST_BASES = 1 << 20
#: Characters at which Python splits words but the tokenizer doesn't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"\s")
#: Below U+0250 all letters are composed and lower-cased one by one, so that the tokenizer's normalisation of a word is lower().
_SIMPLE = re.compile("[\x21-\u024f]*").fullmatch
FIRST_ID = 1 << 16
#: The parts of a tokenizer file under which words are cut here.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    return {letter: byte for byte, letter in enumerate(byte_characters())}


class WordModel:
    """What WordIds needs of a tokenizer file, made once on the driver: the pieces in the order of their merges, with their ids.

    The file's own merges are pairs; tiktoken, which is several times faster, joins any two neighbours whose bytes together are a piece. Both
    give the same if each piece, encoded alone by tiktoken's rule, is made by its listed pair: as long as no merge crosses a piece's ends, its
    inner merges happen in the same order in any word. That is checked for every piece; where it fails, words go to the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.source = f.read().decode()
        given = json.loads(self.source)
        model, letters = given["model"], _letters()
        self.plain = given.get("normalizer") == NORMALIZER and given.get("pre_tokenizer") == PRE_TOKENIZER and model.get("end_of_word_suffix") == "</w>"
        self.pieces: list[bytes] = []
        self.ids: list[int] = []
        if not self.plain:
            return
        raw = lambda piece: bytes(letters[c] for c in piece.removesuffix("</w>")) + (b"\n" if piece.endswith("</w>") else b"")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        single = [bytes([b]) for b in range(256)]
        # a letter that ends a word is one symbol, so it is joined with the mark before anything else
        ended = [s + b"\n" for s in single if s != b"\n"]
        listed = {raw(x) + raw(y): (raw(x), raw(y)) for x, y in pairs}
        self.pieces = [*single, *ended, *listed]
        names = {raw(piece): number for piece, number in vocab.items()}
        self.ids = [names.get(piece, -1) for piece in self.pieces]
        rank = {piece: k for k, piece in enumerate(self.pieces)}
        self.plain = len(rank) == len(self.pieces) and all(self._listed(piece, listed, rank) for piece in listed)

    @staticmethod
    def _listed(piece: bytes, listed: dict[bytes, tuple[bytes, bytes]], rank: dict[bytes, int]) -> bool:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], 1 << 60))
            made = parts[best] + parts[best + 1]
            if made not in rank or (made in listed and listed[made] != (parts[best], parts[best + 1])):
                return False
            parts[best : best + 2] = [made]
        return True


class WordIds:
    """The ids of texts as little-endian unsigned 32-bit integers. The tokenizer drops white space and never joins characters over it, so
    words are encoded one by one and remembered; an id is held as the character FIRST_ID + id."""

    def __init__(self, model: WordModel):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.source)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(PRE_TOKEN + r"|\n").findall
        self.plain = model.plain
        if self.plain:
            ranks = {piece: k for k, piece in enumerate(model.pieces)}
            self.bpe = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
            self.ids = np.array(model.ids, np.int64) + FIRST_ID
            self.last = np.array([p.endswith(b"\n") for p in model.pieces])
        self.words: dict[str, str] = {}
        self.tokens: dict[str, str] = {"\n": "\n"}
        self.held = 0

    def _by_tokenizer(self, words: list[str]) -> list[str]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return ["".join([chr(FIRST_ID + k) for k in x.ids]) for x in found]

    def _fresh(self, words: list[str]) -> dict[str, str]:
        """The ids of words. Those of simple letters only are lower-cased and cut into tokens here, all at once, and then looked up or merged."""
        other = [w for w in words if not (w.isascii() and w.isprintable() or _SIMPLE(w))] if self.plain else words
        simple = [w for w in words if w not in found] if (found := set(other)) else words
        found = dict(zip(other, self._by_tokenizer(other), strict=True)) if other else {}
        if simple:
            # a word of letters only, as most are, is one token
            lowered = "\n".join(simple).lower().split("\n")
            whole = [w.isalpha() for w in lowered]
            cut = self.split("\n".join([w for w, one in zip(lowered, whole, strict=True) if not one]))
            tokens = list(compress(lowered, whole))
            fresh = [t for t in {*tokens, *cut} if t not in self.tokens]
            if fresh:
                ranks = np.array(self.bpe.encode_ordinary("\n".join(fresh) + "\n"))
                ids = np.insert(self.ids[ranks], np.flatnonzero(self.last[ranks]) + 1, ord("\n"))
                made = ids.astype("<u4").tobytes().decode("utf-32-le").split("\n")[:-1]
                self.tokens.update(zip(fresh, made, strict=True))
                self.held += sum(map(len, fresh)) + 4 * len(ids) + 2 * ENTRY_BYTES * len(fresh)
            found.update(zip(compress(simple, whole), map(self.tokens.__getitem__, tokens), strict=True))
            if len(tokens) < len(simple):
                made = "".join(map(self.tokens.__getitem__, cut)).split("\n")
                found.update(zip([w for w, one in zip(simple, whole, strict=True) if not one], made, strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Memory beside the texts is bounded by their size in all."""
        if self.held > CACHE_BYTES:
            self.words, self.tokens, self.held = {}, {"\n": "\n"}, 0
        split = [[t] if any(map(t.__contains__, ODD_SPACE)) else t.split() for t in texts]
        # words that repeat in the group are told apart by Arrow, so that the large dictionary is asked once for each
        coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = list(map(self.words.get, distinct))
        fresh = [w for w, ids in zip(distinct, made, strict=True) if ids is None]
        short = self._fresh([w for w in fresh if len(w) <= LONG_WORD])
        self.words.update(short)
        self.held += sum(map(len, short)) + 4 * sum(map(len, short.values())) + 2 * ENTRY_BYTES * len(short)
        long = dict(zip(odd, self._by_tokenizer(odd), strict=True)) if (odd := [w for w in fresh if len(w) > LONG_WORD]) else {}
        made = [(short[w] if w in short else long[w]) if ids is None else ids for w, ids in zip(distinct, made, strict=True)] if fresh else made
        ids = np.frombuffer("".join(made).encode("utf-32-le"), "<u4") - np.uint32(FIRST_ID)
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        offsets = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        whole = values.take(coded.indices)
        ends = np.frombuffer(whole.buffers()[1], np.int32) if len(whole) else np.zeros(1, np.int32)
        bounds = ends[np.cumsum([0, *map(len, split)])].tolist()
        data = whole.buffers()[2]
        out = [data[first:last].to_pybytes() if last > first else b"" for first, last in pairwise(bounds)]
        return out


def _parts(text: str) -> list[str]:
    """A long text cut before white space, as its words' lists are many times its size."""
    out, at = [], 0
    while len(text) - at > CHUNK_CHARS and (cut := _SPACE.search(text, at + CHUNK_CHARS)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _encoded(coder: WordIds, texts: list[str]) -> list[bytes]:
    """The ids of each text, by groups of about CHUNK_CHARS."""
    out: list[list[bytes]] = [[] for _ in texts]
    owners: list[int] = []
    group: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for owner, ids in zip(owners, coder.encode(group), strict=True):
            out[owner].append(ids)
        owners.clear()
        group.clear()
        size = 0

    for k, text in enumerate(texts):
        for part in _parts(text):
            owners.append(k)
            group.append(part)
            size += len(part)
            if size >= 2 * CHUNK_CHARS:
                flush()
    flush()
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, k) of docs (doc_id, text): the ids of each document's pieces; k numbers the pieces of one length
    that task `part` made."""

    shared = docs.sparkSession.sparkContext.broadcast(WordModel(path))  # one file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, closing = WordIds(shared.value), np.array([CLOSING_ID], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        step = 4 * capacity
        for batch in runs(batches, CHUNK_BYTES):
            rows = []
            found = _encoded(coder, [t.decode("utf-8", "replace") for t in texts_of(batch.column(1))])
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids += closing
                for number, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    n = len(cut) // 4
                    rows.append((doc, number, at // 4, n, cut, part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids", "part", "k"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, piece int, start long, length long, ids binary, part int, k long")
    return stored(made, "pieces")


class _Plan:
    """Which sequences the pieces of a length go to: entries (length, first rank, a, first sequence, offset). Of the ranks that follow the
    first, each sequence takes `a`, one behind the other."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rank: dict[int, int] = {}
        self.entries: list[tuple[int, int, int, int, int]] = []
        #: gap -> [(first sequence, number)], and the gaps in order
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def fresh(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, each: int, first: int, n: int, offset: int) -> None:
        """Each of n sequences from `first` takes `each` pieces of the length at the offset."""
        rank = self.rank.get(length, 0)
        self.entries.append((length, rank, each, first, offset))
        self.rank[length] = rank + each * n

    def leave(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.open:
                self.open[gap] = []
                insort(self.gaps, gap)
            self.open[gap].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(gap, first, number) of sequences with the smallest gap that holds `least`."""
        at = bisect_left(self.gaps, least)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, n = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap], self.gaps[at]
        return gap, first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(entries, sequences) for so many pieces of each length."""
    made = _Plan(capacity)
    left = {length: n for length, n in counts.items() if 3 * length > capacity}
    lengths = sorted(left)
    while lengths:
        longest = lengths[-1]
        at = bisect_right(lengths, capacity - longest) - 1
        if at >= 0 and lengths[at] == longest and left[longest] < 2:
            at -= 1
        if at < 0:
            n, partner = left[longest], None
        else:
            partner = lengths[at]
            n = left[longest] // 2 if partner == longest else min(left[longest], left[partner])
        first = made.fresh(n)
        if partner == longest:
            made.put(longest, 2, first, n, 0)
        else:
            made.put(longest, 1, first, n, 0)
            if partner:
                made.put(partner, 1, first, n, longest)
        made.leave(capacity - longest - (partner or 0), first, n)
        for length in {longest, partner} - {None}:
            left[length] -= n * (2 if partner == longest else 1)
            if not left[length]:
                del lengths[bisect_left(lengths, length)]
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        rest = counts[length]
        while rest:
            found = made.take(length)
            if found is None:
                each = capacity // length
                n = max(1, rest // each)
                found = capacity, made.fresh(n), n
            gap, first, n = found
            # the gap that one piece leaves is the smallest that holds the next, so a sequence takes as many as fit
            each = min(gap // length, rest)
            full = min(n, rest // each)
            made.put(length, each, first, full, capacity - gap)
            made.leave(gap - each * length, first, full)
            made.leave(gap, first + full, n - full)
            rest -= each * full
    return made.entries, made.sequences


def _places(entries: list[tuple[int, int, int, int, int]]):
    """A function of (length, rank) that gives sequence_id and offset."""
    rows = np.array(sorted(entries), np.int64).reshape(-1, 5)
    length, rank, each, first, offset = rows.T
    keys = (length << 48) + rank

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (lengths.to_numpy() << 48) + ranks.to_numpy(), "right") - 1
        beyond = ranks.to_numpy() - rank[at]
        return pd.DataFrame({"sequence_id": first[at] + beyond // each[at], "offset": offset[at] + beyond % each[at] * lengths.to_numpy()})

    return place


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of docs (doc_id, text): its ids, and where it stands."""
    cut = pieces(docs, path, capacity)
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    entries, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    few = counts.limit(MOST_BASES + 1).count() <= MOST_BASES
    ranked = cut.join(F.broadcast(bases) if few else bases, (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length")))
    placed = ranked.withColumn("at", _places(entries)("length", F.col("base") + F.col("k")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from pack's rows: the ids of each sequence, at most `capacity` of them."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return parts.select("sequence_id", "length", whole.alias("ids"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
