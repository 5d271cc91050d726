"""Words counted, numbered, paired and weighed in Arrow batches.

Counts and vectors work on the bytes of many texts at once (``words_of``, ``Terms``), so a word
costs some array operations and no Python object.  A bigram occurs at most as often as each of its words.  So the terms above a count are found
among the words above it and their pairs, and a pair is one long instead of a string.  Tasks
look words up in a table of bounded size; Spark does all grouping.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from glyphloom.functions.text import tokens

#: entries of texts that a task combines before it hands them on
COMBINED = 1 << 21
#: distinct words that a task counts before it hands them on
COUNTED = 1 << 18
#: bytes of text cut into words together
PIECE = 1 << 22
WORD_BITS = 31
WORD_MASK = (1 << WORD_BITS) - 1

# Code points that are told apart in arrays: the first 0x180, which one or two bytes hold and whose small
# letters are as long, and marks from the block of punctuation, which are in no word.
_NARROW = 0x180
_MARKS = ((0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))
_WORD = np.array([c == ord("_") or unicodedata.category(chr(c))[0] in "LN" for c in range(_NARROW)])
_SMALL = np.array([c if c == 0x130 else ord(chr(c).lower()) for c in range(_NARROW)], np.int16)
_WORD_BYTE = np.append(_WORD[:0x80], np.ones(0x80, bool))
_SMALL_BYTE = np.append(_SMALL[:0x80], np.arange(0x80, 0x100)).astype(np.uint8)
#: a text of these characters alone (the small letter of U+0130 is two); a search for another takes 25 times as long
TOLD = r"\A[\x{0}-\x{12f}\x{131}-\x{17f}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _MARKS) + r"]*+\z"


def words_text(text: Column) -> Column:
    """The tokens of a text, a blank between them; empty without any."""
    return F.coalesce(F.array_join(tokens(text), " "), F.lit(""))


def _numbers(text: str, number: Callable[[str], int | None]) -> np.ndarray:
    """The words' numbers in text order, -1 for words without one."""
    return np.array([-1 if k is None else k for k in map(number, text.split(" "))], np.int64) if text else np.zeros(0, np.int64)


def _pairs(numbers: np.ndarray) -> np.ndarray:
    a, b = numbers[:-1], numbers[1:]
    return ((a << WORD_BITS) | b)[(a >= 0) & (b >= 0)]


def plain_text(text: Column) -> Column:
    """What ``words_of`` cuts into the tokens of a text: the text, or ``words_text`` of one with other characters."""
    return F.when(F.is_valid_utf8(text) & F.rlike(text, F.lit(TOLD)), text).otherwise(words_text(text))


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (from ``plain_text``), and for each text the place of its first, with their number at the end.

    A byte is in a word or not, by tables; characters that the tables do not know come from
    ``words_text`` and are in words.  A word is a run of at least two characters.
    """
    offsets = np.zeros(len(text) + 1, np.int64)
    if len(text):
        width = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets[:] = np.frombuffer(text.buffers()[1], width)[text.offset:text.offset + len(text) + 1]
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(text) + 1, np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    inside, small = _WORD_BYTE[raw], _SMALL_BYTE[raw]
    two = np.flatnonzero((raw >= 0xC2) & (raw < 0xC0 + (_NARROW >> 6)))
    point = (raw[two].astype(np.int16) & 0x1F) << 6 | raw[two + 1] & 0x3F
    inside[two] = inside[two + 1] = _WORD[point]
    point = _SMALL[point]
    small[two], small[two + 1] = 0xC0 | point >> 6, 0x80 | point & 0x3F
    three = np.flatnonzero(raw == 0xE2)
    point = 0x2000 | (raw[three + 1].astype(np.int16) & 0x3F) << 6 | raw[three + 2] & 0x3F
    for low, high in _MARKS:
        marks = three[(point >= low) & (point <= high)]
        inside[marks] = inside[marks + 1] = inside[marks + 2] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(raw))]  # no word goes on into the next text
    first[bounds], last[bounds - 1] = inside[bounds], inside[bounds - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    lead = small[starts]
    one = sizes == 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    for k in range(4):
        inside[starts[one & (sizes > k)] + k] = False
    starts, sizes = starts[~one], sizes[~one]
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(small[inside]))
    return words, np.searchsorted(starts, offsets)


def text_pieces(text: pa.Array) -> Iterator[slice]:
    """Rows whose texts together have some ``PIECE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    upto = np.append(0, np.cumsum(sizes, dtype=np.int64))
    row = 0
    while row < len(text):
        last = max(row + 1, int(np.searchsorted(upto, upto[row] + PIECE, side="right")) - 1)
        yield slice(row, last)
        row = last


def cut_pieces(batches: Iterator[pa.RecordBatch], column: str = "words") -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Pieces of the batches with what ``words_of`` finds in ``column``."""
    for batch in batches:
        for rows in text_pieces(batch.column(column)):
            piece = batch.slice(rows.start, rows.stop - rows.start)
            yield piece, *words_of(piece.column(column))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each stands there."""
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _found(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each value in ``among``, -1 for those not there."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy()


def _neighbours(numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring words of a text that both have numbers, and their texts."""
    near = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (row[:-1] == row[1:])
    return numbers[:-1][near].astype(np.int64) << WORD_BITS | numbers[1:][near], row[:-1][near]


def word_statistics(words: DataFrame) -> DataFrame:
    """``term, corpus_count, doc_count`` of the words in ``words`` (column ``words``, from ``plain_text``), combined in the tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def combined() -> pa.Table:
            table = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("corpus", "sum"), ("docs", "sum")])
            return table.select(["term", "corpus_sum", "docs_sum"]).rename_columns(["term", "corpus", "docs"])

        size = 0
        for _, flat, ends in cut_pieces(batches):
            coded = flat.dictionary_encode()
            code, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            once, _ = _runs(np.sort(row * distinct + code))
            held.append(pa.table({
                "term": coded.dictionary, "corpus": np.bincount(code, minlength=distinct).astype(np.int64),
                "docs": np.bincount(once % distinct if distinct else once, minlength=distinct).astype(np.int64)}))
            size += distinct
            if size >= 4 * COUNTED:
                held = [combined()]
                size = len(held[0])
                if size >= COUNTED:
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from combined().combine_chunks().to_batches()

    return words.select("words").mapInArrow(count, "term string, corpus long, docs long").groupBy("term").agg(
        F.sum("corpus").alias("corpus_count"), F.sum("docs").alias("doc_count"))


def numbered(words: DataFrame, known: list[tuple[str, int]], unknown: int | None) -> DataFrame:
    """``words`` (with a column ``words``) with ``_at`` and ``_rest`` in its place.

    ``_at`` holds a long for each place with a number: the place, then 32 bits of the number.  A word
    not in ``known`` has the number ``unknown``, or without one stands in ``_rest`` with its place.
    """
    number = dict(known)
    keys = [c for c in words.columns if c != "words"]
    fields = words.select(*keys).schema.add("_at", ArrayType(LongType())).add("_rest", ArrayType(
        StructType().add("_pos", IntegerType()).add("term", StringType())))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rest = [], []
            for text in batch.column("words").to_pylist():
                ids = _numbers(text, number.get)
                missing = np.flatnonzero(ids < 0)
                if unknown is not None:
                    ids[missing] = unknown
                here = np.flatnonzero(ids >= 0)
                at.append((here << 32) | ids[here])
                terms = text.split(" ") if unknown is None and len(missing) else ()
                rest.append([{"_pos": int(k), "term": terms[k]} for k in missing] if terms else [])
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in at])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keys]
                + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(at) if at else [], pa.int64())),
                   pa.array(rest, pa.list_(pa.struct([("_pos", pa.int32()), ("term", pa.string())])))],
                names=[*keys, "_at", "_rest"])

    return words.mapInArrow(look_up, fields)


def pair_statistics(words: DataFrame, known: list[str], least: int = 1, entries: int = 0) -> DataFrame:
    """``pair, corpus_count, doc_count`` of neighbouring ``known`` words that occur ``least`` times or more.

    ``words`` has a column ``words`` from ``plain_text``.  Pairs travel as arrays and meet in slots by
    their hash, so many slots that of ``entries`` words in all a slot has some ``COMBINED``.
    """
    slots = max(64, -(-entries // COMBINED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = pa.array(known, pa.string())
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> pa.RecordBatch:
            pair, row = (np.concatenate(part) for part in zip(*held))
            held.clear()
            texts = int(row[-1]) + 1
            key = ((pair >> WORD_BITS) * len(known) + (pair & WORD_MASK)) * texts + row
            key, tf = _runs(np.sort(key))  # a pair's entries of one text
            code, docs = _runs(key // texts)
            corpus = np.add.reduceat(tf, np.cumsum(docs) - docs)
            slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(slots)
            order = np.argsort(slot, kind="stable")
            bounds = np.searchsorted(slot[order], np.arange(slots + 1, dtype=np.uint64))
            parts = [n[order] for n in (code, corpus.astype(np.int64), docs.astype(np.int64))]
            filled = [k for k in range(slots) if bounds[k] < bounds[k + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32())]
                + [pa.array([p[bounds[k]:bounds[k + 1]].tobytes() for k in filled], pa.binary()) for p in parts],
                names=["slot", "pair", "corpus", "docs"])

        size = 0
        for _, flat, ends in cut_pieces(batches):
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            pair, at = _neighbours(_found(flat, among), row)
            if len(pair):  # texts are numbered anew, those without pairs have no number
                after = int(held[-1][1][-1]) + 1 if held else 0
                held.append((pair, after + np.cumsum(np.append(False, at[1:] != at[:-1]))))
                size += len(pair)
            if size >= COMBINED:
                yield combined()
                size = 0
        if held:
            yield combined()

    def met(table: pa.Table) -> pa.Table:
        code, corpus, docs = (np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column(n)])
                              for n in ("pair", "corpus", "docs"))
        order = np.argsort(code, kind="stable")
        code, sizes = _runs(code[order])
        first = np.cumsum(sizes) - sizes
        corpus, docs = np.add.reduceat(corpus[order], first), np.add.reduceat(docs[order], first)
        kept = corpus >= least
        code = code[kept]
        pair = code // len(known) << WORD_BITS | code % len(known)
        return pa.table({"pair": pair, "corpus_count": corpus[kept], "doc_count": docs[kept]})

    return (words.select("words").mapInArrow(count, "slot int, pair binary, corpus binary, docs binary")
            .groupBy("slot").applyInArrow(met, "pair long, corpus_count long, doc_count long"))


def pair_terms(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` with ``term`` in place of ``pair``; ``known`` holds ``word, number``."""
    first = F.broadcast(known.select(F.col("number").alias("_a"), F.col("word").alias("_first")))
    second = F.broadcast(known.select(F.col("number").alias("_b"), F.col("word").alias("_second")))
    split = pairs.withColumn("_a", F.shiftright("pair", WORD_BITS)).withColumn(
        "_b", F.col("pair").bitwiseAND(F.lit(WORD_MASK)))
    return split.join(first, "_a").join(second, "_b").select(
        F.concat_ws(" ", "_first", "_second").alias("term"), "corpus_count", "doc_count")


class Terms:
    """Words and bigrams with numbers in the order given, counted in many texts at once."""

    def __init__(self, terms: list[str], n: int):
        split = [t.split(" ") for t in terms]
        words = sorted({w for parts in split for w in parts})
        number = {w: k for k, w in enumerate(words)}
        self.size, self.words = len(terms), pa.array(words, pa.string())
        self.single = np.full(len(words) + 1, -1, np.int64)  # the last for words without a number
        pairs, places = [], []
        for at, parts in enumerate(split):
            if len(parts) == 1:
                self.single[number[parts[0]]] = at
            elif n == 2:
                pairs.append(number[parts[0]] << WORD_BITS | number[parts[1]])
                places.append(at)
        self.pairs, self.places = pa.array(pairs, pa.int64()), np.array(places, np.int64)

    def counts(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``columns, tf, starts`` of the texts that ``words_of`` cut: their terms in order, and each text's first."""
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        numbers = _found(words, self.words)
        column = self.single[numbers]
        keys = [(row * self.size + column)[column >= 0]]
        if len(self.pairs):
            pair, at = _neighbours(numbers, row)
            place = _found(pa.array(pair), self.pairs)
            keys.append(at[place >= 0] * self.size + self.places[place[place >= 0]])
        key, tf = _runs(np.sort(np.concatenate(keys)))
        starts = np.searchsorted(key, np.arange(len(ends)) * self.size)
        return key - np.repeat(np.arange(len(ends) - 1), np.diff(starts)) * self.size, tf, starts

    def scaled(
        self, idf: np.ndarray, words: pa.Array, ends: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``scales, columns, tf, starts``: a text's scale makes its tf times idf a vector of length 1."""
        columns, tf, starts = self.counts(words, ends)
        sizes = np.diff(starts)
        squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (tf * idf[columns]) ** 2, len(sizes))
        return 1 / np.sqrt(np.where(sizes > 0, squares, 1.0)), columns, tf, starts

    def vectors(self, idf: np.ndarray, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``columns, values, starts``: tf times idf, scaled to length 1 for each text."""
        scales, columns, tf, starts = self.scaled(idf, words, ends)
        return columns, tf * idf[columns] * np.repeat(scales, np.diff(starts)), starts


def weighed(rows: DataFrame, key: str, text: str, terms: list[tuple[str, float]], n: int) -> DataFrame:
    """``key, _terms, _weights, _squares``: one row per text with its terms, tf times idf, and their squares' sum."""
    number = {w: k for k, w in enumerate(sorted({w for t, _ in terms for w in t.split(" ")}))}
    single = np.full(len(number), -1, np.int64)
    codes = []
    for at, (term, _) in enumerate(terms):
        parts = term.split(" ")
        if len(parts) == 1:
            single[number[term]] = at
        elif n == 2:
            codes.append(((number[parts[0]] << WORD_BITS) | number[parts[1]], at))
    codes.sort()
    pair, place = np.array(codes, np.int64).reshape(-1, 2).T.copy()
    names, idf = [t for t, _ in terms], np.array([v for _, v in terms], np.float64)
    kept = rows.select(key, words_text(F.col(text)).alias("_words"))
    fields = (kept.select(key).schema.add("_terms", ArrayType(StringType())).add("_weights", ArrayType(DoubleType()))
              .add("_squares", DoubleType()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(names, pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                found, counts, squares, ends = [], [], [], [0]
                for line in batch.column(1).to_pylist():
                    numbers = _numbers(line, number.get)
                    at = single[numbers[numbers >= 0]]
                    at = at[at >= 0]
                    if len(pair):
                        codes = _pairs(numbers)
                        near = np.minimum(np.searchsorted(pair, codes), len(pair) - 1)
                        at = np.concatenate([at, place[near[pair[near] == codes]]])
                    at, tf = np.unique(at, return_counts=True)
                    weight = tf * idf[at]
                    found.append(at)
                    counts.append(weight)
                    squares.append(float(weight @ weight))
                    ends.append(ends[-1] + len(at))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(np.concatenate(found)))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))), pa.array(squares, pa.float64()),
                ], names=[key, "_terms", "_weights", "_squares"])

    return kept.mapInArrow(weigh, fields)
