"""Removal of byte strings that repeat anywhere in the corpus, by anchors and exact-length hash matching.

A string of ``LENGTH`` bytes that repeats holds the same anchor in each place: the
position whose following ``CORE`` bytes hash lowest among all cores inside the string.
Anchors are the sampled suffixes: one in about a hundred bytes, chosen by content
alone, so equal strings have equal anchors.  Sampled suffixes are named by their cores
and put in order by Spark's external sort and shuffle, on disk; names that occur once
are discarded at once.  For the rest the order of the other suffixes is induced from
their anchor: all strings with one anchor form a run of starts, and

* if every run of a name has the same bytes, all its strings repeat;
* else the distinct runs of that name are sorted by their strings, once each.

Sorting every suffix instead would write more than ten bytes for each byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K
from glyphloom.session import stage

LENGTH = 400
#: distinct runs of one name that a task takes together; more are spread by their strings
NAME_ROWS = 20_000

RUNS = "doc_id long, rid long, low int, high int, name long, bytes_hash long"
PARTS = "doc_id long, rid long, low int, high int, name long, n long, part binary"
SPANS = "doc_id long, rid long, low int, high int"


def anchor_runs(length: int):
    """``doc_id, rid, text`` to ``RUNS``: the starts low..high of strings with one anchor."""
    core = length // 2
    reach = length - core + 1  # cores inside one string

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in K.pieces(batch.column("text")):
                if len(data) < length:
                    continue
                prefix = K.prefix_hash(data)
                at = np.arange(len(data) - core + 1)
                names = K.span_hash(prefix, at, at + core)
                keys = (names & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
                blocks = -(-len(keys) // reach)
                padded = np.full((blocks, reach), np.uint64(2**64 - 1))
                padded.ravel()[:len(keys)] = keys
                ahead = np.minimum.accumulate(padded, axis=1).ravel()
                back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
                starts = len(data) - length + 1
                lowest = np.minimum(back[:starts], ahead[reach - 1:reach - 1 + starts])
                anchors = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
                # starts whose string stays in its document
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
                inside = np.arange(starts) + length <= offsets[1:][doc]
                use = np.flatnonzero(inside)
                if not len(use):
                    continue
                new = np.ones(len(use), bool)
                new[1:] = ((anchors[use][1:] != anchors[use][:-1]) | (doc[use][1:] != doc[use][:-1]))
                first = np.flatnonzero(new)
                low = use[first]
                high = use[np.append(first[1:], len(use)) - 1]
                owner = doc[low]
                content = K.span_hash(prefix, low, high + length)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, len(offsets) - 1).take(pa.array(owner)),
                    batch.column("rid").slice(row, len(offsets) - 1).take(pa.array(owner)),
                    pa.array((low - offsets[owner]).astype(np.int32)),
                    pa.array((high - offsets[owner]).astype(np.int32)),
                    pa.array(names[anchors[low]].view(np.int64)), pa.array(content.view(np.int64)),
                ], names=["doc_id", "rid", "low", "high", "name", "bytes_hash"])

    return run


def cut_parts(length: int):
    """``text`` and its ``runs`` to ``PARTS``: the bytes that the strings of a run cover."""

    def run(batches):
        for batch in batches:
            out = []
            ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            for i, (text, runs) in enumerate(zip(
                    batch.column("text").cast(pa.binary()), batch.column("runs").to_pylist())):
                text = text.as_py()
                out += [(ids[i], rids[i], r["low"], r["high"], r["name"], r["n"],
                         text[r["low"]:r["high"] + length]) for r in runs]
                if len(out) > 5_000:
                    yield _parts(out)
                    out = []
            if out:
                yield _parts(out)

    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "rid", "low", "high", "name", "n", "part")
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _strings(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, row, offset`` of each string in the parts of a table."""
    parts = table.column("part").to_pylist()
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.append(0, np.cumsum(counts))[:-1], counts)
    at = begin[row] + offset
    return K.span_hash(K.prefix_hash(data), at, at + length), row, offset


def repeated_strings(length: int):
    """Parts sorted by name to ``SPANS`` of the strings that repeat."""

    def run(batches):
        for table in K.whole_groups(batches, "name"):
            hashes, row, offset = _strings(table, length)
            n = table.column("n").to_numpy()
            inverse = np.unique(hashes, return_inverse=True)[1]
            many = np.bincount(inverse, weights=n[row].astype(float))[inverse] > 1.5
            keep = many & (n[row] == 1)  # runs that occur several times are whole spans already
            row, offset = row[keep], offset[keep]
            if not len(row):
                continue
            new = np.append(True, (np.diff(row) != 0) | (np.diff(offset) != 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            low = table.column("low").to_numpy()[row[first]]
            owner = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([
                table.column("doc_id").combine_chunks().take(owner),
                table.column("rid").combine_chunks().take(owner),
                pa.array((low + offset[first]).astype(np.int32)),
                pa.array((low + offset[last] + length).astype(np.int32)),
            ], names=["doc_id", "rid", "low", "high"])

    return run


def string_rows(length: int):
    """Parts to one row for each string, for names with very many distinct runs."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                table = pa.Table.from_batches([batch.slice(at, 1_000)])
                hashes, row, offset = _strings(table, length)
                owner = pa.array(row)
                low = (table.column("low").to_numpy()[row] + offset).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(table.column(c).combine_chunks().take(owner) for c in ("doc_id", "rid", "n")),
                    pa.array(low), pa.array(hashes.view(np.int64)),
                ], names=["doc_id", "rid", "n", "low", "string"])

    return run


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["low"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["high"])
        else:
            out.append([s["low"], s["high"]])
    return [tuple(s) for s in out]


def strip_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, spans`` to the kept bytes and what was removed."""
    for batch in batches:
        kept, sizes, removed, runs = [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist()):
            text, spans = text.as_py() or b"", _merged(spans)
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            sizes.append(len(text))
            removed.append(len(text) - len(kept[-1]))
            runs.append(len(spans))
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()),
             pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=[*rest, "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, rid, low, high``: bytes low..high-1 that repeated strings cover.

    ``docs`` has ``doc_id, rid, text``, where doc_id and rid together name a text.
    Spans of one text may overlap.
    """
    runs = stage(docs.where(F.octet_length("text") >= length).mapInArrow(anchor_runs(length), RUNS))
    names = stage(runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.min("bytes_hash").alias("x"), F.max("bytes_hash").alias("y"))
        .where("runs > 1").select("name", (F.col("x") != F.col("y")).alias("mixed")))
    hits = stage(runs.join(names, "name"))
    alike = hits.where("not mixed")
    mixed = hits.where("mixed")
    distinct = stage(mixed.groupBy("name", "bytes_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "rid", "low", "high")).alias("at")))
    again = mixed.join(distinct.where("n > 1").select("name", "bytes_hash"), ["name", "bytes_hash"])
    wanted = distinct.select("at.*", "name", "n").groupBy("doc_id", "rid").agg(
        F.collect_list(F.struct("low", "high", "name", "n")).alias("runs"))
    # a text given twice has its parts twice; its runs have n > 1, so no count changes its answer
    texts = docs.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "text")
    parts = (texts.join(wanted, (F.col("r") == F.col("rid")) & F.col("d").eqNullSafe(F.col("doc_id")))
             .select("doc_id", "rid", "text", "runs").mapInArrow(cut_parts(length), PARTS))
    sizes = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("m"))
    hot = sizes.where(F.col("m") > NAME_ROWS).select("name")
    if hot.isEmpty():
        some = parts
        spread = None
    else:
        parts = stage(parts)
        some = parts.join(hot, "name", "left_anti").select(*parts.columns)
        strings = stage(parts.join(hot, "name", "left_semi").select(*parts.columns).mapInArrow(
            string_rows(length), "doc_id long, rid long, n long, low int, string long"))
        often = strings.groupBy("string").agg(F.sum("n").alias("m")).where("m > 1").select("string")
        spread = strings.where("n = 1").join(often, "string").select(
            "doc_id", "rid", "low", (F.col("low") + length).alias("high"))
    found = some.repartition("name").sortWithinPartitions("name").mapInArrow(
        repeated_strings(length), SPANS)
    for rows in (alike, again):
        found = found.unionByName(rows.select("doc_id", "rid", "low", (F.col("high") + length).alias("high")))
    return found if spread is None else found.unionByName(spread)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
) -> DataFrame:
    """All columns of ``docs`` but the text, and ``n_bytes, n_removed, n_spans, kept``.

    ``kept`` has the remaining bytes in UTF-8, of which a cut may have split a character.

    Every byte goes that a string of ``length`` bytes covers which starts anywhere else
    too, in the same document or another.  Null texts count as empty; shorter texts
    stay whole.  Repeated rows are further places of their strings, so both lose them.
    Null keys are kept.  Columns of the names above are replaced; others pass through.
    An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest if c != text]).alias("row"),
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(carried.select("doc_id", "rid", "text"), length)
    spans = spans.groupBy("doc_id", "rid").agg(
        F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans")).select(
        F.col("doc_id").alias("d"), F.col("rid").alias("r"), "spans")
    joined = carried.join(
        spans, (F.col("r") == F.col("rid")) & F.col("d").eqNullSafe(F.col("doc_id")), "left")
    out = joined.select("row", "text", "spans")
    kinds = f"row {out.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return out.mapInArrow(strip_spans, kinds).select("row.*", "n_bytes", "n_removed", "n_spans", "kept")

