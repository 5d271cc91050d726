"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its five-word shingles.  Every tree sends a document down a
path of minwise tokens: at the root by one token, in nodes still too large by several
more, chosen by the node itself.  Two sets of similarity s share a root child with
probability s, and large nodes branch by so many tokens that most of such pairs go on;
there are so many independent trees that all of them miss a pair at the threshold with a
probability below ``MISSED``, whatever the depth: 8 at 0.85, 10 at 0.8.

Small nodes are compared exhaustively inside a task, first by sketches (which are far
below any pair they let go), then by the full sets: only verified links leave a task,
and only those that join two groups not joined before, so a node of n documents gives
fewer than n rows.  Copies with equal sets are one row from the start.

A node too large for that first loses what its centre settles.  Every member is compared
with the centre on full sets.  Jaccard distance is a metric: a member linked to the
centre can link to a member that is not only if their distances to the centre differ by
no more than the threshold allows, so linked members nearer than that leave the node and
lose no link.  The rest branches; what is still large at the last level is compared in
pairs of blocks, again without loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K
from glyphloom.llm.components import components
from glyphloom.session import stage

WIDTH = 5
SLOTS = 128
#: documents that one task compares in one node
NODE_ROWS = 2_000
#: how far below the threshold a sketch may be, in standard deviations of its error
DEVIATIONS = 4.5
#: chance that all trees miss a pair at the threshold
MISSED = 1e-6
#: levels of branching; nodes still large then are compared in pairs of blocks
MAX_DEPTH = 8

_rng = np.random.default_rng(77)
FLIPS = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64)
FACTORS = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) | np.uint64(1)

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, paths array<long>, sketch binary"


def margin(threshold: float) -> float:
    """How far below the threshold a sketch may be."""
    return DEVIATIONS * (threshold * (1 - threshold) / SLOTS) ** 0.5


def branches(threshold: float) -> int:
    """Tokens a large node branches by: more than one path of a linked pair goes on."""
    return int(1 / threshold) + 1


def trees(threshold: float) -> int:
    """Trees needed for ``MISSED``, if the paths of a pair branch without end."""
    ends = 0.0  # the chance that all paths of a pair below a node end
    for _ in range(1_000):
        ends = (1 - threshold * (1 - ends)) ** branches(threshold)
    lost = 1 - threshold * (1 - ends)
    return 1 if lost <= MISSED else min(SLOTS, math.ceil(math.log(MISSED) / math.log(lost)))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, hashes, offsets``: the distinct shingles of each text, sorted.

    A text with fewer than five words is one shingle; one without words has none.
    """
    for row, data, offsets in K.pieces(texts):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, K.SPACES)
        each = K.span_hash(K.prefix_hash(data), starts, ends)
        rolled = np.zeros(max(len(each) - WIDTH + 1, 0), np.uint64)
        for k in range(WIDTH):
            rolled = rolled * np.uint64(K.BASE) + each[k:len(each) - WIDTH + 1 + k]
        rolled = K.mix(rolled)
        sets, sizes = [], np.zeros(len(first) - 1, np.int64)
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= WIDTH:
                own = np.unique(rolled[a:b - WIDTH + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in each[a:b]:
                        whole = whole * np.uint64(K.BASE) + x
                own = K.mix(np.array([whole]) ^ np.uint64(0x5BF03635))
            else:
                continue
            sizes[i] = len(own)
            sets.append(own)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield row, hashes, np.concatenate([[0], np.cumsum(sizes)])


def minwise(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``SLOTS`` minwise values for each set; the sets must not be empty."""
    out = np.empty((len(offsets) - 1, SLOTS), np.uint64)
    row = 0
    while row < len(offsets) - 1:  # parts that stay in the processor's cache
        last = int(np.searchsorted(offsets, offsets[row] + 32_768, side="right")) - 1
        last = max(last, row + 1)
        own, at = hashes[offsets[row]:offsets[last]], offsets[row:last] - offsets[row]
        for k in range(SLOTS):
            out[row:last, k] = np.minimum.reduceat((own ^ FLIPS[k]) * FACTORS[k], at)
        row = last
    return out


def sign(roots: int):
    """``doc_id, text`` to ``SIGNED``; without shingles, paths and sketch are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, hashes, offsets in shingle_sets(batch.column("text")):
                n = len(offsets) - 1
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                own = offsets[np.append(full, n)]
                low = minwise(hashes, own) if len(full) else np.zeros((0, SLOTS), np.uint64)
                sums = np.zeros((2, n), np.uint64)
                if len(full):
                    sums[0, full] = np.add.reduceat(hashes, own[:-1])
                    sums[1, full] = np.add.reduceat(K.mix(hashes), own[:-1])
                paths, sketch = [None] * n, [None] * n
                first = K.mix(low[:, :roots] + np.arange(roots, dtype=np.uint64)).view(np.int64)
                small = (K.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
                for k, i in enumerate(full):
                    paths[i], sketch[i] = first[k], small[k].tobytes()
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, n), pa.array(sizes), pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)), pa.array(paths, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ], names=["doc_id", "n_shingles", "set_a", "set_b", "paths", "sketch"])

    return run


def branch(paths: int):
    """Rows of large nodes to their children, by tokens that the node chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            nodes = batch.column("node").to_numpy().view(np.uint64)
            sketch = K.fixed_binary(batch.column("sketch"), SLOTS, np.uint16)
            rows = np.arange(len(nodes))
            for k in range(paths):
                slot = (K.mix(nodes + np.uint64(k + 1)) % np.uint64(SLOTS)).astype(np.int64)
                child = K.mix(K.mix(nodes) + sketch[rows, slot] + (slot.astype(np.uint64) << np.uint64(20)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), batch.column("id"), batch.column("sketch")],
                    names=["node", "id", "sketch"])

    return run


def sketch_groups(threshold: float):
    """Members of a node that sketches connect: ``group_id, id``, singles left out."""
    least = (threshold - margin(threshold)) * SLOTS

    def run(batches):
        for table in K.whole_groups(batches, "node"):
            nodes = table.column("node").to_numpy()
            ids = table.column("id").to_numpy()
            sketch = K.fixed_binary(table.column("sketch"), SLOTS, np.uint16)
            left, right = [], []
            rows = np.arange(len(nodes))
            for step in range(1, len(nodes)):
                rows = rows[:np.searchsorted(rows, len(nodes) - step)]
                rows = rows[nodes[rows] == nodes[rows + step]]
                if not len(rows):
                    break
                for part in np.array_split(rows, len(rows) // 20_000 + 1):
                    alike = (sketch[part] == sketch[part + step]).sum(1, dtype=np.int16) >= least
                    left.append(part[alike])
                    right.append(part[alike] + step)
            if not left:
                continue
            left, right = np.concatenate(left), np.concatenate(right)
            label = K.labels_of(len(nodes), left, right)
            in_group = np.bincount(label, minlength=len(nodes))[label] > 1
            ids, label = ids[in_group], label[in_group]
            # the same members get the same name in every tree
            name = np.zeros(len(nodes), np.uint64)
            np.add.at(name, label, K.mix(ids.view(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(K.mix(name[label]).view(np.int64)), pa.array(ids)], names=["group_id", "id"])

    return run


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to ``id, shingles``: the sorted set as bytes of 64-bit hashes."""
    for batch in batches:
        for row, hashes, offsets in shingle_sets(batch.column("text")):
            n = len(offsets) - 1
            sets = [hashes[offsets[i]:offsets[i + 1]].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, n), pa.array(sets, pa.binary())],
                names=["id", "shingles"])


def verified_links(num: int, den: int):
    """Links ``a, b`` with den * intersection >= num * union that join a group's members."""

    def run(batches):
        for table in K.whole_groups(batches, "group_id"):
            groups = table.column("group_id").to_numpy()
            ids = table.column("id").to_numpy()
            bounds = np.flatnonzero(np.diff(groups)) + 1
            a_out, b_out = [], []
            for low, high in zip(np.append(0, bounds), np.append(bounds, len(groups))):
                if high - low < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64)
                        for x in table.column("shingles").slice(low, high - low).to_pylist()]
                a, b = _group_links(sets, num, den)
                a_out.append(ids[low + a])
                b_out.append(ids[low + b])
            if a_out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))],
                    names=["a", "b"])

    return run


def _group_links(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links between the sets of one group."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat, offsets = np.concatenate(sets), np.append(0, np.cumsum(sizes))
    tokens = np.unique(flat, return_inverse=True)[1]
    seen = np.zeros(int(tokens.max()) + 1, bool)
    label = np.arange(n)
    left, right = [], []
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        small, big = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[den * small >= num * big]
        if not len(others):
            continue
        own = tokens[offsets[i]:offsets[i + 1]]
        seen[own] = True
        for part in np.array_split(others, int(sizes[others].sum() // 2_000_000) + 1):
            if not len(part):
                continue
            hits = np.concatenate([seen[tokens[offsets[j]:offsets[j + 1]]] for j in part])
            at = np.append(0, np.cumsum(sizes[part]))[:-1]
            both = np.add.reduceat(hits, at, dtype=np.int64)
            for j in part[den * both >= num * (sizes[part] + sizes[i] - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    left.append(i)
                    right.append(j)
        seen[own] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def to_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted with their centre first to ``centre, id, both, either`` of each member."""
    centre = None
    for batch in batches:
        turn = batch.column("turn").to_pylist()
        parts = list(zip(batch.column("centre").to_pylist(), batch.column("part").to_pylist()))
        rows, both, either = [], [], []
        for i, value in enumerate(batch.column("shingles")):
            own = np.frombuffer(value.as_py(), np.uint64)
            if turn[i] == 0:
                if centre is None or centre[0] != parts[i]:  # one set of a repeated key serves
                    centre = parts[i], own
                continue
            n = len(np.intersect1d(own, centre[1], assume_unique=True))
            rows.append(i)
            both.append(n)
            either.append(len(own) + len(centre[1]) - n)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([
            batch.column("centre").take(at), batch.column("id").take(at),
            pa.array(both, pa.int64()), pa.array(either, pa.int64()),
        ], names=["centre", "id", "both", "either"])


def _by_node(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, "id")


def _sized(rows: DataFrame) -> DataFrame:
    """``node, id, sketch, n`` of nodes with two members or more."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stage(rows.select("node", "id", "sketch").join(counts, "node"))


def _full_sets(source: DataFrame, ids: DataFrame) -> DataFrame:
    return (source.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .mapInArrow(shingle_rows, "id long, shingles binary").dropDuplicates(["id", "shingles"]))


def _around_centres(large: DataFrame, source: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of members to the centres of their nodes, and the members with open pairs.

    The same member and centre meet in many nodes and are compared once.  A hot centre
    is spread: its members are in parts, each with a copy of the centre.
    """
    centres = large.groupBy("node").agg(F.min("id").alias("centre"))
    around = stage(large.join(centres, "node"))
    pairs = (around.where("id <> centre").groupBy("centre", "id").agg(F.max("n").alias("n"))
             .select("centre", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / NODE_ROWS)).alias("part")))
    pairs = stage(pairs.withColumn("turn", F.lit(1)))
    heads = pairs.select("centre", "part").distinct().select(
        "centre", F.col("centre").alias("id"), "part", F.lit(0).alias("turn"))
    rows = pairs.union(heads)
    measured = stage(
        rows.join(_full_sets(source, rows), "id").repartition("centre", "part")
        .sortWithinPartitions("centre", "part", "turn", "id")
        .select("centre", "part", "turn", "id", "shingles")
        .mapInArrow(to_centre, "centre long, id long, both long, either long"))
    linked = den * F.col("both") >= num * F.col("either")
    distance = 1 - F.col("both") / F.col("either")
    # a repeated key has several sets: it is settled only if all of them are
    known = measured.groupBy("centre", "id").agg(
        F.max(distance).alias("far"), F.min(F.when(~linked, distance)).alias("open"))
    seen = stage(around.join(known, ["centre", "id"]).select("node", "id", "sketch", "far", "open"))
    gaps = seen.groupBy("node").agg(F.min("open").alias("gap"))
    reach = F.col("far") + (1 - num / den) + 1e-9
    rest = seen.join(gaps, "node").where(F.col("open").isNotNull() | (reach >= F.col("gap")))
    return measured.where(linked).select(F.col("centre").alias("a"), F.col("id").alias("b")), _sized(rest)


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Members of nodes in pairs of blocks, so that any two members meet in a small node."""
    blocks = F.ceil(F.col("n") * 2 / NODE_ROWS)
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"),
                      "id", "sketch")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    threshold: tuple[int, int] = (85, 100), keep_copies: Column | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    ``threshold`` is a fraction: linked means intersection / union >= num / den.  Null
    and empty texts, or texts of blanks, have no shingles and stay alone.  Rows of one
    key count as copies of one document: their sets are joined by the key, and each
    gets a row.  A null key gets a row of its own with itself (null) as component and
    ``kept`` true.  Other columns are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    num, den = threshold
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(source.mapInArrow(sign(trees(num / den)), SIGNED))
    sets = (signed.where("n_shingles > 0 and doc_id is not null")
            .groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id")))
    sets = stage(sets)
    own = signed.where("n_shingles > 0 and doc_id is not null").select(
        F.col("doc_id").alias("id"), "set_a", "set_b", "n_shingles", "paths", "sketch")
    chosen = stage(own.join(sets, ["id", "set_a", "set_b", "n_shingles"]).select(
        "id", "paths", "sketch"))
    steps = chosen.select("id", F.explode("paths").alias("node")).distinct()
    level = _sized(steps.join(chosen.select("id", "sketch"), "id"))
    found, links = [], []

    def compare(rows: DataFrame) -> None:
        found.append(_by_node(rows.select("node", "id", "sketch"), "node")
                     .mapInArrow(sketch_groups(num / den), "group_id long, id long"))

    depth = 0
    while True:
        compare(level.where(F.col("n") <= NODE_ROWS))
        large = level.where(F.col("n") > NODE_ROWS)
        if large.isEmpty():
            break
        close, rest = _around_centres(large, source, num, den)
        links.append(close)
        compare(rest.where(F.col("n") <= NODE_ROWS))
        large = rest.where(F.col("n") > NODE_ROWS)
        depth += 1
        if depth == MAX_DEPTH:
            compare(_block_pairs(large))
            break
        level = _sized(large.select("node", "id", "sketch")
                       .mapInArrow(branch(branches(num / den)), "node long, id long, sketch binary")
                       .dropDuplicates(["node", "id", "sketch"]))
    groups = found[0]
    for more in found[1:]:
        groups = groups.union(more)
    groups = stage(groups.distinct())
    links.append(_by_node(groups.join(_full_sets(source, groups), "id"), "group_id").mapInArrow(
        verified_links(num, den), "a long, b long"))
    same_key = own.join(sets.withColumnRenamed("id", "b"), ["set_a", "set_b", "n_shingles"]).select(
        F.col("id").alias("a"), "b").where("a <> b")
    for more in links:
        same_key = same_key.union(more)
    joined = components(same_key)
    return (signed.join(joined, signed.doc_id == joined.node, "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
