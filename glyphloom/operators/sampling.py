"""Seeded sampling, splitting and shuffling with exact sizes.

Each row gets a *draw*: the MD5 of seed and row key, a uniform number that does
not depend on partitioning, engine or run.  "The k rows with the smallest
draws" is then an order-statistic problem: count draws by their leading hex
digits (at most 4,096 counts per group and level), walk down to the digit range
that holds the k-th draw, and keep every row up to it with a plain filter.  So
the rows themselves are never sorted, shuffled or gathered.

The input is read once per level and once for the result; only key and group
are needed before that, so stage an input that is costly to compute.

Rows that share a key are ordered by a second draw over their content, and rows
equal in every column are interchangeable, so sizes are exact on repeated keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

DIGITS = 3  # hex digits per level: 4,096 ranges, two levels split rows 16.7M ways
POSITION_DIGITS = 4


def draw(key: Column, seed: int = 42) -> Column:
    """The row's draw as 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def share(fraction: float) -> Callable[[Column, Column], Column]:
    """Size rule: ``ceil(fraction * rows)`` rows of each group."""
    return lambda total, _group: F.ceil(F.lit(float(fraction)) * total.cast("double"))


def bounds(keyed: DataFrame, wanted: Column) -> DataFrame:
    """``g, d, take, at``: per group the draw of the last row to keep, how many rows
    with that draw to keep, and how many rows have it.

    ``keyed`` holds ``g, d``, rows with a null draw are never counted;
    ``wanted`` is the number of rows to keep, an expression over the group's
    ``total`` and ``g``.  Groups that keep nothing are absent.  Two levels count
    draws by leading digits; in the range found, rows are counted by their whole
    draw, so copies of one hot key are a hash aggregate, not one task's sort.
    """
    keyed = keyed.where(F.col("d").isNotNull())

    def walk(counts: DataFrame, wanted: Column, by: str) -> DataFrame:
        """The entry where the running count reaches the wanted number."""
        ordered = Window.partitionBy("g").orderBy(by)
        reached = counts.withColumn("upto", F.sum("n").over(ordered)).withColumn("want", wanted)
        return reached.where(
            (F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))
        ).select("g", by, "n", (F.col("want") - (F.col("upto") - F.col("n"))).alias("want"))

    def counts_of(frame: DataFrame, length: int, *carried: str) -> DataFrame:
        span = F.substring("d", 1, length).alias("range")
        return frame.groupBy("g", *carried, span).agg(F.count(F.lit(1)).alias("n"))

    def inside(found: DataFrame, length: int) -> DataFrame:
        """Rows of the found range (one per group), with what is still wanted of it."""
        ranged = keyed.withColumn("range", F.substring("d", 1, length))
        return ranged.join(F.broadcast(found.select("g", "range", "want")), ["g", "range"]).select("g", "d", "want")

    total = F.sum("n").over(Window.partitionBy("g"))
    first = counts_of(keyed, DIGITS).withColumn("total", total)
    level1 = walk(first, F.least(wanted.cast("long"), F.col("total")), "range")
    level2 = walk(counts_of(inside(level1, DIGITS), 2 * DIGITS, "want"), F.col("want"), "range")
    # what is left shares 24 bits of its draws: distinct draws of the range, with their counts
    draws = inside(level2, 2 * DIGITS).groupBy("g", "want", "d").agg(F.count(F.lit(1)).alias("n"))
    last = walk(draws, F.col("want"), "d")
    return last.select("g", "d", F.col("want").alias("take"), F.col("n").alias("at"))


def _as_map(found: DataFrame, value: Column, eager: bool) -> Column:
    """``map<g, value>`` of ``found``: collected now (one row per group) or a scalar subquery."""
    if eager:
        rows = found.select("g", value.alias("v")).collect()
        def literal(x):
            if isinstance(x, Row):
                return F.struct(*[F.lit(v).alias(k) for k, v in x.asDict().items()])
            return F.lit(x)

        if rows:
            return F.create_map(*[literal(x) for row in rows for x in (row.g, row.v)])
    return found.select(F.map_from_entries(F.collect_list(F.struct("g", value)))).scalar()


def draw_cut(
    rows: DataFrame, draw_col: str, size: Callable[[Column, Column], Column],
    group: Column | None = None, eager: bool = False,
) -> Column:
    """``map<group, draw>``: the largest draw to keep in each group.

    ``size(total, group)`` gives the number of rows wanted.  Groups that keep
    nothing are absent.  The number of groups must be small (data variants);
    without ``group`` the only one is ``"all"``.  Rows that share the bound's
    draw are all below it; ``exact_first`` keeps exactly the number wanted.

    The result is a scalar subquery, or with ``eager`` it is computed now and
    becomes a literal, for bounds that several passes use.
    """
    g = F.lit("all") if group is None else group
    keyed = rows.select(g.cast("string").alias("g"), F.col(draw_col).alias("d"))
    found = bounds(keyed, size(F.col("total"), F.col("g")))
    return _as_map(found, F.col("d"), eager)


def _keep(draw_col: str, cut: Column, group: Column | None) -> Column:
    g = F.lit("all") if group is None else group.cast("string")
    return F.coalesce(F.col(draw_col) <= F.try_element_at(cut, g), F.lit(False))


def exact_first(
    rows: DataFrame, key: str, size: Callable[[Column, Column], Column], group: Column | None = None,
    seed: int = 42, eager: bool = False, flag: str = "_first",
) -> DataFrame:
    """The rows with boolean ``flag``: true for exactly ``size(total, group)`` rows of each group.

    Rows are ordered by the draw of their key, rows of one key by a second draw,
    the MD5 of the row's whole content, so the choice does not depend on
    partitioning or run.  Rows that are equal in every column are
    interchangeable: of those at the bound one is taken by a hash aggregate and
    repeated as often as each flag needs, so a hot group of copies is never
    one task's work.  Rows with a null key are never flagged and not counted.
    An empty table gives an empty table.
    """
    columns = rows.columns
    g = (F.lit("all") if group is None else group).cast("string")
    drawn = rows.withColumn("_g", g).withColumn("_d", draw(F.col(key), seed))
    first = bounds(drawn.select(F.col("_g").alias("g"), F.col("_d").alias("d")), size(F.col("total"), F.col("g")))
    b1 = F.try_element_at(_as_map(first, F.struct("d", "take", "at"), eager), F.col("_g"))
    at_bound = F.col("_d") == b1["d"]
    split = at_bound & (b1["take"] < b1["at"])
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))
    drawn = drawn.withColumn("_c", F.when(split, content))
    tied = drawn.where(split).select(F.col("_g").alias("g"), F.col("_c").alias("d"))
    second = bounds(tied, F.try_element_at(_as_map(first, F.col("take"), eager), F.col("g")))
    b2 = F.try_element_at(_as_map(second, F.struct("d", "take", "at"), eager), F.col("_g"))
    alike = split & (F.col("_c") == b2["d"]) & (b2["take"] < b2["at"])
    chosen = (F.col("_d") < b1["d"]) | (at_bound & ~split) | (split & (F.col("_c") < b2["d"])) | (
        split & (F.col("_c") == b2["d"]) & (b2["take"] == b2["at"]))
    kept = drawn.where(~F.coalesce(alike, F.lit(False))).withColumn(flag, F.coalesce(chosen, F.lit(False)))
    copies = drawn.where(alike).groupBy("_g").agg(
        F.any_value(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row"),
        F.first(b2["take"]).alias("_take"), F.count(F.lit(1)).alias("_n"))
    repeated = copies.select(F.explode(F.array(
        F.struct(F.lit(True).alias("f"), F.col("_take").alias("k")),
        F.struct(F.lit(False).alias("f"), (F.col("_n") - F.col("_take")).alias("k")))).alias("_part"), "_row"
    ).select(F.col("_part.f").alias(flag), F.explode(F.array_repeat("_row", F.col("_part.k").cast("int"))).alias("_row"))
    return kept.select(*[F.col(f"`{c}`") for c in columns], flag).unionByName(
        repeated.select("_row.*", flag), allowMissingColumns=False)


def sample_exact(
    rows: DataFrame, key: str, n: int | None, seed: int = 42, eager: bool = False
) -> DataFrame:
    """``n`` rows without replacement; all rows for ``n`` of 0, None or too many.

    Exactly ``n`` rows also when keys repeat (``exact_first``); rows with a null
    key are never drawn.  ``eager`` finds the bounds now, for a sample that is
    used several times.
    """
    if not n:
        return rows
    flagged = exact_first(rows, key, lambda _total, _group: F.lit(int(n)), None, seed, eager)
    return flagged.where("_first").drop("_first")


def train_val_split(
    rows: DataFrame, key: str, test_size: float = 0.1, seed: int = 42,
    group: Column | None = None, eager: bool = False,
) -> DataFrame:
    """Add ``split``: ``val`` for exactly ``ceil(test_size * rows)`` rows, else ``train``.

    Exact also when keys repeat (``exact_first``); rows with a null key are
    ``train`` and not counted.  With ``group`` each of a few groups is split on
    its own.  ``eager`` finds the bounds now, for a split that is used several times.
    """
    flagged = exact_first(rows, key, share(test_size), group, seed, eager, "_val")
    label = F.when(F.col("_val"), "val").otherwise("train")
    return flagged.withColumn("split", label).drop("_val")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in a seeded random order (a range-partitioned sort)."""
    return rows.orderBy(draw(F.col(key), seed))


def shuffle_position(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``position``, 1-based, in the seeded random order.

    Positions are counted inside 65,536 draw ranges and shifted by the sizes of
    the ranges before, so no task sees more than its ranges.
    """
    drawn = rows.withColumn("_draw", draw(F.col(key), seed)).withColumn(
        "_range", F.substring("_draw", 1, POSITION_DIGITS)
    )
    sizes = drawn.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))  # <= 65,536 rows
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_draw"))
    return (
        drawn.withColumn("_inside", inside).join(starts, "_range")
        .withColumn("position", F.col("_before") + F.col("_inside"))
        .drop("_draw", "_range", "_inside", "_before")
    )
