"""Mixing of sources to target weights by pivotal dependent rounding.

A source's target fixes how often each of its documents is taken: a whole number of
times, and once more with the fractional part as probability.  Two documents with
fractional probabilities pass word mass between them until one is integral; the other
goes on to the next.  The words a pair stands for stay the same, and so do all
probabilities.  Groups of ``FAN`` documents do so in one row each, their residuals form
the groups of the next level, and so on: a reduction tree, whatever the size of a
source.  In the end one document a source is rounded by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"
FAN = 64
MOST = 3
CYCLE = (1, 2, 3)

UNIT = "struct<doc_id:bigint,size:bigint,n:bigint,base:bigint,mass:double,p:double>"
DONE = "array<struct<doc_id:bigint,size:bigint,n:bigint,copies:bigint>>"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, units, target`` for rows ``source, size, n``.

    Sources by code point, null last, weigh 1, 2, 3 and so on; a target stops at three
    times the source's size and the excess is shared by weight among the others.  One
    row a source is ranked in one task; no document is.
    """
    sums = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    ranked = sums.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]),
                               ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
                                % len(CYCLE) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(MOST)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # the share of one weight if all sources before this one stop at their bound; the
    # largest is the one at which no other source is above its bound
    share = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    return (ranked.withColumn("share", share).withColumn("share", F.max("share").over(everything))
            .select("source", "source_size", "units",
                    F.least("most", F.col("share") * F.col("weight")).alias("target")))


def _draw(level: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(level), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pair(level: int):
    """Pass mass between the residual and the next unit; the integral one is done."""

    def merge(state: Column, unit: Column) -> Column:
        held = state["held"]
        gain = F.least((1 - held["p"]) * held["mass"], unit["p"] * unit["mass"])
        loss = F.least(held["p"] * held["mass"], (1 - unit["p"]) * unit["mass"])
        total = gain + loss
        up = F.when(total > 0, _draw(level, held["doc_id"], held["size"], unit["doc_id"], unit["size"])
                    * total < loss).otherwise(held["p"] >= 0.5)
        held_full = (1 - held["p"]) * held["mass"] <= unit["p"] * unit["mass"]
        held_empty = held["p"] * held["mass"] <= (1 - unit["p"]) * unit["mass"]

        def kept(one: Column, p: Column) -> Column:
            return F.struct(*[one[c].alias(c) for c in ("doc_id", "size", "n", "base", "mass")],
                            F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

        def done(one: Column, more: int) -> Column:
            return F.struct(one["doc_id"].alias("doc_id"), one["size"].alias("size"),
                            one["n"].alias("n"), (one["base"] + more).alias("copies"))

        finished = (F.when(up & held_full, done(held, 1)).when(up, done(unit, 0))
                    .when(held_empty, done(held, 0)).otherwise(done(unit, 1)))
        residual = (F.when(up & held_full, kept(unit, unit["p"] - gain / unit["mass"]))
                    .when(up, kept(held, held["p"] + gain / held["mass"]))
                    .when(held_empty, kept(unit, unit["p"] + loss / unit["mass"]))
                    .otherwise(kept(held, held["p"] - loss / held["mass"])))
        return F.struct(residual.cast(UNIT).alias("held"),
                        F.concat(state["done"], F.array(finished)).cast(DONE).alias("done"))

    return merge


def mix_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``doc_id, source, size, n, source_size, target, copies``: one row for each
    distinct document, ``n`` of the given rows, each of them taken ``copies`` times.

    Null texts have size 0; null sources form one source, the last.  Documents without
    words are never taken.  Rows alike in key, source and size share their decision.
    An empty table, or one without words, gives targets of 0.  Other columns are
    ignored, whatever their names.  The same rows give the same decisions.
    """
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"))
    units = stage(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = stage(source_targets(units).withColumnRenamed("source", "s"))
    joined = units.join(targets, F.col("source").eqNullSafe(F.col("s")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("base", F.floor(times)).withColumn("p", times - F.col("base"))
    fixed = (F.col("size") == 0) | (F.col("p") == 0)
    settled = joined.where(fixed).select(
        "doc_id", "source", "size", "n",
        F.when(F.col("size") == 0, 0).otherwise(F.col("base")).cast("long").alias("copies"))
    buckets = F.ceil(F.col("units") / FAN)
    level_rows = joined.where(~fixed).select(
        "source", F.pmod(F.xxhash64("doc_id", "size"), buckets).alias("bucket"),
        F.struct("doc_id", "size", "n", F.col("base").cast("long"),
                 (F.col("size") * F.col("n")).cast("double").alias("mass"), "p").cast(UNIT).alias("unit"))
    widest = targets.agg(F.max("units")).first()[0] or 0
    level, groups = 0, -(-widest // FAN)
    while True:
        gathered = level_rows.groupBy("source", "bucket").agg(
            F.sort_array(F.collect_list("unit")).alias("units"))
        state = F.aggregate(
            F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0))),
            F.struct(F.element_at("units", 1).alias("held"), F.array().cast(DONE).alias("done")),
            _pair(level))
        tree = stage(gathered.select("source", "bucket", state.alias("state")))
        settled = settled.union(
            tree.select("source", F.explode("state.done").alias("d")).select(
                "d.doc_id", "source", "d.size", "d.n", "d.copies"))
        level_rows = tree.select(
            "source", F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("state.held").alias("unit"))
        if groups <= 1:
            break
        level, groups = level + 1, -(-groups // FAN)
    last = level_rows.select(
        "unit.doc_id", "source", "unit.size", "unit.n",
        (F.col("unit.base") + (_draw(-1, F.col("unit.doc_id"), F.col("unit.size")) < F.col("unit.p"))
         .cast("long")).alias("copies"))
    return settled.union(last).join(
        targets.drop("units"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of the mix: those of ``docs``, each as often as it is taken, same columns."""
    names = docs.columns
    copies = mix_copies(docs, key, text, source).where("copies > 0").select(
        F.col("doc_id").alias("_mix_key"), F.col("source").alias("_mix_source"),
        F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    same = (F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_mix_key"))
            & F.col(f"`{source}`").eqNullSafe(F.col("_mix_source"))
            & (word_count(F.col(f"`{text}`")) == F.col("_mix_size")))
    return (docs.join(copies, same)
            .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
            .select(*[f"`{c}`" for c in names]))
