"""File sources and sinks."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions.text import NON_SPACE, strip
from glyphloom.session import stage

SAMPLE_SCHEMA = "text string, emoji string, type string, true_sentiment string"
BROADCAST_BLOCKS = 500_000  # counted rows of one path and five longs


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value``: the lines of a text file or folder, numbered from 0.

    Files follow one another by path.  Blank lines before the first and after the
    last text of a file are not counted.

    Large files are read in blocks.  Inside a block the ids Spark hands out rise
    by one per line; with the number of lines in the blocks and files before, that
    gives the line number without sorting or moving a line.  The read is staged
    first, so that ids and blocks stay as they were even if a task runs again.
    """
    read = stage(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"), "value",
    ))
    filled = F.when(F.col("value").rlike(NON_SPACE), F.col("seen"))
    blocks = read.groupBy("file", "block").agg(
        F.min("seen").alias("first"), F.count(F.lit(1)).alias("n"),
        F.min(filled).alias("low"), F.max(filled).alias("high"),
    )
    # one row per block: its place in its file, and the part of the file that counts
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    placed = blocks.withColumn("shift", before - F.col("first"))
    whole = Window.partitionBy("file")
    ranged = placed.select(
        "file", "block", "shift", F.min(F.col("low") + F.col("shift")).over(whole).alias("low"),
        F.max(F.col("high") + F.col("shift")).over(whole).alias("high"),
    )
    # one row per file: the lines in the files before
    files = ranged.where("low is not null").groupBy("file").agg(
        F.first(F.col("high") - F.col("low") + 1).alias("lines"))
    earlier = F.sum("lines").over(Window.orderBy("file")) - F.col("lines")
    starts = stage(ranged.join(files.select("file", earlier.alias("earlier")), "file").select(
        "file", "block", "shift", "low", "high", "earlier"))
    if starts.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    at = F.col("seen") + F.col("shift")
    return read.join(starts, ["file", "block"]).where(at.between(F.col("low"), F.col("high"))).select(
        (F.col("earlier") + at - F.col("low")).alias("line_no"), "value"
    )


def aligned_lines(
    spark: SparkSession, text_path: str, label_path: str, on_mismatch: str = "error"
) -> DataFrame:
    """``post_id, raw, label`` from a text and a label file, paired by line.

    A line without partner fails the job, or with ``on_mismatch="keep"`` has a
    null on the other side.  A label that is no integer always fails.
    """
    if on_mismatch not in ("error", "keep"):
        raise ValueError("on_mismatch is 'error' or 'keep'")
    texts = numbered_lines(spark, text_path).withColumnRenamed("value", "raw")
    values = numbered_lines(spark, label_path)
    written = strip(F.col("value"))
    number = written.try_cast("int")
    bad = F.raise_error(F.concat(F.lit("not a label: "), written))
    labels = values.select("line_no", F.coalesce(number, bad).alias("label"))
    pairs = texts.join(labels, "line_no", "full_outer")
    if on_mismatch == "error":
        alone = F.col("raw").isNull() | F.col("label").isNull()
        message = F.concat(F.lit("no partner for line "), F.col("line_no").cast("string"))
        pairs = pairs.withColumn("raw", F.when(alone, F.raise_error(message)).otherwise(
            F.col("raw")))
    return pairs.select(F.col("line_no").alias("post_id"), "raw", "label")


def read_samples(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """``seq, text, emoji, type, true_sentiment`` from JSON Lines (the default) or JSON arrays.

    ``seq`` numbers the samples over all files, by path, however the files are
    cut into tasks.  JSON Lines are split between tasks; in array mode each file
    must be one array (a file is one task), and the number of samples in the
    files before comes from one count per file.  Input of the other kind fails
    the job instead of being read in part: a line that opens an array in lines
    mode, a file that is not one array in array mode.
    """
    if lines:
        value = F.col("value")
        opens_array = F.ltrim(value).startswith("[")
        parsed = numbered_lines(spark, path).where(value.rlike(NON_SPACE)).select(
            F.col("line_no").alias("seq"),
            F.when(opens_array, F.raise_error(F.lit("a JSON array where JSON Lines were expected")))
            .otherwise(F.from_json(value, SAMPLE_SCHEMA, {"mode": "FAILFAST"})).alias("sample"))
        return parsed.select("seq", "sample.*")
    return _array_samples(spark, path)


def _array_samples(spark: SparkSession, path: str) -> DataFrame:
    whole = F.trim(F.col("value"))
    one_array = whole.startswith("[") & whole.endswith("]")
    fail = F.raise_error(F.concat(F.lit("not one JSON array: "), F.col("file")))
    items = F.from_json(whole, f"array<struct<{SAMPLE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>",
                        {"mode": "FAILFAST"})
    arrays = stage(spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.when(one_array, items).otherwise(fail).alias("items")))
    counts = arrays.select("file", F.size("items").alias("n"))
    earlier = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("earlier"))
    return arrays.join(F.broadcast(earlier), "file").select(
        "earlier", F.posexplode("items").alias("at", "sample")).select(
        (F.col("earlier") + F.col("at")).alias("seq"), "sample.*")


def read_samples_if_present(
    spark: SparkSession, path: str | None, lines: bool = True
) -> DataFrame | None:
    """Like ``read_samples``; None, with a warning, when there is no such path."""
    if path is None:
        return None
    try:
        return read_samples(spark, path, lines)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no samples at {path}, going on without", stacklevel=2)
        return None


def write_samples(samples: DataFrame, path: str) -> None:
    """JSON Lines with every key present; non-ASCII text stays readable."""
    samples.write.option("ignoreNullFields", False).json(path)


def write_report(table: DataFrame, path: str) -> None:
    """A small result table (rows per model) as one CSV file with a header."""
    table.repartition(1).write.option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report: ``model`` as text, all metrics as doubles, absent ones null."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` {'string' if c == 'model' else 'double'}" for c in names)
    return spark.read.schema(schema).option("header", True).csv(path)
