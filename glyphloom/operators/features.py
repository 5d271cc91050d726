"""Term statistics, vocabulary, TF-IDF weights and fixed-length encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.text import let, ngrams, tokens
from glyphloom.operators import bigrams
from glyphloom.session import stage

BROADCAST_ROWS = 200_000  # counted terms; those beyond join by shuffle
PAD_ID, UNKNOWN_ID, FIRST_TERM_ID = 0, 1, 2


def _with_terms(rows: DataFrame, vocabulary: DataFrame, how: str) -> DataFrame:
    """Join ``rows`` to a ranked vocabulary on ``term``, by its counted size.

    The first ``BROADCAST_ROWS`` ranks are broadcast.  They hold the frequent terms, so
    what a larger vocabulary leaves for the shuffle has no hot key of its own.
    """
    if vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(vocabulary), "term", how)
    head = F.broadcast(vocabulary.where(F.col("rank") <= BROADCAST_ROWS))
    rest = rows.join(head.select("term"), "term", "left_anti")
    tail = vocabulary.where(F.col("rank") > BROADCAST_ROWS)
    return rows.join(head, "term").unionByName(rest.join(tail, "term", how))


def term_rows(rows: DataFrame, key: str | list[str], text: str, n: int = 2, outer: bool = False) -> DataFrame:
    """``key, term, tf``: one row per distinct term of each text.

    ``key`` may name several columns.  With ``outer`` a text without terms keeps
    one row, with null ``term`` and ``tf``.

    Terms are counted inside their own row: sorted, equal terms lie together, so
    a count is the distance between two starts.  No shuffle is involved.
    """
    def starts(terms: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(terms) - 1)
        return F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))

    def counts(terms: Column, starts: Column) -> Column:
        return F.transform(starts, lambda start, i: F.struct(
            F.get(terms, start).alias("term"),
            (F.coalesce(F.get(starts, i + 1), F.size(terms)) - start).cast("long").alias("tf"),
        ))

    ordered = F.sort_array(ngrams(tokens(F.col(text)), n))
    counted = let(ordered, lambda terms: F.when(
        F.size(terms) > 0, let(starts(terms), lambda first: counts(terms, first))))
    keys = [key] if isinstance(key, str) else list(key)
    return rows.select(*keys, (F.inline_outer if outer else F.inline)(counted))


def term_statistics(terms: DataFrame) -> DataFrame:
    """``term, corpus_count, doc_count`` from ``term_rows``, combined before the shuffle."""
    return terms.groupBy("term").agg(
        F.sum("tf").alias("corpus_count"), F.count(F.lit(1)).alias("doc_count")
    )


def top_terms(statistics: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent terms with their ``rank``; ties by term.

    A histogram over powers of two (at most 63 rows) gives a frequency floor
    that leaves little more than ``limit`` terms, so the final sort does not
    receive ``limit`` rows from every partition.
    """
    power = F.floor(F.log2(F.col("corpus_count").cast("double")))
    histogram = statistics.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    reached = F.sum("n").over(Window.orderBy(F.desc("p")))
    before = reached - F.col("n")
    needed = histogram.withColumn("before", before).where(F.col("before") < limit)
    floor = needed.select(F.min("p")).scalar()
    best = (
        statistics.where(power >= floor)
        .orderBy(F.desc("corpus_count"), "term").limit(limit)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("corpus_count"), "term"))
    return best.select("term", "corpus_count", "doc_count", rank.alias("rank"))


def ranked_terms(statistics: DataFrame) -> DataFrame:
    """All terms with their ``rank``, in the order of ``top_terms``.

    Terms are sorted in ranges of their order; a rank is the place in the range after
    all terms of the ranges before, so no task sees more than its range.
    """
    order = [F.desc("corpus_count"), F.asc("term")]
    placed = stage(
        statistics.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("term", "corpus_count", "doc_count", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33).alias("_part")  # the id is the partition, then 33 bits of the row
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        "term", "corpus_count", "doc_count", (F.col("_before") + place + 1).cast("int").alias("rank"))


def _frequent_statistics(rows: DataFrame, text: str, limit: int) -> DataFrame | None:
    """``term_statistics`` of uni- and bigrams, for all terms that can be among the ``limit`` most frequent.

    The ``limit``-th word's count is a floor: a term below it is not among them, nor is a
    bigram with a word below it.  None if more words than can be broadcast reach the floor.
    """
    words = stage(rows.select(bigrams.plain_text(F.col(text)).alias("words")))
    singles = stage(bigrams.word_statistics(words))
    counts = Window.orderBy(F.desc("corpus_count"))
    sizes = singles.groupBy("corpus_count").agg(F.count(F.lit(1)).alias("_n"))
    reached = sizes.withColumn("_upto", F.sum("_n").over(counts)).where(F.col("_upto") >= limit)
    floor = reached.agg(F.coalesce(F.max("corpus_count"), F.lit(1))).first()[0]
    singles = singles.where(F.col("corpus_count") >= floor)
    known = [r.term for r in singles.select("term").limit(BROADCAST_ROWS + 1).collect()]
    if len(known) > BROADCAST_ROWS:
        return None
    entries = singles.agg(F.sum("corpus_count")).first()[0] or 0
    pairs = bigrams.pair_statistics(words, known, floor, entries)
    numbered = rows.sparkSession.createDataFrame(list(enumerate(known)), "number long, word string")
    return singles.unionByName(bigrams.pair_terms(pairs, numbered))


def fit_vocabulary(
    rows: DataFrame, key: str, text: str, max_features: int | None = V.MAX_FEATURES, n: int = 2
) -> DataFrame:
    """``term, corpus_count, doc_count, rank, idf`` for the most frequent terms.

    Like any fit it runs at once: the texts are read one time, the statistics
    are staged, and what comes back is a table of at most ``max_features`` rows,
    or of all terms for None.
    """
    if n == 1:
        statistics = bigrams.word_statistics(rows.select(bigrams.plain_text(F.col(text)).alias("words")))
    else:
        statistics = _frequent_statistics(rows, text, max_features) if max_features else None
    statistics = stage(term_statistics(term_rows(rows, key, text, n)) if statistics is None else statistics)
    documents = rows.count()
    # smoothed inverse document frequency, as if one text held every term
    idf = F.log(F.lit(1.0 + documents) / (F.col("doc_count") + 1)) + 1
    ranked = ranked_terms(statistics) if max_features is None else top_terms(statistics, max_features)
    return stage(ranked.withColumn("idf", idf))


def tfidf_weights(
    rows: DataFrame, key: str, text: str, vocabulary: DataFrame, n: int = 2,
) -> DataFrame:
    """``key, term, weight``: tf times idf, scaled to length 1 per text.

    A vocabulary that can be broadcast is looked up text by text, and the norm is summed over
    texts, not terms.  With a larger one texts are spread by key while each is one row, so
    their terms need no shuffle to meet for the norm.
    """
    known = vocabulary.select("term", "idf").limit(BROADCAST_ROWS + 1).collect()
    if len(known) <= BROADCAST_ROWS:
        texts = bigrams.weighed(rows, key, text, [(r.term, r.idf) for r in known], n)
        norm = F.sqrt(F.sum("_squares").over(Window.partitionBy(key)))
        return texts.withColumn("_norm", norm).select(
            key, "_norm", F.inline(F.arrays_zip("_terms", "_weights"))
        ).select(key, F.col("_terms").alias("term"), (F.col("_weights") / F.col("_norm")).alias("weight"))
    terms = term_rows(rows.select(key, text).repartition(key), key, text, n)
    weighted = _with_terms(terms, vocabulary.select("term", "rank", "idf"), "inner").select(
        key, "term", (F.col("tf") * F.col("idf")).alias("_w")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / norm).alias("weight"))


def encode_fixed(
    rows: DataFrame, key: str, text: str, vocabulary: DataFrame,
    max_length: int = V.MAX_TOKENS,
) -> DataFrame:
    """``key, n_tokens, truncated, input_ids, attention_mask, labels``.

    Word ids are vocabulary ranks shifted past padding and unknown.  Longer texts
    are cut at ``max_length``, shorter ones padded on the right; ``labels`` repeat
    the ids, padding included.  Keys must be unique, so that a text is regrouped
    from at most ``max_length`` positions.
    """
    words = rows.select(key, tokens(F.col(text)).alias("_t")).select(
        key, F.size("_t").alias("n_tokens"),
        F.coalesce(F.array_join(F.slice("_t", 1, max_length), " "), F.lit("")).alias("words"))
    ids = vocabulary.select("term", (F.col("rank") + (FIRST_TERM_ID - 1)).alias("_id"))
    known = ids.where(F.col("_id") <= BROADCAST_ROWS + FIRST_TERM_ID).collect()
    if len(known) <= BROADCAST_ROWS:
        placed = bigrams.numbered(words, [(r.term, r["_id"]) for r in known], UNKNOWN_ID).select(key, "n_tokens", "_at")
    else:
        # rarer words join by shuffle: the few places that hold them, not the texts
        head = [(r.term, r["_id"]) for r in known if r["_id"] < BROADCAST_ROWS + FIRST_TERM_ID]
        looked_up = stage(bigrams.numbered(words, head, None))
        rest = looked_up.select(key, "n_tokens", F.inline("_rest"))
        tail = ids.where(F.col("_id") >= BROADCAST_ROWS + FIRST_TERM_ID)
        at = F.shiftleft(F.col("_pos").cast("long"), 32).bitwiseOR(F.coalesce("_id", F.lit(UNKNOWN_ID)).cast("long"))
        placed = looked_up.select(key, "n_tokens", "_at").unionByName(
            rest.join(tail, "term", "left").select(key, "n_tokens", F.array(at).alias("_at")))
    number = (1 << 32) - 1
    kept = placed.groupBy(key, "n_tokens").agg(
        F.transform(F.sort_array(F.flatten(F.collect_list("_at"))),
                    lambda a: a.bitwiseAND(F.lit(number)).cast("int")).alias("_ids"))
    used = F.size("_ids")
    rest = max_length - used
    input_ids = F.concat("_ids", F.array_repeat(F.lit(PAD_ID), rest))
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), rest))
    return kept.select(
        key, "n_tokens", (F.col("n_tokens") > max_length).alias("truncated"),
        input_ids.alias("input_ids"), mask.alias("attention_mask"), input_ids.alias("labels"),
    )
