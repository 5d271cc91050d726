"""Training sets and their variants as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.chat import chat_messages, render_chat, training_target
from glyphloom.functions.labels import emoji_of, label_of
from glyphloom.functions.text import clean_text, length_ok, where_length_ok
from glyphloom.operators.features import encode_fixed, fit_vocabulary
from glyphloom.operators.lookups import union_widened
from glyphloom.operators.sampling import draw, draw_cut, share
from glyphloom.session import stage


@dataclass(frozen=True)
class Variant:
    """One data variant; ``n`` or ``fraction`` limits the labelled posts."""

    name: str
    extra: bool = True
    constrain: bool = True
    n: int | None = None
    fraction: float | None = None


STANDARD_VARIANTS = (
    Variant("full"),
    Variant("no_extra", extra=False),
    Variant("no_constraint", constrain=False),
    Variant("half", fraction=0.5),
)


def labelled_posts(posts: DataFrame) -> DataFrame:
    """``row_key, text, label, emoji`` of cleaned posts with an allowed length."""
    kept = where_length_ok(
        posts.select("post_id", "label", "raw"), "text", clean_text(F.col("raw"))
    )
    return kept.select(
        F.concat(F.lit("post:"), F.col("post_id").cast("string")).alias("row_key"),
        "text", F.col("label").cast("int").alias("label"), emoji_of(F.col("label")).alias("emoji"),
    )


def extra_samples(samples: DataFrame) -> DataFrame:
    """Curated samples in the shape of posts: cleaned, but not filtered by length."""
    return samples.select(
        F.concat(F.lit("extra:"), F.col("seq").cast("string")).alias("row_key"),
        clean_text(F.col("text")).alias("text"), label_of(F.col("emoji")).alias("label"),
        "emoji", "type", "true_sentiment",
    )


def _wanted_posts(variants: tuple[Variant, ...], total: Column, group: Column) -> Column:
    """Number of posts each variant takes; all of them without a limit."""
    size = total
    for v in variants:
        if v.n:
            size = F.when(group == v.name, F.lit(int(v.n))).otherwise(size)
        elif v.fraction is not None:
            part = F.floor(total.cast("double") * F.lit(float(v.fraction)))
            size = F.when(group == v.name, part).otherwise(size)
    return size


def _assign(rows: DataFrame, variants: tuple[Variant, ...]) -> DataFrame:
    """One copy of a row per variant that takes it."""
    names = [
        F.when(F.lit(v.extra) | ~F.col("is_extra"), F.lit(v.name)) for v in variants
    ]
    return rows.withColumn("variant", F.explode(F.array_compact(F.array(*names))))


def dataset_variants(
    posts: DataFrame, extra: DataFrame | None = None,
    variants: tuple[Variant, ...] = STANDARD_VARIANTS, test_size: float = 0.1, seed: int = 42,
    staged: bool = True,
) -> DataFrame:
    """``variant, split, row_key, text, label, emoji, type, true_sentiment``.

    Posts are cleaned, filtered and, where a variant asks for it, sampled; extra
    samples join after that; the split is over the union.  All variants share one
    pass over the texts: it is staged, and the passes that find sample and split
    bounds read only its keys.
    """
    base = labelled_posts(posts).withColumn("is_extra", F.lit(False))
    if extra is not None:
        base = union_widened(base, extra_samples(extra).withColumn("is_extra", F.lit(True)))
    else:
        base = base.withColumns({
            "type": F.lit(None).cast("string"), "true_sentiment": F.lit(None).cast("string"),
        })
    base = base.withColumn("_draw", draw(F.col("row_key"), seed))
    if staged:
        base = stage(base)
    rows = _assign(base, variants)
    group = F.col("variant")
    limited = [v.name for v in variants if v.n or v.fraction is not None]
    if limited:
        sampled = rows.where(~F.col("is_extra") & group.isin(limited))
        bound = draw_cut(
            sampled, "_draw", lambda total, g: _wanted_posts(variants, total, g), group, staged
        )
        inside = F.coalesce(F.col("_draw") <= F.try_element_at(bound, group), F.lit(False))
        rows = rows.where(F.col("is_extra") | ~group.isin(limited) | inside)
    # the split draws anew, so that it does not follow the sample
    rows = rows.withColumn("_split", draw(F.concat(F.lit("split:"), F.col("row_key")), seed))
    bound = draw_cut(rows, "_split", share(test_size), group, staged)
    in_val = F.coalesce(F.col("_split") <= F.try_element_at(bound, group), F.lit(False))
    return rows.select(
        "variant", F.when(in_val, "val").otherwise("train").alias("split"),
        "row_key", "text", "label", "emoji", "type", "true_sentiment",
    )


def with_chat(rows: DataFrame, constrain: Column | bool = True) -> DataFrame:
    """Add ``target`` (JSON text) and ``messages``."""
    target = training_target(F.col("emoji"), F.col("text"))
    rows = rows.withColumn("target", target)
    if isinstance(constrain, bool):
        return rows.withColumn(
            "messages", chat_messages(F.col("text"), F.col("target"), constrain)
        )
    both = [chat_messages(F.col("text"), F.col("target"), c) for c in (True, False)]
    return rows.withColumn("messages", F.when(constrain, both[0]).otherwise(both[1]))


def variants_with_chat(
    rows: DataFrame, variants: tuple[Variant, ...] = STANDARD_VARIANTS
) -> DataFrame:
    """Chat columns for a variant frame, each variant with its own prompt."""
    free = [v.name for v in variants if not v.constrain]
    return with_chat(rows, ~F.col("variant").isin(free) if free else True)


def build_training_set(
    posts: DataFrame, extra: DataFrame | None = None, n: int | None = None,
    test_size: float = 0.1, seed: int = 42, constrain: bool = True, staged: bool = True,
) -> DataFrame:
    """``split, row_key, text, label, emoji, type, true_sentiment, target, messages``."""
    only = (Variant("only", constrain=constrain, n=n),)
    rows = dataset_variants(posts, extra, only, test_size, seed, staged).drop("variant")
    return with_chat(rows, constrain)


def encode_training_set(
    rows: DataFrame, max_length: int = V.MAX_TOKENS, max_features: int | None = None
) -> DataFrame:
    """The rendered chats of a training set as fixed-length id columns, with ``split``.

    The vocabulary is that of the training rows, whole unless ``max_features`` bounds it; chats are rendered once and staged.
    """
    rendered = stage(rows.select(
        F.struct("split", "row_key").alias("_row"), render_chat(F.col("messages")).alias("chat")
    ))
    train = rendered.where(F.col("_row.split") == "train")
    vocabulary = fit_vocabulary(train, "_row", "chat", max_features, n=1)
    encoded = encode_fixed(rendered, "_row", "chat", vocabulary, max_length)
    return encoded.select("_row.*", *[c for c in encoded.columns if c != "_row"])


def _as_stages(counts: DataFrame) -> DataFrame:
    """One row of counts as rows ``stage, n``."""
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in counts.columns
    ])))


def set_counts(rows: DataFrame) -> DataFrame:
    """``stage, n`` of a training set: posts sampled, their union with extras, both splits."""
    return _as_stages(rows.agg(
        F.count_if(F.startswith(F.col("row_key"), F.lit("post:"))).alias("sampled"),
        F.count(F.lit(1)).alias("union"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "val").alias("val"),
    ))


def stage_counts(posts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``stage, n``: rows read, kept by length, with a known label, and added."""
    kept, known = F.col("kept"), F.col("known")
    checked = posts.select(
        length_ok(clean_text(F.col("raw"))).alias("kept"),
        emoji_of(F.col("label")).isNotNull().alias("known"),
    )
    counts = checked.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(kept).alias("kept"),
        F.count_if(kept & known).alias("labelled"),
    )
    stages = _as_stages(counts)
    if extra is None:
        return stages
    return stages.union(extra.agg(F.count(F.lit(1)).alias("n")).select(F.lit("extra"), "n"))
