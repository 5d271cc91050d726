"""Hand-written starting samples, in two languages and of every type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Our own sentences.  Some carry emoji off the label set on purpose: such
# samples are kept here and dropped by the quality filter.
SEEDS = (
    ("The train left one minute before I reached the platform", "😂", "irony", "negative"),
    ("Rain on the only free day of the whole month", "☀️", "irony", "negative"),
    ("My phone died right when the map mattered", "✨", "irony", "negative"),
    ("Burned the cake ten minutes before the guests came", "🔥", "irony", "negative"),
    ("The gym was closed the day I finally went", "💯", "irony", "mixed"),
    ("排队两个小时结果卖完了真是幸运", "😍", "irony", "negative"),
    ("Wonderful, the lift is out of order on moving day", "🙄", "sarcasm", "negative"),
    ("What a treat, a second meeting about the first meeting", "🙄", "sarcasm", "negative"),
    ("I truly enjoy waiting on hold for an hour", "❤️", "sarcasm", "negative"),
    ("So glad the neighbours practise drums at midnight", "💕", "sarcasm", "negative"),
    ("又要加班到半夜我可太喜欢了吧", "❤️", "sarcasm", "negative"),
    ("Love being asked to smile more before coffee", "😜", "sarcasm", "negative"),
    ("Set three alarms and slept through all of them", "😂", "dark_humor", "mixed"),
    ("The plant I promised to water is now compost", "😂", "dark_humor", "mixed"),
    ("My savings plan is finding coins in old coats", "😜", "dark_humor", "negative"),
    ("Studied the wrong chapter for two weeks straight", "😉", "dark_humor", "mixed"),
    ("That pun was so terrible I left the room", "💀", "slang", "positive"),
    ("He said he finished the book in one night", "🧢", "slang", "negative"),
    ("The ending of that show had me on the floor", "😭", "slang", "positive"),
    ("这个视频看得我笑到停不下来", "😭", "slang", "positive"),
    ("Not him wearing two different shoes to the interview", "💀", "slang", "positive"),
    ("This playlist goes harder than my whole week", "💀", "slang", "positive"),
    ("First morning in the flat without my flatmates", "😢", "bittersweet", "mixed"),
    ("We sold the old car that taught me to drive", "😊", "bittersweet", "mixed"),
    ("Last summer evening before everyone moves away", "☀️", "bittersweet", "mixed"),
    ("My little brother is taller than me now", "😁", "bittersweet", "mixed"),
)


def seed_samples(spark: SparkSession) -> DataFrame:
    """``seq, text, emoji, type, true_sentiment``."""
    rows = [(n, *seed) for n, seed in enumerate(SEEDS)]
    return spark.createDataFrame(
        rows, "seq long, text string, emoji string, type string, true_sentiment string"
    )
