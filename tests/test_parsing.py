import pytest
from pyspark.sql import functions as F

from glyphloom.functions import parsing
from glyphloom.sources import answers

# raw -> success, primary, alternative, irony
CASES = [
    ('{"primary": "😂", "alternative": "💕", "irony": true}', (True, "😂", "💕", True)),
    ('```json\n{"primary": "😂", "irony": false}\n```', (True, "😂", None, False)),
    ('```{"primary": "😂"}```', (True, "😂", None, False)),
    ('<think>{"x"\n</think>{"primary": " 😂\\n", "irony": "false"}', (True, "😂", None, True)),
    ('<think>a</think>b<think>💕</think> 😂', (False, "😂", None, False)),
    ('<think>open 😂 {"primary": "💕"}', (True, "💕", None, False)),
    ('{"primary": "😂"', (False, "😂", None, False)),
    ("😂 then 💕 then 🔥", (False, "😂", "💕", False)),
    ("no answer", (False, "❓", None, False)),
    ("", (False, "❓", None, False)),
    (None, (False, "❓", None, False)),
    # the scan's second emoji replaces a valid alternative, its absence does not
    ('{"primary": "happy", "alternative": "💕", "reason": "🔥💕"}', (True, "💕", "🔥", False)),
    ('{"primary": "happy", "alternative": "💕"}', (True, "💕", "💕", False)),
    # a missing alternative alone starts no scan
    ('{"primary": "😂", "reason": "🔥🔥"}', (True, "😂", None, False)),
    ('{"primary": "😂", "alternative": "😭"}', (True, "😂", None, False)),
    ('{"primary": 5, "irony": null}', (True, "❓", None, False)),
    ('{"primary": ["😂"]}', (True, "😂", None, False)),
    ('{"primary": "😂"} or {"primary": "💕"}', (False, "😂", "💕", False)),
    ('{"a": 1}, {"b": 2}', (False, "❓", None, False)),
    ('{"a": 1} x }', (False, "❓", None, False)),
    ('{"primary": "💕", "primary": "😂"}', (True, "😂", None, False)),
    ('{"a": 1,}', (False, "❓", None, False)),
    ('{"a": NaN}', (False, "❓", None, False)),
    ("{'a': 1}", (False, "❓", None, False)),
    ('{"a": "x\ny"}', (False, "❓", None, False)),
    ("{}", (True, "❓", None, False)),
    ("I feel 🇺🇸❤️ today ❤", (False, "🇺🇸", "❤️", False)),
]
IRONY = {
    "true": True, "false": False, "0": False, "0.0": False, "-0": False, "1": True, "0.5": True,
    "null": False, '""': False, '"0"': True, '"false"': True, '" "': True, "[]": False,
    "[0]": True, "{}": False, '{"a": 0}': True, "1e3": True,
}


def _parse(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, raw string")
    return parsing.parse_outputs(rows).orderBy("i").collect()


def test_parse_cases(spark):
    for (raw, expected), r in zip(CASES, _parse(spark, [c for c, _ in CASES])):
        assert (r.parse_success, r.primary, r.alternative, r.irony) == expected, raw


def test_irony_is_truthiness(spark):
    raws = [f'{{"primary": "😂", "irony": {v}}}' for v in IRONY]
    got = [r.irony for r in _parse(spark, raws)]
    assert dict(zip(IRONY, got)) == IRONY


def test_text_fields(spark):
    raws = ['{"tone": "a", "reason": null}', '{"reason": 3}', "x"]
    got = [(r.tone, r.reason) for r in _parse(spark, raws)]
    assert got == [("a", None), ("", "3"), ("", "")]


def test_long_answer(spark):
    raw = '{"primary": "😂", "reason": "' + "x" * 400_000 + '"}'
    (r,) = _parse(spark, [raw])
    assert r.parse_success and len(r.reason) == 400_000


def test_scan_takes_the_longest(spark):
    rows = spark.createDataFrame([("a❤️b🇺🇸😂😂",)], "t string")
    got = rows.select(parsing.scan_emoji(F.col("t")).alias("x")).first().x
    assert got == ["❤️", "🇺🇸", "😂", "😂"]


@pytest.mark.parametrize("answer, texts", [
    ('[{"text": "a", "emoji": "x"}, {"text": 5}]', ["a", None]),
    ('```json\n[{"text": "a"}]\n```', ["a"]),
    ("[]", []),
    ('{"text": "a"}', None),
    ('[{"text": "a"}] done', None),
    ('[{"text": "a"}], []', None),
    ('[{"text": "a"', None),
    ("", None),
    (None, None),
])
def test_answers(spark, answer, texts):
    rows = spark.createDataFrame([(1, answer)], "batch_id long, answer string")
    parsed = answers.parse_answers(rows)
    assert parsed.first().accepted == (texts is not None)
    got = answers.answer_samples(parsed).orderBy("pos").collect()
    assert [r.text for r in got] == (texts or [])
    counts = answers.answer_counts(parsed).first()
    assert (counts.answers, counts.rejected, counts.samples) == (
        1, int(texts is None), len(texts or []))
