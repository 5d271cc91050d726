import json

from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions import chat, labels, text


def _apply(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


CLEAN = {
    "  a b ": "a b", "@user hi": "@user hi", "a@b.com": "a@user.com", "@ place": "@ place",
    "# x": "# x", "##x": "#x", "#a#b": "ab", "xhttp://y z": "x z", "HTTP://y": "HTTP://y",
    "\u001cx  y　": "x y", "": "", "go www.ex.org/x now": "go now",
    "@josé_9 #été2": "@user été2", "a\t\n b": "a b", "wwwx.y": "wwwx.y", "​x": "​x",
}


def test_clean_text(spark):
    assert _apply(spark, text.clean_text, CLEAN) == list(CLEAN.values())


def test_cleaning_twice_can_unwrap_again(spark):
    once = _apply(spark, text.clean_text, ["##x y"])
    assert _apply(spark, text.clean_text, once) == ["x y"]
    stable = [v for v in CLEAN.values() if "#" not in v]
    assert _apply(spark, text.clean_text, stable) == stable


def test_strip_keeps_inner_space(spark):
    assert _apply(spark, text.strip, [" a \n b\x85", " \t"]) == ["a \n b", ""]


def test_length_bounds_count_code_points(spark):
    values = ["x" * 9, "x" * 10, "x" * 280, "x" * 281, "x" * 8 + "🇺🇸", "x" * 279 + "😂"]
    expected = [False, True, True, False, True, True]
    assert _apply(spark, text.length_ok, values) == expected
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    kept = text.where_length_ok(rows, "text", F.col("t")).collect()
    assert sorted(r.i for r in kept) == [1, 2, 4, 5]


def test_irony_rule_is_about_substrings(spark):
    values = ["Great, LATE again", "I love chocolate", "my glove is lost", "great day", "so late",
              "Just What I Needed on a Monday", ""]
    assert _apply(spark, text.irony_rule, values) == [True, True, True, False, False, True, False]


def test_tokens_and_ngrams(spark):
    values = ["A bc, d_e É2 ф", "one", "", "x y"]
    assert _apply(spark, text.tokens, values) == [["bc", "d_e", "é2"], ["one"], [], []]
    grams = _apply(spark, lambda t: text.ngrams(text.tokens(t)), values)
    assert grams == [["bc", "d_e", "é2", "bc d_e", "d_e é2"], ["one"], [], []]


def test_labels_round_trip(spark):
    rows = spark.createDataFrame([(n,) for n in range(-1, 22)], "n int")
    found = rows.select("n", labels.emoji_of(F.col("n")).alias("e")).select(
        "n", "e", labels.label_of(F.col("e")).alias("back"),
        labels.polarity_of(F.col("e")).alias("p"), labels.alternative_of(F.col("e")).alias("a"),
    ).collect()
    for r in found:
        assert r.e == V.EMOJI_BY_LABEL.get(r.n)
        assert r.back == (r.n if 0 <= r.n < 20 else -1)
        assert r.a == V.ALTERNATIVE.get(r.e, "😊")
        assert (r.p == "positive") == (r.e in V.POSITIVE_EMOJI)
    assert len(V.POSITIVE_EMOJI) == 16 and len(V.ALTERNATIVE) == 20


def test_bare_heart_is_not_listed(spark):
    assert _apply(spark, labels.is_listed, ["❤", "❤️", "☀", None]) == [False, True, False, False]


def test_similarity_is_symmetric(spark):
    rows = labels.similarity_dimension(spark).collect()
    table = {(r.pred, r.truth): r.hundredths for r in rows}
    assert len(rows) == len(table) == 36
    assert all(table[b, a] == s for (a, b), s in table.items())


def test_training_target_text(spark):
    rows = spark.createDataFrame(
        [("Great, late", "😍"), ("plain words", "📷"), ("x", 'q"\\'), ("x", None)],
        "t string, e string")
    got = [r.x for r in rows.select(
        chat.training_target(F.col("e"), F.col("t")).alias("x")).collect()]
    assert got[0] == (
        '{"tone": "Ironic or sarcastic emotional tone", "irony": true, "primary": "😍", '
        '"alternative": "😊", "reason": "The text conveys a positive sentiment, '
        'best matched by 😍."}')
    assert '"tone": "Neutral_or_negative emotional tone", "irony": false' in got[1]
    assert '"primary": "q\\"\\\\", "alternative": "😊"' in got[2]
    assert got[3] is None
    parts = rows.select(chat.target_struct(F.col("e"), F.col("t")).alias("s")).collect()
    for text, r in list(zip(got, parts))[:3]:
        assert json.loads(text) == r.s.asDict()


def test_chat_messages(spark):
    rows = spark.createDataFrame([("hi", "{}"), ("ho", None)], "t string, target string")
    free = chat.chat_messages(F.col("t"), F.col("target"), constrain=False)
    with_list = chat.chat_messages(F.col("t"))
    got = rows.select(free.alias("m"), with_list.alias("n"),
                      chat.render_chat(with_list, True).alias("s")).collect()
    assert [[m.role for m in r.m] for r in got] == [
        ["system", "user", "assistant"], ["system", "user"]]
    assert got[0].m[1].content == "Text: hi\nAnalyze and predict:"
    assert all(e in got[0].n[0].content for e in V.EMOJI) and "😂" not in got[0].m[0].content
    assert got[0].s.endswith("[[user]]\nText: hi\nAnalyze and predict:\n[[assistant]]\n")


def test_conversations_render_whole_in_bounded_pieces(spark):
    """A conversation of 100,000 turns, spread over tasks, in pieces that follow the turns."""
    from glyphloom.operators.conversations import render_conversations

    many = spark.range(100_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                       F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.lit("m"), F.col("id").cast("string")).alias("text"))
    odd = spark.createDataFrame(
        [(None, 1, "user", "a"), (None, None, "user", "b"), (1, 2, None, "x"), (1, 1, "user", "y"),
         (1, 1, "user", "y"), (2, 0, "system", "z" * 50)], "conv_id long, turn long, role string, text string")
    rows = many.unionByName(odd).repartition(13)
    got = render_conversations(rows, piece_chars=1_000).collect()
    pieces = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.piece)
    whole = "".join(r.chat for r in pieces)
    want = "".join(f"[[{'user' if i % 2 == 0 else 'assistant'}]]\nm{i}\n" for i in range(100_000))
    assert whole == want and sum(r.n_turns for r in pieces) == 100_000
    assert [r.piece for r in pieces] == list(range(len(pieces)))
    assert max(len(r.chat) for r in pieces) <= 1_000 + 30
    small = {(r.conv_id, r.piece): (r.first_turn, r.n_turns, r.chat) for r in got if r.conv_id != 7}
    assert small == {(None, 0): (1, 2, "[[user]]\nb\n[[user]]\na\n"),
                     (1, 0): (1, 3, "[[user]]\ny\n[[user]]\ny\n"),
                     (2, 0): (0, 1, "[[system]]\n" + "z" * 50 + "\n")}
