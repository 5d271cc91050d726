import json

import pytest

from glyphloom.plans.training_set import labelled_posts
from glyphloom.sources import files


def _write(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def _rows(frame):
    return [tuple(r) for r in frame.orderBy("post_id").collect()]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {n} " + "y" * (n % 50) for n in range(5000)]
    path = _write(tmp_path, "text", "\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = files.numbered_lines(spark, path)
        assert {r.line_no: r.value for r in got.collect()} == dict(enumerate(lines))
        blocks = spark.read.text(path).select("_metadata.file_block_start").distinct().count()
        assert blocks > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_aligned_lines(spark, tmp_path):
    texts = _write(tmp_path, "a.text", "\n\nfirst\n\nthird 🇺🇸\r\nfourth\n\n")
    labels = _write(tmp_path, "a.labels", "3\n 5 \n20\n7\n")
    assert _rows(files.aligned_lines(spark, texts, labels)) == [
        (0, "first", 3), (1, "", 5), (2, "third 🇺🇸", 20), (3, "fourth", 7)]


def test_unequal_files(spark, tmp_path):
    texts = _write(tmp_path, "a.text", "one\ntwo")
    labels = _write(tmp_path, "a.labels", "1\n2\n3")
    with pytest.raises(Exception, match="no partner for line 2"):
        files.aligned_lines(spark, texts, labels).collect()
    kept = files.aligned_lines(spark, texts, labels, on_mismatch="keep")
    assert _rows(kept) == [(0, "one", 1), (1, "two", 2), (2, None, 3)]


def test_bad_label(spark, tmp_path):
    texts = _write(tmp_path, "a.text", "one\ntwo")
    labels = _write(tmp_path, "a.labels", "1\nabc")
    with pytest.raises(Exception, match="not a label: abc"):
        files.aligned_lines(spark, texts, labels).collect()


def test_files_to_posts(spark, tmp_path):
    texts = _write(tmp_path, "a.text", "a long enough line @me\nshort\nanother fine line\n")
    labels = _write(tmp_path, "a.labels", "0\n1\n20\n")
    got = labelled_posts(files.aligned_lines(spark, texts, labels)).orderBy("row_key").collect()
    assert [(r.row_key, r.text, r.emoji) for r in got] == [
        ("post:0", "a long enough line @user", "❤️"), ("post:2", "another fine line", None)]


def test_samples_round_trip(spark, tmp_path):
    records = [{"text": "uno ❤️", "emoji": "❤️", "type": "irony", "true_sentiment": "mixed"},
               {"text": "dos", "emoji": "😂"}]
    path = _write(tmp_path, "s.json", json.dumps(records, ensure_ascii=False, indent=2))
    rows = files.read_samples(spark, path, lines=False)
    assert [(r.text, r.type) for r in rows.orderBy("seq").collect()] == [
        ("uno ❤️", "irony"), ("dos", None)]
    out = str(tmp_path / "out")
    files.write_samples(rows.drop("seq"), out)
    written = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "uno ❤️" in written and '"type":null' in written
    assert files.read_samples(spark, out, lines=True).count() == 2


def test_broken_samples_fail(spark, tmp_path):
    path = _write(tmp_path, "s.json", '[{"text": "a"')
    with pytest.raises(Exception):
        files.read_samples(spark, path).collect()
    with pytest.raises(Exception):
        files.read_samples(spark, path, lines=False).collect()


def test_written_samples_come_back_whole_with_the_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(f"text {i}", "x", None, None) for i in range(50)], files.SAMPLE_SCHEMA)
    out = str(tmp_path / "out")
    files.write_samples(rows.repartition(3), out)
    got = files.read_samples(spark, out).collect()
    assert len(got) == 50 and sorted(r.seq for r in got) == list(range(50))
    assert sorted(r.text for r in got) == sorted(f"text {i}" for i in range(50))


def test_the_other_kind_of_file_fails(spark, tmp_path):
    lines = _write(tmp_path, "l.json", '{"text": "a"}\n{"text": "b"}\n')
    with pytest.raises(Exception, match="not one JSON array"):
        files.read_samples(spark, lines, lines=False).collect()
    array = _write(tmp_path, "a.json", '[{"text": "a"}, {"text": "b"}]')
    with pytest.raises(Exception, match="JSON array where JSON Lines"):
        files.read_samples(spark, array).collect()


def test_array_numbers_follow_the_files(spark, tmp_path):
    (tmp_path / "arrays").mkdir()
    for i in range(3):
        (tmp_path / "arrays" / f"s{i}.json").write_text(json.dumps([{"text": f"t{i} {n}"} for n in range(5 + i)]))
    got = files.read_samples(spark, str(tmp_path / "arrays"), lines=False).collect()
    want = [f"t{i} {n}" for i in range(3) for n in range(5 + i)]
    assert sorted((r.seq, r.text) for r in got) == list(enumerate(want))


def test_missing_samples_are_optional(spark, tmp_path):
    with pytest.warns(UserWarning, match="going on without"):
        assert files.read_samples_if_present(spark, str(tmp_path / "none.json")) is None
    assert files.read_samples_if_present(spark, None) is None


def test_report_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("a b", 0.5, None)],
                                  "model string, accuracy double, json_rate double")
    path = str(tmp_path / "report")
    files.write_report(table, path)
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1
    assert [tuple(r) for r in files.read_report(spark, path).collect()] == [("a b", 0.5, None)]


def test_folders_pair_line_by_line(spark, tmp_path):
    """Files of different lengths on both sides, trimmed each, numbered across all."""
    for folder, contents in (("texts", ["\na\nb\nc\n\n", "dd\n\nee\n"]), ("labels", ["1\n2\n", "\n3\n4\n5\n6\n"])):
        (tmp_path / folder).mkdir()
        for i, content in enumerate(contents):
            (tmp_path / folder / f"part-{i}.txt").write_text(content)
    got = files.aligned_lines(spark, str(tmp_path / "texts"), str(tmp_path / "labels")).orderBy("post_id").collect()
    assert [(r.post_id, r.raw, r.label) for r in got] == [
        (0, "a", 1), (1, "b", 2), (2, "c", 3), (3, "dd", 4), (4, "", 5), (5, "ee", 6)]


def test_sample_numbers_do_not_depend_on_the_tasks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.json").write_text("".join(
            f'{{"text": "t{i} {n}", "emoji": "x"}}\n' for n in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append({(r.seq, r.text) for r in files.read_samples(spark, str(tmp_path), lines=True).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == {(200 * i + n, f"t{i} {n}") for i in range(3) for n in range(200)}


@pytest.mark.parametrize("name", ["aligned_files", "samples_from_files"])
def test_written_files_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch, name):
    from catalog import queries

    rows = [(i, "\n".join(f"line {i} {n} " + "x" * 80 for n in range(20)), "en", "s", 1) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    made = []
    real = queries._in_order
    monkeypatch.setattr(queries, "_in_order", lambda rows, n, *order: made.append(n) or real(rows, n, *order))
    before = sorted(queries.QUERIES[name](spark, str(tmp_path)).collect())
    few, made[:] = list(made), []
    assert max(few) <= 7
    monkeypatch.setattr(queries, "FILE_BYTES", 20_000)
    assert sorted(queries.QUERIES[name](spark, str(tmp_path)).collect()) == before
    assert min(made) >= 18 and len(before) == 4000
