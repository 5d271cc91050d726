"""The query of operator 4 hands out the texts that are left, not their sizes alone."""

from hashlib import sha256

from glyphloom.llm import queries


def test_text_is_what_is_left(spark, tmp_path):
    passage = "".join(f"passage {k} " for k in range(60))
    rows = [(1, "begin é " + passage + "end"), (2, passage), (3, "alone"), (4, None), (5, "é" * 300), (6, "xé" + "é" * 260)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) >= 400
    assert {k: r.text for k, r in got.items()} == {1: "begin é end", 2: "", 3: "alone", 4: "", 5: "", 6: "x"}
    for k, text in rows:
        assert got[k].n_bytes == len((text or "").encode())
        assert got[k].kept_sha256 == sha256(got[k].text.encode()).hexdigest()
