import math
import random
import re

import pytest
from pyspark.sql import functions as F

from check import connect, difference
from glyphloom.llm import queries, topk
from glyphloom.llm.topk import exact_top_k
from glyphloom.llm.urlfilter import RULES, judge_urls

ODD = [
    (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://NET/x"), (5, "http://a.example.NET/en/"),
    (6, "http://a.example.net/EN/"), (7, "http://net"), (8, "http://xnet/"), (9, "x://b.org/fr/1?u=http://net/"),
    (10, "http://é.example.com/de/ü#x"), (11, "http://example.com?/de/"), (12, "http://net:80/"),
    (13, "http://org/fr/\n5"), (14, "http://q.org/fr"), (14, "http://q.org/fr"), (None, "http://h/1"),
    (15, "http://h/" + "a/" * 30_000),
]


def by_rules(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(t), t, says) for says, t in RULES
           if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0]))
           and path.startswith(t[t.index("/"):])]
    _, rule, says = max(fit, default=(0, None, None))
    return host, path, rule, says


def test_rules_on_odd_addresses(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("v", F.lit(1))
    got = judge_urls(pages).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "") for r in got) == sorted(
        (k or 0, *by_rules(u)[:2], by_rules(u)[2] or "") for k, u in ODD)
    for r in got:
        says = next(by_rules(u)[3] for k, u in ODD if k == r.page_id)
        assert r.verdict == (says or "allow")


def test_templates_that_stand_out_are_rejected(spark):
    rules = (("block", "bad.org/ads/1"),)
    rows = [(i, f"http://bad.org/ads/1{i}") for i in range(90)] + [(100 + i, f"http://bad.org/ads/2{i}") for i in range(9)]
    rows += [(200 + i, f"http://bad.org/news/{i}.html") for i in range(200)]
    got = {r.page_id: r.verdict for r in judge_urls(
        spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all(got[k] == ("allow" if k >= 200 else "block") for k, _ in rows)


def test_a_variable_segment_in_the_middle_keeps_what_follows_apart(spark):
    rules = tuple(("block", f"bad.org/shop/s{chr(97 + i // 26)}{chr(97 + i % 26)}/offers") for i in range(200))
    slugs = [f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, f"http://bad.org/shop/{s}/offers") for i, s in enumerate(slugs)]
    rows += [(1000 + i, f"http://bad.org/shop/{s}/reviews") for i, s in enumerate(slugs)]
    rows += [(2000 + i, f"http://bad.org/shop/{s}/reviews/a/b") for i, s in enumerate(slugs[:50])]
    got = {r.page_id: r.verdict for r in judge_urls(
        spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert len(got) == len(rows) and all(v == ("block" if k < 1000 else "allow") for k, v in got.items())


def test_a_branch_cleaner_than_its_parent_stands_apart(spark):
    rules = tuple(("block", f"bad.org/{c}/1") for c in "abcdef")
    rows = [(10 * i + j, f"http://bad.org/{c}/{1 + (j > 6)}") for i, c in enumerate("abcdef") for j in range(10)]
    rows += [(1000 + i, "http://bad.org/clean/2") for i in range(9)]
    got = {r.page_id: r.verdict for r in judge_urls(
        spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all(v == ("allow" if k >= 1000 else "block") for k, v in got.items())


def test_empty_tables(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(none, F.col("vec_id") % 2 == 0).collect() == []


@pytest.mark.parametrize("name", ["op3_url_filter", "op10_exact_topk"])
def test_against_sql(spark, sf_dir, name):
    ours = queries.QUERIES[name](spark, sf_dir).toArrow()
    assert ours.num_rows and difference(ours, connect(sf_dir).sql(queries.ORACLE[name]).to_arrow_table()) is None


def brute(rows, k, ask):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if ask(i):
            hits = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits[:k])]
    return sorted(out)


def test_ties_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, -0.3, 0.0, 0.5, 7.25]) for _ in range(20)]) for i in range(120)]
    rows += [(200 + i, [1e6] * 20) for i in range(30)] + [(300 + i, [float(i)] * 3) for i in range(4)]
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 20), (404, [float("inf")] * 20), (None, [1.0] * 20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("id", F.lit(1))
    got = exact_top_k(frame, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda i: i % 5 == 0)
