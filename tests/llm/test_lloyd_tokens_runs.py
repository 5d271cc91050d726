import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import lloyd, runs, tokenfile
from glyphloom.llm.queries import op11_centroid_clustering, op12_token_binary, op13_periodic_runs

# --- op11: dimension-sharded Lloyd -------------------------------------------------


def plain_lloyd(rows, k=16, rounds=3, width=64, scale=64):
    """Lloyd on whole vectors in Python, the contract's rules spelled out."""
    kept = [(v, [int(np.floor(scale * float(x))) for x in e]) for v, e in rows
            if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(e) for _, e in order[:k]]

    def assign():
        out = []
        for v, e in kept:
            d = [sum((a - b) ** 2 for a, b in zip(e, c)) for c in cents]
            out.append((v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            members = [kept[i][1] for i, (_, cl, _) in enumerate(got) if cl == c]
            if members:
                cents[c] = [sum(col) // len(members) for col in zip(*members)]
    got = assign()
    total = sum(d for _, _, d in got)
    per = {c: sum(d for _, cl, d in got if cl == c) for c in range(len(cents))}
    return [(v, c, d, per[c], total, lloyd.centroid_digest(cents[c])) for v, c, d in got]


def test_lloyd_equals_plain_rounds_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    rows += [(7, rows[7][1]), (61, None), (62, [0.5] * 63), (63, [float("nan")] + [0.1] * 63),
             (64, [None] + [0.1] * 63), (65, [0.0] * 64), (66, [0.0] * 64), (None, [0.25] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in lloyd.lloyd(frame.withColumn("cluster", frame.vec_id)).vectors.collect()), key=key)
    assert got == sorted(plain_lloyd(rows), key=key)
    assert len(got) == 60 + 1 + 2 + 1


def test_lloyd_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(1, [0.1] * 64), (2, [0.9] * 64)]
    got = lloyd.lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert len(got.centroids) == 2 and sorted(r.distance for r in got.vectors.collect()) == [0, 0]
    empty = lloyd.lloyd(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.vectors.count() == 0


def test_lloyd_fails_loudly_on_huge_components(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component above"):
        lloyd.lloyd(frame).vectors.collect()


def test_op11_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.sql(lloyd.ORACLE).fetchall())
    assert sorted(tuple(r) for r in op11_centroid_clustering(spark, sf_dir).collect()) == want


# --- op12: rANS token files ----------------------------------------------------------


def test_rans_block_round_trip_with_skewed_symbols():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.3, 5_000) % 40_000, [7] * 3_000, [49_407]]).astype(np.int64)
    symbols, freq, cum = tokenfile.frequency_table(dict(zip(*np.unique(ids, return_counts=True))))
    assert freq.sum() == 1 << tokenfile.SCALE and freq.min() >= 1
    states, lengths, words = tokenfile.encode_block(ids, symbols, freq, cum)
    slot = np.repeat(np.arange(len(symbols)), freq)
    assert np.array_equal(tokenfile.decode_block(len(ids), states, lengths, words, symbols, freq, cum, slot), ids)
    assert len(words) < 2 * len(ids)
    broken = bytearray(words)
    broken[5] ^= 1
    with pytest.raises(ValueError):
        out = tokenfile.decode_block(len(ids), states, lengths, bytes(broken), symbols, freq, cum, slot)
        assert np.array_equal(out, ids)


def test_token_files_round_trip_with_odd_rows(spark):
    from tokenizers import Tokenizer

    rows = [(3, "Hello world, hello again."), (1, None), (2, ""), (3, "another text of key 3"),
            (None, "null key text"), (5, "# hash signs ## are id 2 " * 50), (4, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    folder = tokenfile.write_token_files(docs, block=1_000)
    got = tokenfile.read_token_files(spark, folder, keep_ids=True).collect()
    tok = Tokenizer.from_file(tokenfile.default_vocabulary())
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    at, want = 0, []
    for d, t in ordered:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    # the two rows of key 3 are told apart by their texts, whatever their order
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=key)
    assert [g[2:] for g in got if g[0] != 3] == [w[2:] for w in want if w[0] != 3]
    assert sorted(g[3] for g in got if g[0] == 3) == sorted(w[3] for w in want if w[0] == 3)
    assert [g[1] for g in got] == [w[1] for w in sorted(want, key=key)] or sorted(g[1] for g in got) == \
        sorted(w[1] for w in want)


def test_token_files_of_an_empty_table(spark):
    folder = tokenfile.write_token_files(spark.createDataFrame([], "doc_id long, text string"))
    assert tokenfile.read_token_files(spark, folder).count() == 0


def test_op12_query_equals_direct_encoding(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfile.default_vocabulary())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    at, want = 0, {}
    for d, t in sorted(zip(docs.doc_id, docs.text)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op12_token_binary(spark, sf_dir).collect()}
    assert got == want


# --- op13: periodic runs ---------------------------------------------------------------


def brute_runs(w, least=12):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, length = i, j - i + q
            smallest = not any(all(w[s + t] == w[s + t + r] for t in range(length - r)) for r in range(1, q))
            if smallest and length >= max(least, 2 * q):
                out.add((s, length, q))
            i = j + 1
    return sorted(out)


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(0, 90)
        w = [rng.randint(0, rng.randint(1, 3)) for _ in range(n)]
        if n > 10 and rng.random() < 0.4:
            p, s = rng.randint(1, 7), rng.randint(0, n - 1)
            w = w[:s] + [w[s + (i - s) % p] for i in range(s, n)]
        least = rng.choice([2, 12])
        assert runs.find_runs(np.array(w, np.int64), least) == brute_runs(w, least)


def brute_row(doc_id, text):
    words = runs.planted(doc_id, runs.words_of(text))
    ids = {w: i for i, w in enumerate(sorted(set(words)))}
    found = sorted(brute_runs([ids[w] for w in words]), key=lambda r: (r[0], r[2]))
    drop = set()
    for s, length, p in found:
        drop.update(range(s + p, s + length))
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *head, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_rows_with_odd_texts(spark):
    planted_id = next(i for i in range(1, 10_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    body = " ".join(f"w{i % 37}" for i in range(300))
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "a b " * 20 + "c"), (planted_id, body), (planted_id, body),
            (None, "x y " * 10), (5, "é\x0bé\x0cé " * 8), (6, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit(1))
    got = sorted(runs.periodic_runs(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted((brute_row(d, t) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r) for r in got] == want
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0].n_runs == 0 and got[0].start is None and got[0].runs_sha256 == empty == got[0].collapsed_sha256
    assert next(r for r in got if r.doc_id == planted_id).n_runs >= 1


def test_op13_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_row(r.doc_id, r.text) for r in docs if len(runs.words_of(r.text)) < 400)
    small = {w[0] for w in want}
    got = sorted(tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect() if r.doc_id in small)
    assert got == want and len(got) > 0
