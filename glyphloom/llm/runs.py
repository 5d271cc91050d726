"""Periodic runs of words: Lyndon arrays under both orders, roots extended into runs.

Every run (a maximal stretch with smallest period ``q`` and length at least
``2q``) has a Lyndon root of length ``q`` under one of the two orders of the
alphabet, the one by which the word after the run is smaller.  So for each
order the Lyndon array ``lam`` (length of the longest Lyndon word starting at
each position) gives the candidates ``(i, lam[i])``; a candidate is extended
backwards and forwards by longest common extensions and kept if it covers two
periods.  A candidate whose run reaches a whole period to its left is skipped:
the root one period earlier finds the same run.

The Lyndon array of an order is read from the suffix order under it: the
longest Lyndon prefix of the suffix at ``i`` ends where the next smaller suffix
starts.  Suffix ranks come from prefix doubling on integer word ids (numpy sorts
in the task), next smaller values from pointer jumping.  Documents are spread
over Spark tasks as Arrow batches; one document is the unit of work, so memory
follows the longest document.

Cases: a null or empty text has no words and no runs; its hashes are those of
empty strings.  A null ``doc_id`` is never rewritten (below).  Repeated rows
each return a row.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: fixed by the query's contract: shortest run, and the rule that plants periodic tails
LEAST_RUN = 12

OUT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
       "runs_sha256 string, collapsed_sha256 string")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks (space, tab, LF, VT, FF, CR) of the UTF-8 text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rewrite: with h = crc32(decimal doc_id), h % 10 == 0 makes a periodic tail."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_ranks(ids: np.ndarray) -> np.ndarray:
    """Rank of each suffix (0 = smallest), a proper prefix before its extensions."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    k = 1
    while n and rank.max() < n - 1:
        nxt = np.full(n, -1, np.int64)
        nxt[:n - k] = rank[k:] if k < n else nxt[:0]
        key = rank * (n + 1) + (nxt + 1)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def lyndon_array(ids: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word starting at each position."""
    n = len(ids)
    rank = np.append(suffix_ranks(ids), -1)
    nxt = np.minimum(np.arange(1, n + 2), n)
    at = np.arange(n + 1)
    while True:
        larger = rank[nxt] > rank[at]
        if not larger.any():
            break
        nxt = np.where(larger, nxt[nxt], nxt)
    return (nxt - at)[:n]


def find_runs(ids: np.ndarray, least: int = LEAST_RUN) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of length at least ``max(least, 2 * period)``."""
    n = len(ids)
    found: set[tuple[int, int, int]] = set()
    if n < 2:
        return []
    w = ids.tolist()
    for order in (ids, ids.max() - ids):
        lam = lyndon_array(order)
        at = np.arange(n)
        ahead = at + lam < n
        hit = np.zeros(n, bool)
        hit[ahead] = ids[at[ahead]] == ids[(at + lam)[ahead]]
        back = at >= 1
        hit[back] |= ids[at[back] - 1] == ids[(at + lam)[back] - 1]
        for i in np.flatnonzero(hit).tolist():
            p = int(lam[i])
            left = 0
            while left < p and i - left - 1 >= 0 and w[i - left - 1] == w[i - left - 1 + p]:
                left += 1
            if left >= p:
                continue
            right = 0
            while i + p + right < n and w[i + right] == w[i + p + right]:
                right += 1
            if left + right >= p:
                found.add((i - left, left + right + p, p))
    return sorted((s, length, p) for s, length, p in found if length >= max(least, 2 * p))


def describe(doc_id: int | None, text: str | None, least: int = LEAST_RUN) -> tuple:
    """The query's row for one document."""
    words = planted(doc_id, words_of(text))
    n = len(words)
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1].astype(np.int64) if n else \
        np.zeros(0, np.int64)
    runs = sorted(find_runs(ids, least), key=lambda r: (r[0], r[2]))
    dropped = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        dropped[s + p] += 1
        dropped[s + length] -= 1
    keep = np.cumsum(dropped)[:n] == 0
    collapsed = b" ".join(w for w, k in zip(words, keep.tolist()) if k)
    listing = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return (doc_id, len(runs), *head, hashlib.sha256(listing.encode()).hexdigest(),
            hashlib.sha256(collapsed).hexdigest())


def _describe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch in batches:
        ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
        texts = [None if not isinstance(x, str) else x for x in batch["text"]]
        rows = [describe(d, t) for d, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=names)
        for c in names[:6]:
            out[c] = out[c].astype("Int64")
        yield out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: ``OUT``. Work is spread by document across the input's tasks."""
    return docs.select("doc_id", "text").mapInPandas(_describe_batches, OUT)
