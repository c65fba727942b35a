import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlogs.llm import word_runs
from sessionlogs.llm.queries import op12_word_runs
from tests.llm.helpers import awkward, documents


def brute_runs(words, least=24, times=3):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_lyndon_array(s):
    want = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        want.append(j - i)
    assert word_runs.lyndon_array(np.array(s)).tolist() == want


def test_runs_of_small_alphabets():
    rng = random.Random(2)
    for _ in range(300):
        s = []
        while len(s) < 60:
            s += [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 7))] * rng.choice([1, 2, 3, 5, 9])
            s += [9] * rng.randint(0, 1)
        ids = np.unique(np.array(s), return_inverse=True)[1]
        for least in (3, 8, 24):
            assert word_runs.find_runs(ids, least) == brute_runs(s, least)


def test_long_runs_take_linear_time():
    ids = np.tile(np.arange(500), 400)
    assert word_runs.find_runs(ids) == [(0, 200_000, 500)]
    assert word_runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def expected(doc_id, text):
    """The contract, read literally."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    short = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(short).hexdigest()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["a", "b", "ü", "d!"], k=rng.randint(0, 90)))) for k in range(150)]
    rows += [(1000 + k, f"start {' '.join(rng.choices('abc', k=rng.randint(1, 5)) * rng.randint(5, 30))}\n\tend") for k in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "x " * 300), (None, "y " * 40), (7, "same id")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_word_runs(spark, str(tmp_path)).collect()
    got = sorted((tuple(r) for r in out), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=repr)
    assert sum(r.n_runs > 0 for r in out) > 40  # not vacuous


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(0))
    out = {(r.doc_id, r.text): r for r in word_runs.add_runs(df).collect()}
    assert out[(1, None)].collapsed == "" and out[(2, "")].runs == [] and out[(5, " \n\t ")].collapsed == ""
    assert out[(6, "é ü 漢字 \U0001f600 x")].collapsed == "é ü 漢字 \U0001f600 x"
    assert [tuple(r) for r in next(v for k, v in out.items() if k[0] == 3).runs] == [(0, 50_000, 1)]
    assert word_runs.add_runs(df).count() == 8 and word_runs.add_runs(df.limit(0)).count() == 0
