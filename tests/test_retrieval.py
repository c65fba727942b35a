import random

import numpy as np
from pyspark.sql import functions as F

from sessionlogs import retrieval as r


def test_fixed_chunks(spark):
    texts = ["", "a", "x" * 1000, "é" * 1001, "".join(chr(97 + i % 26) for i in range(5000)), "y" * 1800, "z" * 1801]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in r.chunk_fixed(docs, "id", "text").orderBy("source", "chunk").collect():
        got.setdefault(row.source, []).append(row.content)
        assert row.total_chunks > row.chunk
    for i, t in enumerate(texts):
        want, start = [], 0
        while t and (start == 0 or start + 200 < len(t)):
            want.append(t[start : start + 1000])
            start += 800
        assert got.get(i, []) == want


def oracle_split(text, size, overlap, seps):
    """The documented recursive splitting, written as plainly as possible."""
    sep = next(s for s in seps if s in text)
    finer = seps[seps.index(sep) + 1 :]
    pieces = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out, run = [], []

    def flush():
        start = 0
        while start < len(run):
            end = start
            while end < len(run) and (end == start or len("".join(run[start : end + 1])) <= size):
                end += 1
            out.append("".join(run[start:end]).strip())
            if end == len(run):
                break
            new = start
            while new < end and (
                len("".join(run[new:end])) > overlap or len("".join(run[new:end])) + len(run[end]) > size
            ):
                new += 1
            start = new
        run.clear()

    for p in filter(None, pieces):
        if len(p) < size:
            run.append(p)
        else:
            flush()
            out.extend(oracle_split(p, size, overlap, finer) if finer else [p])
    flush()
    return [c for c in out if c]


def test_recursive_chunks_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "   ", "word", "a" * 50, "\n\n\n", "x\n\n\n\ny"]
    for _ in range(300):
        words = ["".join(rng.choices("ab", k=rng.randint(1, 25))) for _ in range(rng.randint(1, 40))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\n\n", "\n\n\n"]) for w in words))
    for t in texts:
        got = r.split_recursively(t, 20, 7)
        assert got == oracle_split(t, 20, 7, r.SEPARATORS), t
        assert all(len(c) <= 20 for c in got)
        assert sorted(set("".join(t.split()))) == sorted(set("".join("".join(got).split())))
    docs = spark.createDataFrame([(1, "para one\n\n" + "w " * 900), (2, ""), (3, None)], "id int, text string")
    rows = r.chunk_recursive(docs, "id", "text").collect()
    assert [x.content for x in rows] == r.split_recursively("para one\n\n" + "w " * 900)
    assert {(x.source, x.total_chunks) for x in rows} == {(1, len(rows))}


def test_topk_equals_brute_force_over_many_query_batches(spark, monkeypatch):
    for name, size in (("QUERY_BLOCK", 4), ("CHUNK_BLOCK", 25), ("QUERY_STEP", 2)):
        monkeypatch.setattr(r, name, size)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype("float32")
    x[10] = x[20] = x[30]  # ties
    x[40] = 0
    q = rng.normal(size=(10, 8)).astype("float32")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<float>")
    got = sorted((t.query_id, t.rank, t.vec_id) for t in r.topk_similar(chunks.repartition(7), queries, 4).collect())
    norm = np.linalg.norm(x.astype(float), axis=1)
    norm[40] = 1
    want = []
    for i, v in enumerate(q.astype(float)):
        scores = np.round(x.astype(float) @ v / norm / np.linalg.norm(v), 6)
        best = sorted(range(60), key=lambda j: (-scores[j], j))[:4]
        want += [(i, k + 1, j) for k, j in enumerate(best)]
    assert got == sorted(want)
    assert r.topk_similar(chunks, queries.where("1 = 0"), 4).count() == 0


def test_approximate_topk_finds_nine_of_ten(spark):
    """Vectors around many centres, as texts of some subjects are; queries near some of them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = np.repeat(centres, 40, axis=0) + 0.5 * rng.normal(size=(2400, 32))
    q = centres[rng.integers(0, 60, 80)] + 0.5 * rng.normal(size=(80, 32))
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [None] * 32), (9002, [0.0] * 32)], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<double>")
    exact = {(t.query_id, t.vec_id): t.score for t in r.topk_similar(chunks, queries, 10).collect()}
    near = {(t.query_id, t.vec_id): t.score for t in r.topk_approximate(chunks, queries, 10).collect()}
    common = exact.keys() & near.keys()
    assert len(exact) == 800 and len(common) >= 0.9 * len(exact)
    assert all(abs(exact[c] - near[c]) < 2e-6 for c in common)


def test_topk_reads_the_chunks_once(spark, tmp_path):
    spark.range(50).selectExpr("id as vec_id", "array(cast(id as double), 1.0) as embedding").write.parquet(str(tmp_path / "c"))
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id bigint, embedding array<double>")
    plan = r.topk_similar(spark.read.parquet(str(tmp_path / "c")), queries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [vec_id") == 1


def test_pages_join_in_order(spark):
    pages = spark.createDataFrame([(1, i, f"p{i}") for i in (3, 1, 2)] + [(2, 1, "only")], "d int, n int, t string")
    got = {(x.d, x.segment_no): x.text for x in r.page_texts(pages, "d", "n", "t").collect()}
    assert got == {(1, 0): "p1\np2\np3\n", (2, 0): "only\n"}
    got = {(x.d, x.segment_no): x.text for x in r.page_texts(pages, "d", "n", "t", size=2).collect()}
    assert got == {(1, 0): "p1\np2\n", (1, 1): "p3\n", (2, 0): "only\n"}


def test_replace_changes_only_the_given_sessions(spark, tmp_path):
    path = str(tmp_path / "docs")
    make = lambda rows: spark.createDataFrame(rows, "session_id string, content string")
    r.replace_session_docs(make([("a", "1"), ("b", "2")]), path)
    r.replace_session_docs(make([("a", "3")]), path)
    r.replace_session_docs(make([]), path)
    assert {tuple(x) for x in spark.read.parquet(path).select("session_id", "content").collect()} == {("a", "3"), ("b", "2")}


def test_text_search_finds_the_right_document(spark):
    docs = spark.createDataFrame(
        [(1, "database connection pool exhausted"), (2, "gateway timeout upstream"), (3, "user manual for payments")],
        "vec_id bigint, content string",
    )
    model = r.text_model(docs, size=4096)
    queries = r.text_to_vector(model, spark.createDataFrame([(9, "Gateway TIMEOUT")], "query_id bigint, content string"))
    top = r.topk_similar(r.text_to_vector(model, docs), queries, 1)
    assert [(t.query_id, t.vec_id) for t in top.collect()] == [(9, 2)]
    context = r.relevant_context(top, docs).collect()
    assert [tuple(c) for c in context] == [(9, "gateway timeout upstream")]


def test_documentation_context_has_all_sections(spark):
    texts = r.section_queries(spark.createDataFrame([("error pattern timeout",)], "query string"))
    assert {(x.section, x.n) for x in texts.groupBy("section").agg(F.count("*").alias("n")).collect()} == {
        ("error_patterns", 1), ("recommendations", 3), ("best_practices", 3)
    }


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, None]), (5, [0.5, 0.5]), (6, [])]
    chunks = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id bigint, embedding array<double>")
    got = [(x.query_id, x.rank, x.vec_id) for x in r.topk_similar(chunks, queries).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 5)]
    assert {x.vec_id for x in r.unusable_vectors(chunks, 2).collect()} == {2, 3, 4, 6}


def test_recursive_chunks_hold_a_slice_of_a_batch_at_once(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(r, "SLICE_CHARS", 2500)
    texts = ["w " * 600, None, "", "x\n\n" * 400, "é" * 3000, "a b"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["source", "_text"])
    out = list(r._chunk_slices([batch]))
    assert len(out) > 1
    sizes = [sum(len(t or "") for t in texts[i : i + b.num_rows]) for i, b in zip(np.cumsum([0] + [b.num_rows for b in out]), out)]
    assert all(s <= 2500 or b.num_rows == 1 for s, b in zip(sizes, out))
    got = [c for b in out for c in b.column("_chunks").to_pylist()]
    assert got == [r.split_recursively(t or "") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = r.chunk_recursive(docs, "id", "text").orderBy("source", "chunk").collect()
    assert [x.content for x in rows] == [c for t in texts for c in r.split_recursively(t or "")]
