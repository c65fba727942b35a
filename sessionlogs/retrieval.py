"""Documents: page texts, chunks, vectors and nearest chunks."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, BucketedRandomProjectionLSH, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlogs.parse import fallback_error_type
from sessionlogs.skew import SEGMENT_ROWS, segments, sequence
from sessionlogs.stage import materialise

# --- fixed values: chunk sizes and query texts ---
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", " ", ""]
DEFAULT_K = 3
CONTEXT_K = 5
ANALYSIS_QUERY = "system architecture, error patterns"
REMEDY_QUERY = "remediation steps, configuration guides"
RECOMMENDATION_QUERIES = [
    "best practices for handling",
    "recommended solutions for",
    "troubleshooting guide for",
]
BEST_PRACTICE_QUERIES = [
    "best practices for",
    "performance optimization",
    "security best practices",
]
# --- end of fixed values ---

# Ship the task functions of this module by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VECTOR_SIZE = 256
#: Rows of a block of chunks and of queries, and queries scored at once.
CHUNK_BLOCK = 20_000
QUERY_BLOCK = 20_000
QUERY_STEP = 250
SCORE_DIGITS = 6
#: Characters of texts chunked at once.
SLICE_CHARS = 4_000_000


def page_texts(pages: DataFrame, doc: str, page: str, text: str, size: int = SEGMENT_ROWS) -> DataFrame:
    """Page texts of each document in page order, a newline after each.

    Documents of more than ``size`` pages continue in further segments.
    """
    ordered = sequence(pages.select(doc, page, text), [doc, page], "pages")
    lists = segments(ordered, [doc], "seq", F.col(text), "texts", size)
    return lists.select(
        doc, "segment_no", F.concat(F.array_join("texts", "\n"), F.lit("\n")).alias("text")
    )


def _exploded(docs: DataFrame, source: str, chunks: Column) -> DataFrame:
    return (
        docs.select(F.col(source).alias("source"), chunks.alias("_chunks"))
        .select("source", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk", "content"))
        .select("source", "chunk", "total_chunks", "content")
    )


def chunk_fixed(
    docs: DataFrame, source: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Pieces of ``size`` characters, each repeating the last ``overlap`` of the one before."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return _exploded(
        docs, source, F.transform(starts, lambda i: F.substr(F.col(text), i * step + 1, F.lit(size)))
    )


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join consecutive pieces up to ``size``; the next chunk starts with up to ``overlap`` of the last."""
    window: deque[str] = deque()
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.popleft())
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def split_recursively(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: list[str] = SEPARATORS,
) -> list[str]:
    """Chunks cut at the coarsest separator that occurs; pieces of ``size`` or more are cut finer.

    A separator stays at the start of the piece after it; chunks are stripped.
    """
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1 :]
    head, *tail = text.split(sep) if sep else list(text) or [""]
    chunks: list[str] = []
    fitting: list[str] = []
    for piece in filter(None, [head, *(sep + t for t in tail)]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        chunks += _merge(fitting, size, overlap)
        fitting = []
        chunks += split_recursively(piece, size, overlap, finer) if finer else [piece]
    chunks += _merge(fitting, size, overlap)
    return [c for c in (c.strip() for c in chunks) if c]


def _chunk_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, text) batches as (source, chunks), chunked by slices of about SLICE_CHARS: a worker's Python holds one
    slice and its chunks, however many rows a batch has; a longer text is a slice of its own and is chunked whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_CHARS, "right")))
            part = batch.slice(at, end - at)
            chunks = [split_recursively(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chunks, pa.list_(pa.string()))], ["source", "_chunks"])
            at = end


def chunk_recursive(docs: DataFrame, source: str, text: str) -> DataFrame:
    """Chunks cut at blank lines, else lines, else words, else anywhere."""
    rows = docs.select(F.col(source).alias("source"), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema["source"], T.StructField("_chunks", T.ArrayType(T.StringType()))])
    return _exploded(rows.mapInArrow(_chunk_slices, schema), "source", F.col("_chunks"))


def replace_session_docs(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunks of the sessions in ``chunks``; without chunks nothing changes."""
    if chunks.isEmpty():
        return
    (
        chunks.hint("rebalance", "session_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_id")
        .parquet(path)
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _vectors(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of a block by number of elements; vectors that are NULL or have NULLs are left out."""
    vectors = table.column("embedding").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    usable = sizes > 0
    usable[pc.list_parent_indices(vectors).filter(vectors.flatten().is_null()).to_numpy()] = False
    found = {}
    for size in np.unique(sizes[usable]):
        part = table.filter(pa.array(usable & (sizes == size)))
        flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        found[int(size)] = part.column(name).to_numpy(), _unit(flat.astype(np.float64).reshape(part.num_rows, -1))
    return found


def _best_of_blocks(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best chunks of one block for every query of another, ties by id."""

    def best(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        asked = _vectors(queries, "query_id")
        for size, (ids, rows) in _vectors(chunks, "vec_id").items():
            query_ids, vectors = asked.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            for at in range(0, len(query_ids), QUERY_STEP):
                scores = np.round(vectors[at : at + QUERY_STEP] @ rows.T, SCORE_DIGITS) + 0.0
                for query_id, own in zip(query_ids[at : at + QUERY_STEP].tolist(), scores, strict=True):
                    # what reaches the k-th best score, in the order of ids: a stable sort settles ties
                    near = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
                    top = near[np.argsort(-own[near], kind="stable")[:k]]
                    out.append((np.full(len(top), query_id), ids[top], own[top]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return best


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = scores.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")


def topk_similar(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The ``k`` chunks most similar (cosine) to each query: ``query_id, rank, vec_id, score``.

    ``chunks`` has ``vec_id`` (BIGINT) and ``embedding``, ``queries`` has ``query_id`` (BIGINT)
    and ``embedding``. Both are read once and dealt into blocks of bounded size; every block of chunks meets every block of
    queries in a task of its own, by matrix products, and passes on its k best per query. Neither side goes through the driver.
    Queries without a vector get no rows; chunks whose vector is NULL, has NULLs or another length than a query's are left
    out for it, see ``unusable_vectors``.
    """
    queries = materialise(queries.where(F.size("embedding") > 0).select("query_id", "embedding"), "queries")
    n_chunks, n_queries = chunks.select("vec_id").count(), queries.count()
    parts, blocks = (max(1, -(-n // size)) for n, size in ((n_chunks, CHUNK_BLOCK), (n_queries, QUERY_BLOCK)))

    def dealt(rows: DataFrame, name: str, own: int, own_name: str, other: int, other_name: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(own)).cast("int")
        rows = rows.select(F.col(name), "embedding", place.alias(own_name))
        return rows.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = dealt(chunks, "vec_id", parts, "part", blocks, "block").groupBy("part", "block")
    right = dealt(queries, "query_id", blocks, "block", parts, "part").groupBy("part", "block")
    return _ranked(left.cogroup(right).applyInArrow(_best_of_blocks(k), "query_id bigint, vec_id bigint, score double"), k)


def topk_approximate(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, width: float = 1.0, tables: int = 12, seed: int = 42) -> DataFrame:
    """Like ``topk_similar``, but only of chunks that share a bucket with the query: ``tables`` random projections of unit vectors,
    cut into steps of ``width``. Narrow steps make fewer pairs and find fewer of the nearest. Scores are exact."""
    unit = F.col("embedding")
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))

    def prepared(rows: DataFrame, name: str) -> DataFrame:
        usable = F.coalesce(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (norm > 0), F.lit(False))
        # written, so that neither conversion nor hashing meets what the filter drops
        return materialise(rows.where(usable).select(name, F.transform(unit, lambda x: x / norm).alias("unit")), name).withColumn("unit", array_to_vector("unit"))

    left, right = prepared(chunks, "vec_id"), prepared(queries, "query_id")
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="buckets", bucketLength=width, numHashTables=tables, seed=seed)
    pairs = lsh.fit(left).approxSimilarityJoin(left, right, 2.01, distCol="distance")  # 2 is the greatest distance
    score = F.round(1 - F.col("distance") * F.col("distance") / 2, SCORE_DIGITS) + F.lit(0.0)
    return _ranked(pairs.select(F.col("datasetB.query_id").alias("query_id"), F.col("datasetA.vec_id").alias("vec_id"), score.alias("score")), k)


def unusable_vectors(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks that ``topk_similar`` leaves out for queries of ``size`` numbers."""
    v = F.col("embedding")
    return chunks.where(v.isNull() | (F.size(v) != size) | F.exists(v, lambda x: x.isNull()))


def text_model(docs: DataFrame, text: str = "content", size: int = VECTOR_SIZE) -> PipelineModel:
    """Hashed TF-IDF weights learnt from ``docs``."""
    stages = [
        Tokenizer(inputCol=text, outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(docs)


def text_to_vector(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """``docs`` with a unit-length ``embedding``."""
    return (
        model.transform(docs)
        .withColumn("embedding", vector_to_array("_unit", "float32"))
        .drop("_words", "_tf", "_tfidf", "_unit")
    )


def ranked_contents(top: DataFrame, contents: DataFrame) -> DataFrame:
    """``topk_similar`` rows with the ``content`` of their chunk.

    The few rows are written first: the planner then knows their size and need not
    shuffle the contents.
    """
    return contents.select("vec_id", "content").join(materialise(top, "top"), "vec_id")


def relevant_context(top: DataFrame, contents: DataFrame) -> DataFrame:
    """Contents of the top chunks of each query (at most k), best first, joined by a space."""
    return (
        ranked_contents(top, contents)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("c"))
        .select("query_id", F.array_join("c.content", " ").alias("context"))
    )


def context_of(top: DataFrame, contents: DataFrame, query_id: int = 0) -> Column:
    """The context of one query as a value for any row: a scalar subquery over its ``k`` contents, NULL without any."""
    return relevant_context(top.where(F.col("query_id") == query_id), contents).select("context").scalar()


def fixed_context(chunks: DataFrame, query: str = ANALYSIS_QUERY, k: int = CONTEXT_K) -> Column:
    """The contents of the ``k`` chunks nearest to a fixed query text, by the vectors learned from the chunks.

    ``chunks`` has ``vec_id`` (BIGINT) and ``content``. Without chunks there is no vector to learn, and the context is NULL.
    """
    chunks = materialise(chunks.where(F.col("content").isNotNull()).select("vec_id", "content"), "chunks")
    if chunks.isEmpty():
        return F.lit(None).cast("string")
    model = text_model(chunks)
    asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, content string")
    top = topk_similar(text_to_vector(model, chunks), text_to_vector(model, asked), k)
    return context_of(top, chunks)


def error_queries(pool: DataFrame) -> DataFrame:
    """Distinct ``error pattern <type>`` texts for the errors of all chains."""
    kind = fallback_error_type(
        F.col("message"), F.when(F.col("error_type") != "unknown", F.col("error_type"))
    )
    return (
        pool.where("in_chain").select(F.concat(F.lit("error pattern "), kind).alias("query")).distinct()
    )


def section_queries(error_texts: DataFrame) -> DataFrame:
    """All documentation queries with their section."""
    fixed = [("recommendations", q) for q in RECOMMENDATION_QUERIES]
    fixed += [("best_practices", q) for q in BEST_PRACTICE_QUERIES]
    table = error_texts.sparkSession.createDataFrame(fixed, "section string, query string")
    return error_texts.select(F.lit("error_patterns").alias("section"), "query").unionByName(table)


def documentation_context(
    queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K
) -> DataFrame:
    """The top ``k`` chunks of every query, by section.

    ``queries`` has ``section``, ``query_id`` and ``embedding``.
    """
    return queries.select("section", "query_id").join(topk_similar(chunks, queries, k), "query_id")
