"""Ranked lexical search: the documents that score highest for each item.

A document's score for an item sums, over the item's distinct terms, whole-number products of the term's weight (from how many
documents hold it) and of how often the document holds it, damped by the document's length.

1. Items are taken in blocks with about BLOCK_TERMS terms. One pass over the documents counts each one's terms, and its occurrences of the
   block's terms, and writes them; document counts of terms and totals come from these rows.
2. The rows are dealt at random into shards of bounded size. A shard has a posting list per term, in the order of its documents, with
   the term's share of the score (its impact), and over each list a sparse table for range-maximum queries.
3. Search in a shard is best-first over intervals of its documents. An interval's bound is the sum, over the item's terms, of the greatest
   impact in it, each by one range-maximum query. The intervals with the greatest bounds are split at the document with the
   greatest single impact, which is scored; intervals whose bound can't reach the best k so far are dropped. A round takes WIDTH intervals,
   so that numpy works on all their terms at once.
4. The best k of each shard and item are ranked in two steps: by item and one of SALT parts, then by item.

Terms are runs of ASCII letters, lower-cased, ASCII digits and all characters beyond ASCII.

Defined cases: a NULL or empty text has no term; documents without any don't count. Rows that share an item id (NULL too) are one item with the
terms of all. Rows that share a document id are documents of their own; equal scores go by document id, NULL last. An item without terms, or whose
terms are nowhere, has no rows; with no document or no item the result is empty. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlogs.stage import materialise

TOP = 50
#: Pairs of item and term that are searched for at once: what the driver and each task hold of the items.
BLOCK_TERMS = 200_000
#: Documents and postings of a shard, about.
SHARD_DOCS = 8_192
SHARD_POSTINGS = 1_000_000
WIDTH = 128
SALT = 16

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Batches = Iterable[pa.RecordBatch]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def _item_terms(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(x.as_py() or b""))) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["item_id", "terms"])


def _counted(terms: list[str]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Documents' numbers of terms, and which of ``terms`` they hold how often."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): k for k, t in enumerate(terms)}.get
        for batch in batches:
            sizes, held, times = [], [], []
            for value in batch.column("text"):
                words = terms_of(value.as_py() or b"")
                counts = Counter(map(number, words))
                counts.pop(None, None)
                sizes.append(len(words))
                held.append(list(counts.keys()))
                times.append(list(counts.values()))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "held", "times"])
            yield whole.filter(pa.array([n > 0 for n in sizes]))

    return run


class Shard:
    """Posting lists of a shard's documents, with sparse tables of the places of range maxima."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int) -> None:
        """Postings: place of the document, number of the term, impact."""
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, self.n_docs = docs[order], impacts[order], n_docs
        self.keys = terms[order].astype(np.int64) * n_docs + self.docs
        numbers, first = np.unique(terms[order], return_index=True)
        ends = np.append(first[1:], len(order))[: len(first)]
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(numbers, first, ends, strict=True)}
        longest = int((ends - first).max()) if len(order) else 1
        #: level k has the place of the greatest impact among 2**k postings from each one on
        self.table = np.zeros((longest.bit_length(), len(order)), np.int32)
        self.table[0] = np.arange(len(order))
        for k in range(1, len(self.table)):
            half = 1 << (k - 1)
            a, b = self.table[k - 1], np.append(self.table[k - 1][half:], self.table[k - 1][-half:])
            self.table[k] = np.where(self.impacts[b] > self.impacts[a], b, a)
        self.levels = np.zeros(longest + 1, np.int64)
        for k in range(1, len(self.table)):
            self.levels[1 << k :] = k

    def _bounds(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of posting ranges: the sum of their maxima, and the document of the greatest."""
        some = right > left
        level = self.levels[np.where(some, right - left, 1)]
        a = self.table[level, np.where(some, left, 0)]
        b = self.table[level, np.where(some, right - (1 << level), 0)]
        value_a, value_b = self.impacts[a], self.impacts[b]
        values = np.where(some, np.maximum(value_a, value_b), 0)
        best = np.argmax(values, axis=1)
        rows = np.arange(len(values))
        place = np.where(value_b[rows, best] > value_a[rows, best], b[rows, best], a[rows, best])
        return values.sum(axis=1), self.docs[place]

    def best(self, terms: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k highest scores above 0, equal ones by document."""
        own = [(t, *self.lists[t]) for t in terms.tolist() if t in self.lists]
        if not own:
            return []
        base = np.array([t * self.n_docs for t, _, _ in own])
        left, right = np.array([[a for _, a, _ in own]]), np.array([[b for _, _, b in own]])
        bound, at = self._bounds(left, right)
        low = np.zeros(1, np.int64)  # the first document of an interval
        top_scores, top_docs, least, last = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, self.n_docs
        while len(bound):
            if len(bound) > WIDTH:
                part = np.argpartition(-bound, WIDTH)
                now, rest = part[:WIDTH], part[WIDTH:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            doc, l_now, r_now = at[now], left[now], right[now]
            place = np.searchsorted(self.keys, base + doc[:, None])
            there = np.minimum(place, len(self.docs) - 1)
            hit = (place < r_now) & (self.docs[there] == doc[:, None])
            scores = np.where(hit, self.impacts[there], 0).sum(axis=1)
            top_scores, top_docs = np.append(top_scores, scores), np.append(top_docs, doc)
            if len(top_scores) > k:
                kept = np.lexsort((top_docs, -top_scores))[:k]
                top_scores, top_docs = top_scores[kept], top_docs[kept]
                least, last = int(top_scores[-1]), int(top_docs[-1])
            elif len(top_scores) == k:
                least = int(top_scores.min())
                last = int(top_docs[top_scores == least].max())
            new_left, new_right = np.concatenate([l_now, place + hit]), np.concatenate([place, r_now])
            new_low = np.concatenate([low[now], doc + 1])
            new_bound, new_at = self._bounds(new_left, new_right)
            # an interval that can only equal the last score must hold an earlier document
            open_new = (new_bound > least) | ((new_bound == least) & (new_low < last))
            open_old = (bound[rest] > least) | ((bound[rest] == least) & (low[rest] < last))
            rest = rest[open_old]
            left, right = np.concatenate([left[rest], new_left[open_new]]), np.concatenate([right[rest], new_right[open_new]])
            bound, at, low = np.append(bound[rest], new_bound[open_new]), np.append(at[rest], new_at[open_new]), np.append(low[rest], new_low[open_new])
        order = np.lexsort((top_docs, -top_scores))
        return [(int(top_scores[i]), int(top_docs[i])) for i in order if top_scores[i] > 0]


def impact(weight: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Share of a term in a score; ``length`` is the document's m."""
    return weight * ((1_000_000_000 * times) // (1000 * times + 20 * length))


def _searched(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False) if not rows.column("doc_id").null_count else np.array([np.iinfo(np.int64).max if x is None else x for x in rows.column("doc_id").to_pylist()])
        order = np.argsort(ids, kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        held, times = rows.column("held").combine_chunks(), rows.column("times").combine_chunks()
        sizes = np.diff(held.offsets.to_numpy())
        doc = np.repeat(np.arange(len(order)), sizes)
        n = np.array(rows.column("n").to_pylist(), np.int64)
        term = held.flatten().to_numpy().astype(np.int64)
        length = 100 - 50 + (50 * n * n_docs) // n_terms
        shard = Shard(doc, term, impact(weights[term], times.flatten().to_numpy().astype(np.int64), length[doc]), len(order))
        found = [(number, d, s) for number, terms in items for s, d in shard.best(terms, k)]
        docs = rows.column("doc_id").take(pa.array([d for _, d, _ in found], pa.int64()))
        return pa.table({"item": pa.array([x for x, _, _ in found], pa.int64()), "doc_id": docs, "score": pa.array([s for _, _, s in found], pa.int64())})

    return run


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The best k of ``docs`` (doc_id, text) for the items of ``block`` (item, terms), a bounded number of terms."""
    spark = docs.sparkSession
    items = [(r["item"], r["terms"]) for r in block.orderBy("item").collect()]
    terms = sorted({t for _, own in items for t in own})
    number = {t: i for i, t in enumerate(terms)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_counted(terms), "doc_id long, n long, held array<int>, times array<int>")
    # a random number, written, deals repeated rows apart as well
    rows = materialise(rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "search_rows")
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("held")).alias("postings")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    counts = materialise(rows.select(F.explode("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "search_terms")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = np.zeros(max(1, len(terms)), np.int64)
    for r in counts.select("term", weight.cast("long").alias("w")).collect():  # a row for each term of the block
        weights[r["term"]] = r["w"]
    shards = max(1, -(-n_docs // SHARD_DOCS), -(-(total["postings"] or 0) // SHARD_POSTINGS))
    own = [(i, np.array([number[t] for t in held], np.int64)) for i, held in items]
    dealt = rows.withColumn("shard", F.pmod("deal", F.lit(shards))).drop("deal")
    found = dealt.groupBy("shard").applyInArrow(_searched(own, weights, n_docs, n_terms, k), "item long, doc_id long, score long")
    best = materialise(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))), "search_found")
    for by in (["item", "salt"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's best k documents."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    held = asked.mapInArrow(_item_terms, f"item_id {kind}, terms array<string>").select("item_id", F.explode("terms").alias("term"))
    held = held.groupBy("item_id").agg(F.collect_set("term").alias("terms"))  # at most the words of the item's texts
    held = materialise(held.withColumn("item", F.monotonically_increasing_id()), "search_items")
    blocks = max(1, -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    best = None
    for b in range(blocks):
        part = _search_block(docs, held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms"), k)
        part = part if blocks == 1 else materialise(part, "search_best")
        best = part if best is None else best.unionByName(part)
    return best.join(held.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
