"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores the passages.

An item is found in a text if its best local alignment (1 per equal word, -1 per other, missing or added word) scores at least
a share of what an exact copy scores. Seeds are pairs of neighbouring words, and which of them an item needs is proven: an alignment
of score s holds at least s - 1 of the item's pairs unbroken, as every break between equal words costs 1 or more. So at most
(words - s) of them are missing, and of the rarest (words - s + SEEDS) at least SEEDS stand in the copy, whatever the edits are.

1. One pass over the documents keeps the places of pairs that a bit table of the items' pairs lets through.
2. Their counts rank each item's pairs; the rarest are its seeds.
3. Seeds are joined to the places; texts with enough seeds of an item are candidates of it.
4. Only candidate texts and items are joined by key, and aligned around the seeds.

Nothing but the bit table, of a fixed size, goes through the driver; a larger benchmark lets more places through. Texts go by a digest
of 256 bits, so equal ones are aligned once, and a lost task finds the same keys again.

Words are lower-case runs of letters and digits; in scripts without blanks, each character is one. Defined cases: NULL and empty texts have no passage;
items of 2 to 4 words are found as whole sequences only; those of one word can't be told from chance and are left out, NULL ones too; equal
items are found each; a repeated row is marked each time. Of alignments of equal score, the one that ends first in the item, then in the text, is
given. Without items or documents the result is empty lists or an empty table. Documents are read whole. Extra columns are kept; of clashing
names the computed one stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlogs.llm.near_dedup import perhaps_in
from sessionlogs.skew import hot_keys, join_many_to_one
from sessionlogs.stage import materialise

#: Items of fewer words are looked for as whole sequences.
LEAST_WORDS = 5
#: Least share of an exact copy's score: 1 per equal word, -1 per other, missing or added word.
LEAST_SCORE = 0.5
#: Seeds of an item that a candidate must have, fewer for items that can't guarantee so many.
SEEDS = 3
#: The bit table has 2**BITS bits.
BITS = 26
#: Words whose hash a worker remembers.
REMEMBERED = 1_000_000
#: Scripts written without blanks: Thai to Myanmar, Khmer, kana, Han and its extensions.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
_HITS = "array<struct<item_id:long,score:double,start:long,end:long>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def pair_keys(ws: list[str], hashes: _Hashes) -> np.ndarray:
    """Keys of the pairs of neighbouring words; a chance collision adds candidates, never hides one."""
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    key = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of the best local alignment, and its first and last word in ``text``, end exclusive."""
    n = len(text)
    slope = np.arange(1, n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        step = np.where((text == w) & (text > 0), 1, -1)
        across, over = score[:-1] + step, score[1:] - 1
        now = np.maximum(np.maximum(across, over), 0)
        begin = np.where(now == 0, slope, np.where(across >= over, start[:-1], start[1:]))
        # a gap in the item runs on from the best place before it
        lifted = now + slope
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(n), 0))
        score = np.concatenate([[0], peak - slope])
        start = np.concatenate([[0], begin[source]])
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


def least_of(size: int, least: float) -> int:
    """Least score of an item of so many words."""
    return size if size < LEAST_WORDS else max(1, ceil(least * size - 1e-9))


def needed(size: int, least: float) -> int:
    """Seeds that every copy of the least score has. (A least score of one word, below 0.2 here, would need no pair at all: such copies are not assured.)"""
    return max(1, min(SEEDS, least_of(size, least) - 1))


def _most(text: np.ndarray, item: np.ndarray) -> int:
    """Words that both have, with repeats: no alignment scores more."""
    known, held = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(known, text), len(known) - 1)
    return int(np.minimum(held, np.bincount(at[known[at] == text], minlength=len(known))).sum())


def passage(text: list[str], item: list[str], seeds: list[tuple[int, int, int, int]], least: float = LEAST_SCORE) -> tuple[float, int, int] | None:
    """The best passage for an item around ``seeds``: score as a share of the item's words, first and last word.

    A seed is its place in the text, its first and last place in the item, and its number of places there.
    """
    size, low_score, need = len(item), least_of(len(item), least), needed(len(item), least)
    # an alignment that reaches the least score has at most this many added words
    slack = size - low_score
    spans = sorted((at - last - slack, at + size - first + slack, copies) for at, first, last, copies in seeds)
    number: dict[str, int] = {}
    held = np.array([number.setdefault(w, len(number) + 1) for w in item], np.int64)
    best: tuple[int, int, int] = (0, 0, 0)
    k = 0
    while k < len(spans):
        low, high, have = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < high:
            high, have = max(high, spans[k][1]), have + spans[k][2]
            k += 1
        if have < need:
            continue
        low = max(0, low)
        part = np.array([number.get(w, 0) for w in text[low:high]], np.int64)
        if _most(part, held) < low_score:
            continue
        score, start, end = align(part, held)
        if score > best[0]:
            best = (score, low + start, low + end)
    return (best[0] / size, best[1], best[2]) if best[0] >= low_score else None


def _item_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
            ws = words(text)
            if len(ws) >= 2:
                n = len(ws) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n), pa.array([len(ws)] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(pair_keys(ws, hashes).view(np.int64))], ["item", "size", "place", "pair"]
                )


def _bit_table(pairs: DataFrame) -> np.ndarray:
    """Bits of the items' pairs: at most 2**(BITS - 6) numbers, whatever the benchmark's size."""
    bit = F.shiftrightunsigned("pair", 64 - BITS)
    cell = F.shiftrightunsigned(bit, 6)
    filled = pairs.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pair, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[filled.column("cell").to_numpy()] = filled.column("bits").to_numpy()
    return table.view(np.uint64)


def _known_pairs(table: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of the texts' pairs that the bit table lets through."""
    below = np.uint64(64 - BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows, places, keys = [], [], []
            for row, text in enumerate(batch.column("words_of")):
                ws = words(text.as_py())
                if len(ws) < 2:
                    continue
                key = pair_keys(ws, hashes)
                bit = key >> below
                at = np.flatnonzero((table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                rows.append(np.full(len(at), row))
                places.append(at)
                keys.append(key[at].view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places)), pa.array(np.concatenate(keys))], ["key", "at", "pair"])

    return run


def _aligned(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, []
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                key, item, body, item_text, seeds = (batch.column(c)[row] for c in ("key", "item", "words_of", "item_text", "seeds"))
                if key.as_py() != last:
                    last, text = key.as_py(), words(body.as_py())
                hit = passage(text, words(item_text.as_py()), [tuple(s.values()) for s in seeds.as_py()], least)
                if hit:
                    found.append((last, item.as_py(), *hit))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "item", "score", "start", "end"])

    return run


def _seeds(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The rarest pairs of each item that occur at all: their first and last place in it, their number of places, and how many are needed."""
    whole = F.col("size") < LEAST_WORDS
    low = F.when(whole, F.col("size")).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("size") - 1e-9))).cast("long")
    need: Column = F.greatest(F.lit(1), F.least(F.lit(SEEDS), low - 1))
    counts = known.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.join(counts, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # an item's pairs are those of one text
    rarest = Window.partitionBy("item").orderBy("n", "pair", "place")
    chosen = counted.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= F.col("size") - low + need)
    return (
        chosen.where("n > 0").groupBy("pair", "item").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("copies"), F.max(need).alias("need"))
    )


def passages(texts: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``key, item, score, start, end`` of the items found in texts; ``texts`` has ``key, words_of``, ``items`` has ``item, item_text``, unique."""
    pairs = materialise(items.mapInArrow(_item_pairs, "item string, size long, place long, pair long"), "item_pairs")
    known = materialise(texts.mapInArrow(_known_pairs(_bit_table(pairs)), "key string, at long, pair long"), "known_pairs")
    seeds = materialise(_seeds(pairs, known, least), "seeds")
    met = join_many_to_one(known, seeds, ["pair"], "at", hot_keys(known, ["pair"], known.count()))
    # copies of a text give the same rows
    once = met.groupBy("key", "item", "at", "first", "last", "copies", "need").agg(F.count(F.lit(1)).alias("_n"))
    near = once.groupBy("key", "item").agg(
        F.sum("copies").alias("have"), F.max("need").alias("need"), F.collect_list(F.struct("at", "first", "last", "copies")).alias("seeds")
    )
    near = materialise(near.where("have >= need").select("key", "item", "seeds"), "candidates")
    keys = near.select(F.col("key").alias("id")).distinct()
    # most texts that are no candidates go before the shuffle; a semi-join would be moved below this filter
    likely = perhaps_in(texts.withColumnRenamed("key", "id"), keys)
    bodies = likely.join(keys, "id").groupBy(F.col("id").alias("key")).agg(F.min("words_of").alias("words_of"))
    return near.join(items, "item").join(bodies, "key").mapInArrow(_aligned(least), "key string, item string, score double, start long, end long")


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "hits", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with the items found in each text: best score, first and last word, by item id."""
    kept = [c for c in docs.columns if c != name]
    key = f"_{name}_key"
    given = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_text").isNotNull())
    given = materialise(given.withColumn("item", F.sha2("item_text", 256)), "items")
    texts = docs.select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("words_of")).where(F.col("words_of").isNotNull())
    found = passages(texts, given.groupBy("item").agg(F.min("item_text").alias("item_text")), least)
    hit = F.struct("item_id", "score", "start", "end")
    hits = materialise(found.join(given.select("item", "item_id"), "item").groupBy("key").agg(F.sort_array(F.collect_list(hit)).alias(name)), "hits").withColumnRenamed("key", key)
    marked = docs.withColumn(key, F.sha2(F.col(text), 256)).drop(name).join(hits, key, "left")
    return marked.select(*kept, F.coalesce(F.col(name), F.array().cast(_HITS)).alias(name))
