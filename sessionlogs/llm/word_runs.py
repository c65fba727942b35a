"""Periodic runs of words, and texts without their repetitions.

A run is a longest stretch of words with smallest period q (words q apart are equal); runs of at least LEAST words and TIMES
periods are found, and all but the first period of each can be dropped.

1. A run of TIMES periods holds each of its words so often at least; so do the words by which it could be longer. Rarer words therefore cut a
   text into parts that hold its runs whole, and parts under LEAST words have none.
2. Baier's grouping, the first phase of a suffix sorter: places are grouped by their word, and from the greatest group down each group's
   places make the nearest earlier place that is still lower one group longer. The groups that come out are the Lyndon words
   that are longest from each place, hence the Lyndon array; with words in the reverse order it gives the other one.
3. Every run has Lyndon roots in one of the two arrays, and with three periods two of them side by side. Each pair of equal neighbours
   in an array is extended to both sides by longest common extensions of its period.

Defined cases: a NULL or empty text, or one without words, has no run and the empty text; words are told apart byte by
byte; runs come by start, then period. Equal rows give equal results, extra columns are kept, of clashing names the computed one stays, and
an empty table gives an empty result. Texts are read whole, in linear memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least words and periods of a run.
LEAST = 24
TIMES = 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_array(s: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, by Baier's grouping."""
    n = len(s)
    letters, group = np.unique(s, return_inverse=True)
    ends = np.cumsum(np.bincount(group, minlength=len(letters)))
    places = [part.tolist() for part in np.split(np.argsort(group, kind="stable"), ends[:-1])]
    group = group.tolist()
    length = [1] * len(places)
    above, below = list(range(1, len(places) + 1)), list(range(-1, len(places) - 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 2))
    left.append(n - 1)
    now = len(places) - 1
    while now >= 0:
        longer: dict[tuple[int, int], list[int]] = {}
        at, times = -1, 0
        for i in places[now]:
            if group[i] != now:  # it has moved up since
                continue
            # greater places are out of the list, so its neighbour is the nearest lower one
            before, after = left[i], right[i]
            left[after] = before
            if before < 0:
                continue
            right[before] = after
            if before == at:
                times += 1
                continue
            if at >= 0:
                longer.setdefault((times, group[at]), []).append(at)
            at, times = before, 1
        if at >= 0:
            longer.setdefault((times, group[at]), []).append(at)
        # right above their old group; of one old group, the longest ends up on top
        for times, old in sorted(longer, reverse=True):
            moved, new, upper = longer[times, old], len(length), above[old]
            length.append(length[old] + times * length[now])
            places.append(moved)
            above.append(upper)
            below.append(old)
            above[old] = below[upper] = new
            for i in moved:
                group[i] = new
        places[now] = ()
        now = below[now]
    return np.array(length)[group]


def extension(s: np.ndarray, i: int, j: int) -> int:
    """How many words from ``i`` and from the later ``j`` on are equal."""
    n, same, step = len(s), 0, 32
    while j + same < n:
        m = min(step, n - j - same)
        other = np.flatnonzero(s[i + same : i + same + m] != s[j + same : j + same + m])
        if len(other):
            return same + int(other[0])
        same, step = same + m, 2 * step
    return same


def _parts(ids: np.ndarray, least: int, times: int, passes: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of words that are frequent enough for a run, with their starts."""
    pending = [(0, ids, passes)]
    while pending:
        start, part, again = pending.pop()
        often = np.bincount(part)[part] >= times
        if often.all() or not again:
            yield start, part
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                pending.append((start + a, np.unique(part[a:b], return_inverse=True)[1], again - 1))


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``times`` (3 or more) periods, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for start, part in _parts(ids, least, times) if len(ids) >= least else ():
        n, back = len(part), part[::-1]
        for s in (part, part.max() - part):
            lengths = lyndon_array(s)
            after = np.arange(n) + lengths
            next_ = np.minimum(after, n - 1)
            roots = np.flatnonzero((after < n) & (lengths[next_] == lengths) & (s[next_] == s))
            period, end = 0, 0
            for i in roots[np.argsort(lengths[roots], kind="stable")].tolist():
                q = int(lengths[i])
                if q == period and i + q <= end:  # within the stretch found last
                    continue
                period, end = q, i + q + extension(part, i, i + q)
                first = i - extension(back, n - i - q, n - i)
                if end - first >= max(least, times * q):
                    found.add((start + first, end - first, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def add_runs(df: DataFrame, text: str = "text", runs: str = "runs", short: str = "collapsed", *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``df`` with every run of its texts' words, and the kept words joined by single spaces. Words stand between ASCII white space."""
    if times < 3:
        raise ValueError("Lyndon roots stand side by side in runs of three periods or more")
    kept = [c for c in df.columns if c not in (runs, short)]
    rows = df.select(*kept, F.col(text).cast("binary").alias("_text"))
    fields = [*df.select(*kept).schema.fields, T.StructField(runs, T._parse_datatype_string(RUNS)), T.StructField(short, T.StringType())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for value in batch.column("_text"):
                words = (value.as_py() or b"").split()
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found.append(find_runs(ids, least, times))
                texts.append(b" ".join(collapsed(words, found[-1])))
            values = [[{"start": a, "length": b, "period": c} for a, b, c in x] for x in found]
            columns = [*batch.columns[:-1], pa.array(values, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, runs, short])

    return rows.mapInArrow(run, T.StructType(fields))


def strongest(runs: Column) -> Column:
    """The run of most periods, the first of equals; NULL without a run."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def as_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
