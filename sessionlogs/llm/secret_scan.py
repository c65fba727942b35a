"""Secret scan: fixed patterns, and a password guess-cost dynamic program for values in credential contexts.

Fixed patterns find assigned keys, access keys and hexadecimal strings. Besides, a value after a credential's name
(``password is hunter2!``) is a secret if it is hard to guess: the cheapest segmentation of the value
into words, dates, repeats, keyboard walks and brute-force spans gives the logarithm of the guesses that an attacker who knows these
patterns needs. Values as easy as a common word or a date are placeholders and left alone. ``learned_words`` counts the words of all documents
and gives the most frequent ones their ranks, so that words of the corpus' own languages and subjects are easy too. Bare words in a sentence
(``the token is documented elsewhere``) are prose, not values.

A span is (kind, start, end) in code points, end exclusive. Kinds: assign, access, hex, and password for what the method adds.

Defined cases: a NULL or empty text has no spans; an empty table gives an empty one. Texts and values of any length are read whole; the program is linear in a
value, as words and dates have a greatest length. Spans of equal start stand in the order of kinds; words of equal count are ranked by code points. Repeated rows and ids are scanned apart. Extra columns are kept; of clashing names
the computed one stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns and least lengths of the base spans.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more; shorter ones are dropped
KINDS = ("assign", "access", "hex", "password")

#: A credential's name, also at the end of a longer one, what may stand between, and a value up to white space or its closing quote. After a line feed,
#: a value is indented and neither a list's item nor the next name.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)|(?:(?<![a-z])|(?-i:(?<=[a-z])(?=P)))pass|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth[_-]?key)"
    r"[\"']?(?:[\x20\t]*+[:=]{1,2}>?(?:[\x20\t]*+(?!\r?\n)|[\x20\t]*+\r?\n[\x20\t]++(?!-\s|[\"']?[\w.-]{1,80}[\"']?[\x20\t]*[:=](?:\s|\Z)))|[\x20\t]is:?[\x20\t])"
    r"(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s\"']+))",
    re.ASCII | re.IGNORECASE,
)
VALUE_LEAST = 6
#: Values filled in elsewhere: closed forms, and names of variables.
TEMPLATE = re.compile(r"\$?\{\{[^{}\n]*+\}\}|[$%#]?\{[^{}\n]*+\}|\$\([^()\n]*+\)|<[^<>\n]*+>|\[[\w\x20.-]*+\]|%\([^()\n]*+\)s|%\w++%|\$[A-Z_][A-Z0-9_]*(?![^\s\"'.,;:)\]}>])")
#: A bare word, also with hyphens, in one of the cases of prose; and prose going on after it.
BARE = re.compile(r"(?:[^\W\d_]+['’-])*[^\W\d_]+")
GOES_ON = re.compile(r"[,;]?\x20+(?:[(\"'“]?[^\W\d_]+\b(?!\x20*[:=]))")
#: Values from this many guesses on (a power of ten) are secrets.
HARD = 8.0

#: Words by how soon they are guessed.
WORDS = """password pass admin root user login guest test default secret token key changeme change me letmein welcome
qwerty dragon monkey master shadow sunshine princess football baseball superman batman hello love money freedom
whatever trust hunter killer summer winter spring autumn january february march april june july august september
october november december monday tuesday wednesday thursday friday saturday sunday example sample dummy placeholder your
my the here null none true false redacted hidden xxxx company server database service account name value string
local host production staging development temp temporary public private access auth client api code hash
house water light green black white red blue orange silver gold star moon sun tree river mountain ocean tiger
eagle lion horse dog cat bird fish apple banana cherry coffee pizza music guitar computer internet system
network office school student teacher doctor king queen prince knight magic power happy lucky crazy pretty
angel baby family mother father sister brother friend people world country city street road garden flower""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
#: Words that ``learned_words`` ranks, letters of the longest, and rows that one must stand in.
LEARNED, LONGEST_WORD, LEAST_ROWS = 100_000, 24, 5
LEET = str.maketrans("4@3105$7", "aaeiosst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {
    a: {b for k, other in enumerate(ROWS) for j, b in enumerate(other) if abs(k - r) <= 1 and abs(j - i) <= 1 and b != a}
    for r, row in enumerate(ROWS)
    for i, a in enumerate(row)
}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
LONGEST_DATE = 10
#: Guesses for a character by brute force, and for opening another span (powers of ten).
CHARACTER, SPAN = 1.0, 0.3
DATE_COST = {True: log10(365 * 120), False: log10(120)}


def learned_words(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Ranks of the ``LEARNED`` most frequent words of all documents; the fixed ones keep theirs. At most that many rows reach the driver."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))).alias("word")
    counts = docs.select(word).where(F.length("word").between(3, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "word").limit(LEARNED).toArrow().column("word").to_pylist()
    return {**{w: len(RANK) + i + 1 for i, w in enumerate(top)}, **RANK}


def _word(piece: str, rank_of: dict[str, int] = RANK) -> float | None:
    lower = piece.lower()
    rank = rank_of.get(lower)
    swapped = 0.0
    if rank is None:
        rank, swapped = rank_of.get(lower.translate(LEET)), log10(4)
    if rank is None:
        return None
    upper = 0.0 if piece == lower else log10(2) if piece in (lower.upper(), lower.capitalize()) else log10(2) * len(piece)
    return log10(rank + 1) + swapped + upper


def _cheapest(starts: list[int], end: int, done: list[float], kinds: int) -> tuple[float, list[int]]:
    """Least cost of a run up to ``end`` from one of ``starts``, and the starts that can still be the best for a longer one.

    A cost grows by the logarithm of the length, faster for later starts: one that an earlier start reaches stays behind it.
    """
    best, kept = float("inf"), []
    for start in starts:
        cost = done[start] + SPAN + log10(kinds * (end - start))
        if cost < best:
            best = cost
            kept.append(start)
    return best, kept


def guesses(value: str, rank_of: dict[str, int] = RANK) -> float:
    """Power of ten of the guesses for ``value``: the cheapest segmentation from its start to its end."""
    n = len(value)
    lower = value.lower() if len(value.lower()) == n else value
    # cheapest ways to a place: with a span ending there, and within a brute-force span
    done, brute = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)
    # length of the run of equal characters, and of neighbouring keys, that ends at a place; where these runs may begin
    same = walk = 1
    repeats: list[int] = []
    walks: list[int] = []
    for end in range(1, n + 1):
        same, repeats = (same + 1, repeats) if end > 1 and value[end - 1] == value[end - 2] else (1, [])
        walk, walks = (walk + 1, walks) if end > 1 and lower[end - 1] in NEXT.get(lower[end - 2], ()) else (1, [])
        brute[end] = min(brute[end - 1], done[end - 1] + SPAN) + CHARACTER
        best = brute[end]
        if same >= 3:
            cost, repeats = _cheapest([*repeats, end - 3], end, done, 12)
            best = min(best, cost)
        if walk >= 4:
            cost, walks = _cheapest([*walks, end - 4], end, done, 47 * 4)
            best = min(best, cost)
        for start in range(max(0, end - LONGEST_WORD), end - 1):
            if (cost := _word(value[start:end], rank_of)) is not None:
                best = min(best, done[start] + SPAN + cost)
        for start in range(max(0, end - LONGEST_DATE), end - 3):
            if value[start].isdigit() and DATE.fullmatch(value, start, end):
                best = min(best, done[start] + SPAN + DATE_COST[end - start > 4])
        done[end] = best
    return done[n]


def _prose(text: str, name_to_value: str, start: int, end: int) -> bool:
    """Whether an unquoted value is a bare word of a sentence: said with ``is``, or with a further word after it."""
    value = text[start:end]
    if not BARE.fullmatch(value) or not all(w in (w.lower(), w.upper(), w.capitalize()) for w in value.split("-")):
        return False
    return name_to_value.rstrip(": \t").lower().endswith(" is") or bool(GOES_ON.match(text, end))


def spans(text: str, rank_of: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind in the order of ``KINDS``."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in found)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while end > start and text[end - 1] in ".,;:)]}>":
            end -= 1
        before = bisect_left(starts, end)  # base spans that start before the value's end; the farthest of them must end before it
        bare = m.lastindex == 3
        apart = not before or reach[before - 1] <= start
        filled = TEMPLATE.match(text, start)
        if apart and end - start >= VALUE_LEAST and not (filled and filled.end() >= end):
            if bare and _prose(text, text[m.start() : start], start, end) or guesses(text[start:end], rank_of) < HARD:
                continue
            found.append(("password", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


_FOUND = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}


def scan(df: DataFrame, text: str = "text", rank_of: dict[str, int] = RANK) -> DataFrame:
    """Adds counts by kind, the digest of the base spans and all spans. ``rank_of`` may be ``learned_words``."""
    kept = [c for c in df.columns if c not in _FOUND]
    rows = df.select(*kept) if text in kept else df.select(*kept, F.col(text))
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in _FOUND.items())).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _FOUND}
            for value in batch.column(text):
                found = spans(value.as_py() or "", rank_of)
                base = [x for x in found if x[0] != "password"]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
            columns = [pa.array(v, pa.string() if _FOUND[k] == "string" else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *out])

    return rows.mapInArrow(run, schema).select(*kept, *_FOUND)
