"""Toxicity by a weighted finite-state pattern grammar.

Words are classed by a lexicon, and small transducers read a clause's classes from left to right. Each tells one thing of the place
it has reached: whether a target has been named, whether a negation reaches here, whether the words are reported speech, whether a threat
is under way. Their composition is one machine whose states are tuples; where it meets an insult, or a threat's
target, it puts out the pattern that has matched, and the pattern's factor weighs the word. A text's
score comes from its matched clauses: their sum and their density, by a logistic model.

Insults are learned from labelled texts: words and word beginnings (languages inflect) that stand in toxic texts far more often than in
others, by a likelihood ratio. Texts that share their least shingle hash count once, else copies would teach their own
words. A few well-known insults and threats are known from the start.

Defined cases: NULL and empty texts have no clause and get the model's score for none. Texts are read whole. Equal rows and ids
score alike. Only the text is read: ids decide which rows are learned from, never a score. Without labels, or with one class only,
a fixed model serves. Extra columns are kept; of clashing names the computed one stays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlogs.stage import materialise

#: About so many labelled rows, chosen by hash of the id, teach the lexicon and the model.
FIT_ROWS = 20_000
#: Most learned entries.
MOST_ENTRIES = 5_000
#: Least likelihood ratio of an entry, and how many times likelier it is in toxic texts.
LEAST_G, LEAST_RATIO = 24.0, 4.0
#: Texts with it that a longer beginning needs to overrule a shorter one.
OVERRULES = 6
PREFIXES = range(4, 9)
#: Words remembered, and features counted, before a worker starts anew.
MEMORY = 200_000

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n\"“”«»]")
WORD, END, QUOTE, INSULT, THREAT, TARGET, NEGATION, REPORT = range(8)

# Function words of English, German, French and Spanish by what they do in a clause.
_CLASSES = {
    END: ". ! ? ; \n",
    QUOTE: '" “ ” « »',
    TARGET: "you your yours you're he she they them him her his their those these people everyone du dich dir ihr euch ihn ihm er tu toi te vous il elle ils elles tú usted ustedes ellos ellas él ella",
    NEGATION: "not no never none nobody neither nor isn't aren't wasn't don't doesn't didn't can't won't without nicht kein keine keinen nie niemals ohne ne pas jamais sans non nunca jamás sin tampoco",
    REPORT: "said says say saying told tells claimed claims reported reports wrote writes quoted called calls according sagte sagt sagen behauptet laut meldet dit dits selon déclare affirme dijo dice según afirma",
    THREAT: "kill kills murder shoot stab strangle burn hang beat hurt destroy töten umbringen erschießen tuer frapper brûler matar golpear disparar",
}
_SEEDS = "idiot moron stupid loser scum worthless pathetic disgusting trash dumbass bastard imbecile cretin retard asshole bitch whore slut vermin subhuman arschloch hurensohn wichser schlampe connard salope enculé abruti gilipollas cabrón imbécil pendejo"
SEED_WEIGHT, THREAT_WEIGHT = 3.0, 2.5


@dataclass(frozen=True)
class Transducer:
    """``step``: next state for a state and a class; ``start``: at a clause's start; ``on``: states whose flag is set."""

    start: int
    step: Callable[[int, int], int]
    on: frozenset[int]


#: A target has been named in the clause.
TARGETED = Transducer(0, lambda s, c: 0 if c == END else 1 if c == TARGET else s, frozenset((1,)))
#: A negation reaches the three words after it.
NEGATED = Transducer(0, lambda s, c: 0 if c == END else 3 if c == NEGATION else max(0, s - 1), frozenset((1, 2, 3)))
#: Between quotation marks, or after a verb of saying (4 steps of a pair: quoted, reported).
REPORTED = Transducer(0, lambda s, c: s & 1 if c == END else s ^ 1 if c == QUOTE else s | 2 if c == REPORT else s, frozenset((1, 2, 3)))
#: A threat awaits its target within five words.
THREATENED = Transducer(0, lambda s, c: 0 if c == END else 5 if c == THREAT else max(0, s - 1), frozenset(range(1, 6)))
GRAMMAR = (TARGETED, NEGATED, REPORTED, THREATENED)
#: Factors of a pattern: with a target, negated, reported.
FACTORS = (1.25, 0.5, 0.6)


class Machine:
    """The composition of the transducers: states are numbered as they are first met."""

    def __init__(self, parts: tuple[Transducer, ...] = GRAMMAR):
        self.parts = parts
        self.states = [tuple(p.start for p in parts)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[tuple[int, int], tuple[int, float]] = {}

    def arc(self, state: int, kind: int) -> tuple[int, float]:
        """Next state and the factor that is put out, 0 if no pattern ends here."""
        found = self.arcs.get((state, kind))
        if found is None:
            now = self.states[state]
            then = tuple(p.step(s, kind) for p, s in zip(self.parts, now, strict=True))
            if then not in self.number:
                self.number[then] = len(self.states)
                self.states.append(then)
            # an insult is read in the state before it, a threat ends with its target
            flags = [s in p.on for p, s in zip(self.parts, now, strict=True)]
            factor = 0.0
            if kind == INSULT or (kind == TARGET and flags[3]):
                factor = 1.0
                for on, f in zip((flags[0] or kind == TARGET, flags[1], flags[2]), FACTORS, strict=True):
                    factor *= f if on else 1.0
            found = self.arcs[state, kind] = self.number[then], factor
        return found


_PLAIN = (WORD, 0.0)


class Lexicon(dict):
    """Class and weight of a word, remembered: from the fixed classes, or the entry for it or its longest beginning that has one."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.fixed = {w: (k, THREAT_WEIGHT) for k, words in _CLASSES.items() for w in (words.split(" ") if k == END else words.split())}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > MEMORY:
            self.clear()
        found = self.fixed.get(word)
        if found is None:
            weight = next((self.entries[f] for f in features(word) if f in self.entries), 0.0)
            found = (INSULT, weight) if weight else _PLAIN
        self[word] = found
        return found


def features(word: str) -> list[str]:
    """The whole word, marked by its end, and its beginnings, longest first."""
    return [word + "$", *(word[:k] for k in reversed(PREFIXES) if k <= len(word))]


def measures(text: str, lexicon: Lexicon, machine: Machine) -> tuple[float, float, int]:
    """Sum of the matched clauses' scores, number of words, number of matched clauses."""
    found = TOKEN.findall(text.lower())
    classed = [lexicon[w] for w in found]
    state, score, clause, matched, signs = 0, 0.0, 0.0, 0, 0
    for kind, weight in classed:
        if kind == WORD and state == 0:
            continue
        if kind <= QUOTE and kind:
            signs += 1
        state, factor = machine.arc(state, kind)
        if factor:
            clause += factor * (weight if kind == INSULT else THREAT_WEIGHT)
        if kind == END and clause:
            score, clause, matched = score + clause, 0.0, matched + 1
    if clause:
        score, matched = score + clause, matched + 1
    return score, max(0, len(found) - signs), matched


@dataclass(frozen=True)
class Model:
    entries: dict[str, float]
    #: logistic weights: constant, log of the sum, log of the sum in 100 words
    weights: tuple[float, float, float] = (-4.0, 0.5, 2.0)

    def score(self, total: float, words: int) -> float:
        a, b, c = self.weights
        z = a + b * log1p(total) + c * log1p(100 * total / max(words, 20))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def family(text: str) -> int:
    """Least hash of the text's 3-word shingles: copies mostly share it."""
    words = [zlib.crc32(w.encode()) for w in text.lower().split()]
    a = np.array([*words, 0, 0], np.uint64)
    mixed = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return int((mixed >> np.uint64(1)).min()) if words else 0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _families(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        families = pa.array([family(x.as_py() or "") for x in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, families], ["doc_id", "text", "toxic", "family"])


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def out() -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        return pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())], names=["feature", "t", "c"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
            words = {w for w in TOKEN.findall((text.as_py() or "").lower()) if len(w) > 2}
            (toxic if label.as_py() else clean).update({f for w in words for f in features(w)})
        if len(toxic) + len(clean) > MEMORY:
            yield out()
            toxic.clear(), clean.clear()
    yield out()


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", rows: int = FIT_ROWS) -> Model:
    """The lexicon and model from about ``rows`` labelled rows that aren't held out.

    The sampled labels are bounded, so they are broadcast; what comes to the driver is bounded by MOST_ENTRIES and by the rows.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    share = int(min(1.0, rows / max(1, labels.count())) * (1 << 30))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).dropDuplicates(["doc_id"])
    known = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(labels), "doc_id")
    known = materialise(known.mapInArrow(_families, "doc_id long, text string, toxic int, family long"), "toxicity_rows")
    chosen = known.groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id"))
    sample = known.select("doc_id", "text", "toxic").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    seeds = {w + "$": SEED_WEIGHT for w in _SEEDS.split()}
    if not n_toxic or not n_clean:
        return Model(seeds)
    found = sample.mapInArrow(_counts, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c, base = F.col("t"), F.col("c"), n_toxic / (n_toxic + n_clean)
    g = 2 * (t * F.log(t / ((t + c) * base)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - base)))).otherwise(0))
    ratio = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
    found = materialise(found.where(t + c >= OVERRULES).select("feature", ratio.alias("ratio"), F.when(t > 0, g).otherwise(0.0).alias("g")), "toxicity_features")
    telling = found.where((F.col("g") >= LEAST_G) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("g"), "feature").limit(MOST_ENTRIES)
    entries = {r["feature"]: log(r["ratio"]) for r in telling.collect()}
    # longer beginnings and whole words under a telling beginning: some are innocent
    under = found.where(F.substring("feature", 1, PREFIXES[0]).isin(sorted({f[: PREFIXES[0]] for f in entries})))
    for r in under.orderBy(F.desc("g"), "feature").limit(10 * MOST_ENTRIES).collect():
        if any(r["feature"].startswith(e) for e in features(r["feature"].rstrip("$"))[1:] if e in entries):
            entries.setdefault(r["feature"], max(0.0, log(r["ratio"])))
    entries = seeds | entries
    measured = sample.mapInArrow(_measured(entries), "toxic int, total double, words long")
    return Model(entries, _logistic(np.array([(r["toxic"], r["total"], r["words"]) for r in measured.collect()], float)))


def _measured(entries: dict[str, float]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(entries), Machine()
        for batch in batches:
            got = [measures(x.as_py() or "", lexicon, machine) for x in batch.column("text")]
            yield pa.record_batch([batch.column("toxic"), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())], names=["toxic", "total", "words"])

    return run


def _logistic(rows: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    y, total, words = rows.T
    x = np.column_stack([np.ones(len(y)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 20))])
    w, ridge = np.zeros(3), np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def add_score(df: DataFrame, model: Model, text: str = "text", name: str = "score", clauses: str = "n_clauses") -> DataFrame:
    """``df`` with the score and the number of matched clauses."""
    kept = [c for c in df.columns if c not in (name, clauses)]
    rows = df.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.DoubleType()), T.StructField(clauses, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(model.entries), Machine()
        for batch in batches:
            got = [measures(x.as_py() or "", lexicon, machine) for x in batch.column("_text")]
            scores = pa.array([model.score(x[0], x[1]) for x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores, pa.array([x[2] for x in got], pa.int64())], [*kept, name, clauses])

    return rows.mapInArrow(run, schema)
