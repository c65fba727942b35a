"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, made from its code point alone. An n-gram of SIZE letters is bound
into one vector: the product of its letters' vectors, each rotated by its place from the end. A text's profile bundles (adds) the
vectors of all its n-grams; a language's prototype bundles the profiles, brought to one length, of texts known to be in it. A text gets the
language whose prototype has the greatest cosine with its profile, both taken from the mean of the prototypes.

Letters are what Unicode calls so, in lower case; whatever stands between them counts as one blank, also before the first
and after the last. A letter's vector takes 1 kB, a language's 8 kB in every task; more than MOST_LANGUAGES languages are refused, so this is bounded.
Prototypes are learned from about FIT_ROWS rows of each language, chosen by a hash of id and text, from all over the table; rows that are held out,
and rows without a language or a letter, aren't learned from.

Defined cases: a NULL or empty text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be learned; of
languages with equal cosines the first by code point wins; an empty string is a language like others. Rows with a NULL id are
neither held out nor learned from. Repeated rows are learned from together, or not at all. Texts are read whole, in blocks of their distinct n-grams. Extra
columns are kept, of clashing names the computed one stays, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlogs.stage import materialise

DIMENSIONS = 1024
SIZE = 3
#: Rows of each language that are learned from, about.
FIT_ROWS = 3_000
MOST_LANGUAGES = 10_000
#: Profiles are brought to this length before they are added, as whole numbers: sums don't depend on their order.
UNIT = 1_000_000
#: Distinct n-grams bound at once, letters' vectors remembered by a worker, and partitions of the learning rows.
BLOCK = 4_096
MEMORY = 16_384
PARTS = 64
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def letter_vector(code: int) -> np.ndarray:
    """The signs of a letter: one mixed 64-bit number for every 64 of them."""
    x = np.uint64(code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (2 * np.unpackbits(x.view(np.uint8)).astype(np.int8) - 1).astype(np.int8)


class Profiles:
    """Profiles of texts; remembers letters' vectors, rotated for each place of an n-gram."""

    def __init__(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.rotated = np.zeros((SIZE, 0, DIMENSIONS), np.int8)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """Places of the letters' vectors, made where they are new."""
        new = np.setdiff1d(codes, self.codes)
        if len(new):
            known = new if len(self.codes) + len(new) > MEMORY else np.concatenate([self.codes, new])
            if len(known) == len(new):
                known = np.unique(codes)
            self.codes = np.sort(known)
            vectors = np.stack([letter_vector(int(c)) for c in self.codes])
            self.rotated = np.stack([np.roll(vectors, SIZE - 1 - k, axis=1) for k in range(SIZE)])
        return np.searchsorted(self.codes, codes)

    def of(self, text: str) -> np.ndarray | None:
        """Sum of the vectors of the text's n-grams, None without a letter."""
        words = _LETTERS.findall(text.lower())
        if not "".join(words).isalpha():  # numbers such as a raised two aren't letters
            words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
        if not words:
            return None
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        keys = np.zeros(len(codes) - SIZE + 1, np.int64)
        for k in range(SIZE):
            keys = (keys << 21) | codes[k : len(codes) - SIZE + 1 + k]
        grams, counts = np.unique(keys, return_counts=True)
        profile = np.zeros(DIMENSIONS)
        for at in range(0, len(grams), BLOCK):
            part = grams[at : at + BLOCK]
            letters = np.stack([(part >> (21 * (SIZE - 1 - k))) & 0x1FFFFF for k in range(SIZE)])
            distinct, inverse = np.unique(letters, return_inverse=True)
            places = self._places(distinct)[inverse.reshape(letters.shape)]
            bound = self.rotated[0][places[0]]
            for k in range(1, SIZE):
                bound *= self.rotated[k][places[k]]
            profile += counts[at : at + BLOCK].astype(np.float32) @ bound.astype(np.float32)
        return profile


class Prototypes:
    """Languages, by code point, with their prototypes."""

    def __init__(self, sums: dict[str, np.ndarray]) -> None:
        self.names = sorted(sums)
        whole = np.array([sums[n] for n in self.names], float).reshape(len(self.names), DIMENSIONS)
        whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)
        #: of one language alone, there is no other to tell it from
        self.mean = whole.mean(axis=0) if len(self.names) > 1 else np.zeros(DIMENSIONS)
        self.vectors = whole - self.mean
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)

    def nearest(self, profile: np.ndarray | None) -> tuple[str, float]:
        """The language with the greatest cosine, and that cosine where it is above 0."""
        if profile is None or not self.names:
            return UNKNOWN, 0.0
        own = profile / max(np.linalg.norm(profile), 1e-9) - self.mean
        cosines = self.vectors @ (own / max(np.linalg.norm(own), 1e-9))
        best = int(np.argmax(np.round(cosines, 9)))
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the profiles of each language in a partition."""
    profiles, sums = Profiles(), {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            profile = profiles.of(text.as_py())
            if profile is not None:
                unit = np.rint(profile * (UNIT / max(np.linalg.norm(profile), 1e-9))).astype(np.int64)
                sums[lang.as_py()] = sums.get(lang.as_py(), 0) + unit
    for lang, vector in sums.items():
        yield pa.record_batch([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(vector)], names=["lang", "at", "x"])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Prototypes:
    """Prototypes from about ``rows`` rows of each language that aren't held out."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Prototypes({})
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["n"])) for r in sizes], "lang string, share double")
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(share), "lang").where(dealt < F.col("share")).select("lang", "text")
    # bounded, and few where the table has many parts: each part gives one sum for each language
    sums = materialise(chosen.repartition(PARTS).mapInArrow(_sums, "lang string, at long, x long").groupBy("lang", "at").agg(F.sum("x").alias("x")), "language_sums")
    vectors: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS numbers for each language
        vectors.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["x"]
    return Prototypes(vectors)


def add_language(df: DataFrame, prototypes: Prototypes, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with each text's language and its cosine (0 to 1)."""
    kept = [c for c in df.columns if c not in (name, score)]
    rows = df.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            found = [prototypes.nearest(profiles.of(x.as_py() or "")) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*kept, name, score])

    return rows.mapInArrow(run, schema)
