"""Token ids of documents as binary files: tokenise, code in blocks, read back.

Rows are range-partitioned and sorted by id, so files in the order of their names hold ids in ascending
order of documents. A file is a run of entries: an index of the documents (or the parts of one) whose ids the next
block holds, then the block (see ``idcoder``). Both have checksums, blocks can be decoded alone, and a document may
span blocks. Its start in the whole output is its start in the file plus the ids of the files before.

Defined cases: a NULL text is an empty one and has the end id only; NULL ids come first, equal ids follow their
texts; texts are coded whole at any length. Extra columns are left out. An empty table gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlogs.llm import bytefiles, idcoder

END_ID = 0
#: Words whose ids a worker remembers; beyond, it starts anew.
MEMORY = 800_000
#: Stands for a text's first word.
_FIRST = ""
_INDEX = struct.Struct("<4sIIII")
INDEX_MAGIC = b"IDX1"
#: id, whether the id is NULL (1), whether the document goes on in the next block (2); ids in this block
_ENTRY = np.dtype([("id", "<i8"), ("flags", "<u4"), ("n", "<u4")])
#: Rows tokenised at once.
SLICE_CHARS = 2_000_000


class Words:
    """Token ids of texts by the ids of their words.

    A byte-level tokenizer splits before a space that a word follows, whatever stands around it, so ``word``
    and `` next`` are encoded apart and remembered. New words are encoded together and told apart by the bytes that
    their ids stand for. A text in which other white space touches a space is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a byte-level token is written with a character per byte
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.known = _Places()
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's ending with END_ID, and how many each text has."""
        if len(self.lengths) > MEMORY:
            self._forget()
        # of each text its first word or all of it, whose place is -2 - its number, and then its words
        pieces: list[str] = []
        places: list[np.ndarray] = []
        place = self.known.__getitem__
        for number, text in enumerate(texts):
            split = text.split(" ")
            first = split[0]
            split[0] = _FIRST
            now = np.fromiter(map(place, split), np.int32, len(split))
            if (len(split) > 1 and first.rstrip() != first) or (len(split) > 1 and (not first or now[1:].min() < 0)):
                first, now = text, now[:1]
            now[0] = -2 - number
            pieces.append(first)
            places.append(now)
        begins = np.cumsum([0, *map(len, places[:-1])])
        self._remember()
        encoded = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n_known = len(self.lengths)
        lengths = np.concatenate([self.lengths, [len(e) for e in encoded]])
        flat = np.concatenate([self.flat, *encoded])
        where = np.concatenate(places)
        where = np.where(where < 0, n_known - 2 - where, where)
        n, starts = lengths[where], np.cumsum(lengths) - lengths
        total = np.add.reduceat(n, begins)
        out = np.full(int(n.sum()) + len(texts), END_ID, np.uint32)
        held = np.ones(len(out), bool)
        held[np.cumsum(total + 1) - 1] = False
        out[held] = flat[np.repeat((starts[where] - np.cumsum(n) + n).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)]
        return out, total + 1

    def _remember(self) -> None:
        new, self.known.new = self.known.new, []
        if not new:
            return
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(new)], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, np.int32)
        word_ends = np.cumsum([1 + len(w.encode()) for w in new])
        id_ends = np.cumsum(self.bytes_of[ids])
        upto = np.searchsorted(id_ends, word_ends, "right")
        if (id_ends[upto - 1] != word_ends).any():
            raise ValueError("the tokenizer joins words: it isn't byte-level")
        self.lengths = np.concatenate([self.lengths, np.diff(upto, prepend=0)])
        self.flat = np.concatenate([self.flat, ids])


class _Places(dict):
    """Places of the ids of words after a space, in order of appearance; -1 for what can't be split off."""

    def __init__(self):
        super().__init__({_FIRST: -1})
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, word: str) -> int:
        if word.strip() != word:
            self[word] = -1
            return -1
        self.new.append(word)
        self[word] = place = self.size
        self.size += 1
        return place


@cache
def _words(path: str) -> Words:
    return Words(path)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    held, size, keys = [], 0, []
    for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
        text = text.as_py() or ""
        keys.append(key)
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield keys, held
            held, size, keys = [], 0, []
    if held:
        yield keys, held


def _entry(docs: list[tuple[int, int, int]], ids: np.ndarray, file_no: int) -> bytes:
    table = np.array(docs, _ENTRY).tobytes()
    # a last zero byte lets the writer cut here
    return _INDEX.pack(INDEX_MAGIC, file_no, len(docs), len(ids), zlib.crc32(table)) + table + idcoder.encode(ids) + b"\0"


def _entries(batches: Iterable[pa.RecordBatch], path: str, block_ids: int) -> Iterator[bytes]:
    file_no = TaskContext.get().partitionId()
    docs: list[tuple[int, int, int]] = []
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for keys, texts in _slices(batch):
            ids, lengths = _words(path).encode(texts)
            at = 0
            for key, n in zip(keys, lengths.tolist(), strict=True):
                null = int(key is None)
                while n:
                    now = min(n, block_ids - size)
                    docs.append((key or 0, null | (2 if now < n else 0), now))
                    held.append(ids[at : at + now])
                    at, n, size = at + now, n - now, size + now
                    if size == block_ids:
                        yield _entry(docs, np.concatenate(held), file_no)
                        docs, held, size = [], [], 0
    if docs:
        yield _entry(docs, np.concatenate(held), file_no)


def write(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None, block_ids: int = idcoder.BLOCK_IDS) -> None:
    """Writes the ids below ``path``; ``files``: number of files, by default that of shuffle partitions."""
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(files, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in bytefiles.cut(_entries(batches, tokenizer, block_ids)):
            yield pa.record_batch([pa.array([row], pa.binary())], names=["bytes"])

    bytefiles.write(rows.mapInArrow(run, "bytes binary"), path)


def documents(content: memoryview) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """File number, document id, start in the file and ids of each document of a file, in order."""
    at, start, held = 0, 0, []
    while at < len(content):
        magic, file_no, n_docs, n_ids, crc = _INDEX.unpack_from(content, at)
        at += _INDEX.size
        table = content[at : at + n_docs * _ENTRY.itemsize]
        if magic != INDEX_MAGIC or zlib.crc32(table) != crc:
            raise ValueError("an index's checksum doesn't fit")
        at += len(table)
        size = idcoder.block_size(content[at:])
        ids = idcoder.decode(content[at : at + size])
        at += size + 1
        if len(ids) != n_ids:
            raise ValueError("a block doesn't fit its index")
        used = 0
        for key, flags, n in np.frombuffer(table, _ENTRY).tolist():
            held.append(ids[used : used + n])
            used += n
            if not flags & 2:
                whole = np.concatenate(held) if len(held) > 1 else held[0]
                yield file_no, None if flags & 1 else key, start, whole
                start, held = start + len(whole), []
    if held:
        raise ValueError("the last document isn't whole")


_OUT = pa.schema([("file_no", pa.int32()), ("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` (long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for file_no, key, start, ids in documents(memoryview(content.as_buffer())):
                    held.append((file_no, key, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int64) if with_ids else None))
                    size += len(ids) if with_ids else 1
                    if size >= 1 << 20 or len(held) >= 10_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    rows = bytefiles.read(spark, path).mapInArrow(run, "file_no int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long, ids array<long>")
    return rows if with_ids else rows.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_no", "doc_id", "start_in_file", "n_tokens", "ids_crc32", "ids"])


def with_starts(docs: DataFrame) -> DataFrame:
    """Adds ``start``. The table of file sizes has a row per file, so its window is small; ``docs`` is read twice."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = docs.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    files = files.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return docs.join(files, "file_no").withColumn("start", F.col("_before") + F.col("start_in_file")).drop("_before")
