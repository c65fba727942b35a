"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word shingles; its sketch is the K least hashes of them. Two documents are linked if
the Jaccard similarity of their sets reaches the threshold; components of links are groups, and a group keeps its
document with the smallest id.

1. Equal sets fall together by their size and fingerprint, so copies are one class however many there are.
2. Inverted lists of runs of RUN retained values next to each other: those of a linked pair lie side by side in both sketches wherever the
   union sketch has RUN shared values in a row, which fails by chance about once in a million pairs at the threshold itself and far less above it.
   Runs stay rare where single shingles are common, so lists don't grow with the corpus. Sets of at most K values, whose
   sketch is the whole set, use single values instead, and only the rarest that any linked set must share one of (for sure).
3. Lists of at most LIST members give all their pairs. A longer list is a large group or a passage that many share. All members of long lists
   are compared by whole sets: linked sets share one of the first size - least overlap + 1 values, rarest first, so lists by these values
   hold all pairs. Lists within one component are left out. A group's lists have much the same members, so those with the same most central
   member (in most lists) are joined to one, which is cut into blocks of about BLOCK values. Every block meets every other in a task of its own, which
   counts the common values of all pairs and passes on no more links than join components. So no pair is a row, and none is left out.
4. In short lists the union sketch estimates the similarity, and what is clearly below is dropped.
5. Exact Jaccard on the full sets verifies these: first a pair per class with its best neighbour, then only pairs whose ends these links left in
   different components.

Hashes have 64 bits. Defined cases: NULL and empty texts, or texts without words, have an empty set and no link; a text with fewer words than a
shingle is one shingle; rows that share an id are grouped by their own texts, and groups with one smallest id are one; a NULL id is never
linked, has a NULL component and is kept.
Texts are read whole. Extra columns are left to the caller. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlogs.stage import materialise

K = 40
RUN = 3
#: Sets that a linked partner's sketch holds whole: 80 % of K.
SMALL = 32
LIST = 32
#: Values of the sets in a block, and cells of the matrices that compare two blocks.
BLOCK = 1 << 19
CELLS = 1 << 20
#: Least similarity, in hundredths.
SIMILAR = 80
#: Estimates below this are dropped: at the threshold itself, 17 or fewer hits of K come up twice in ten million pairs.
LEAST_ESTIMATE = 0.45
#: Bits of the filter of the ids whose texts are read again: 8 MB, whatever their number.
FILTER_BITS = 1 << 26
#: Texts hashed at once.
SLICE_BYTES = 4 << 20

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z are lower-cased; words stand between ASCII white space."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))))
    ends = words.offsets.to_numpy() - words.offsets[0].as_py()
    flat = words.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    word = hashes[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    empty = xxhash.xxh64_intdigest("")
    n = len(word) - size + 1
    whole = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        whole = _mixed(whole + word[k : k + n]) if n > 0 else whole
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        if end - start >= size:
            yield np.unique(whole[start : end - size + 1])
        elif end == start or (end - start == 1 and word[start] == empty):
            yield whole[:0]
        else:  # fewer words: all of them are one shingle
            x = np.full(1, end - start, np.uint64)
            for w in word[start:end]:
                x = _mixed(x + w)
            yield x


def _over(fields: str, row: Callable[[np.ndarray], tuple], size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow on (id, text) that puts ``row`` of the set in the text's place."""
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*((f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(SLICE_BYTES, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                # a copy: string functions may misread a slice's offsets
                part = batch.take(pa.array(np.arange(at, min(at + step, batch.num_rows))))
                rows = [row(s) for s in sets(part.column("text"), size)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], list(names))

    return run


_SIGN = np.uint64(1 << 63)


def _signed(s: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the unsigned ones."""
    return (s ^ _SIGN).view(np.int64)


def _sketch(s: np.ndarray) -> tuple:
    mixed = _mixed(s + np.uint64(0x9E3779B97F4A7C15))
    return len(s), int(np.add.reduce(mixed, dtype=np.uint64).view(np.int64)) if len(s) else 0, int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0, _signed(s[:K])


def _set(s: np.ndarray) -> tuple:
    return int(np.add.reduce(_mixed(s + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64).view(np.int64)) if len(s) else 0, _signed(s)


def estimate(a: Column, b: Column) -> Column:
    """Similarity by two sketches: the share of their union's K least values that stands in both."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def lists(classes: DataFrame) -> DataFrame:
    """Inverted lists with two members or more: key, class, its size, and how many keys no other class has."""
    run = F.transform(F.sequence(F.lit(1), F.size("sketch") - RUN + 1), lambda i: F.xxhash64(F.slice("sketch", i, F.lit(RUN))))
    # the largest shuffle: nothing but class and key
    shared = _shared(classes.where(F.col("n") > SMALL).select("cid", F.explode(run).alias("key"))).select("cid", "key")
    counted = shared.groupBy("cid").agg(F.count(F.lit(1)).alias("c")).join(classes.select("cid", "n"), "cid")
    counted = counted.select("cid", "n", (F.least(F.lit(K), F.col("n")) - RUN + 1 - F.col("c")).alias("alone"))
    shared = shared.join(counted, "cid").select("key", "cid", "n", "alone")
    # small sets, and those that a small one may be linked with
    values = classes.where(F.col("n") <= K).select("cid", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("key"))
    found = _shared(values).groupBy("cid", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("x"))  # at most K values
    alone = F.col("s") - F.size("x")
    needed = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1 - alone).cast("int")
    small = found.select("cid", "n", alone.alias("alone"), F.explode(F.slice("x", F.lit(1), needed)).alias("x"))
    return shared.unionByName(small.select(F.xxhash64("x.key", F.lit(1)).alias("key"), "cid", "n", "alone"))


def _shared(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    return rows.join(counts, "key")


def measured(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets' intersection and union."""
    a = full.select(F.col("cid").alias("a"), F.col("items").alias("items_a"))
    b = full.select(F.col("cid").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("items_a") + F.size("items_b")).alias("sum"))
    return rows.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("union"))


def _similar(least: int) -> Column:
    return 100 * F.col("both") >= least * F.col("union")


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    return measured(pairs, full).where(_similar(SIMILAR)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached, for ids with an edge.

    Each round takes the least label of the neighbours, then the label's own label, so long chains shrink by half; labels only
    fall, and their sum tells when all have settled. Each round is written, so its lineage is short.
    """
    edges = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        labels_ = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        upper = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        labels = materialise(labels_.join(upper, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("cid").alias("a"), F.col("sketch").alias("sketch_a"))
    b = classes.select(F.col("cid").alias("b"), F.col("sketch").alias("sketch_b"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("estimate", estimate(F.col("sketch_a"), F.col("sketch_b")))
    return rows.where(F.col("estimate") >= LEAST_ESTIMATE).groupBy("a", "b").agg(F.max("estimate").alias("estimate"))


def _of_short_lists(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Estimated pairs of the lists with at most LIST members."""
    other = found.select("key", F.col("cid").alias("b"), F.col("n").alias("nb"))
    rows = found.select("key", F.col("cid").alias("a"), F.col("n").alias("na")).join(other, "key")
    rows = rows.where((F.col("a") < F.col("b")) & _sizes_fit(F.col("na"), F.col("nb")))
    return _estimated(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap")), classes)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component."""
    a, b = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    rows = pairs.join(a, "a", "left").join(b, "b", "left")
    return rows.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _links_of_short_lists(pairs: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links, and the components that most of them give."""
    best = pairs.groupBy(F.col("b")).agg(F.max(F.struct("estimate", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    first = materialise(verified(best, full), "links")
    labels = components(first)
    rest = _apart(pairs.join(best, ["a", "b"], "left_anti"), labels)
    return first.unionByName(materialise(verified(rest, full), "links")), labels


def _size_class(n: Column) -> Column:
    """Sizes by steps of 26 per cent: those of linked sets are in one class or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(1.26)))


def _links_of_prefixes(members: DataFrame, full: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds links between ``members`` of different components, until no two linked ones are apart, by prefixes of their whole sets.

    Components (``labels``) only leave pairs out, so those of some links will do.
    """
    values = full.join(members, "cid", "left_semi").select("cid", F.size("items").alias("n"), F.explode("items").alias("key"))
    values = _shared(values).groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("x"))
    alone = F.col("n") - F.size("x")
    spare = (F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) - alone).cast("int")
    shared = F.transform("x", lambda v: v["key"])
    sets_ = materialise(values.where(spare >= 0).select("cid", "n", spare.alias("spare"), shared.alias("items")), "prefixes")
    # linked sets share one of the first values, rarest first, and a class of sizes
    grown = sets_.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    grown = grown.select("cid", "n", "component", F.explode(F.slice("items", F.lit(1), F.col("spare") + 1)).alias("value"))
    grown = grown.withColumn("sizes", F.explode(F.array(_size_class(F.col("n")), _size_class(F.col("n")) + 1)))
    grown = materialise(grown.select(F.xxhash64("value", "sizes").alias("key"), "cid", "n", "component"), "prefix_lists")
    # lists within one component have nothing to add
    between = grown.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    held = materialise(grown.join(between.select("key"), "key", "left_semi"), "prefix_lists")
    # a group's lists have much the same members: lists with the same most central one are compared as one, which holds all their pairs
    central = held.groupBy("cid").agg(F.count(F.lit(1)).alias("lists"))
    leaders = held.join(central, "cid").groupBy("key").agg(F.max(F.struct("lists", (-F.col("cid")).alias("m"))).alias("x"))
    led = held.join(leaders.select("key", (-F.col("x.m")).alias("leader")), "key").select("leader", "cid", "n", "component").distinct()
    parts = F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts")
    loads = led.groupBy("leader").agg(parts, F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    led = materialise(led.join(loads.select("leader", "parts"), "leader"), "prefix_lists")
    if led.isEmpty():
        return links
    # blocks of bounded size, each compared with each other one: no pair is a row
    own = led.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("leader", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", "component")
    found = met.join(sets_.select("cid", "n", "items"), "cid").groupBy("leader", "i", "j").applyInArrow(_linked, "a long, b long")
    return links.unionByName(materialise(found, "links"))


def _linked(block: pa.Table) -> pa.Table:
    """Links between sets of part ``i`` and part ``j``: as many as join the components that all linked pairs join."""
    block = block.select(["i", "j", "part", "cid", "component", "n", "items"]).combine_chunks()
    part, cid, n = (block.column(c).to_numpy() for c in ("part", "cid", "n"))
    lengths = pc.list_value_length(block.column("items")).to_numpy()
    codes = np.unique(pc.list_flatten(block.column("items")).to_numpy(), return_inverse=True)[1]
    label = np.unique(block.column("component").to_numpy(), return_inverse=True)[1]
    rows, others = (np.flatnonzero(part == block.column(c)[0].as_py()) for c in ("i", "j"))
    owner = np.repeat(np.arange(len(cid)), lengths)
    counts = np.bincount(codes, minlength=1)
    # frequent values are counted by a matrix product, the others by their lists
    frequent = np.argsort(-counts, kind="stable")[: CELLS // len(cid)]
    frequent = frequent[counts[frequent] * 16 >= len(cid)]
    place = np.full(len(counts), -1)
    place[frequent] = np.arange(len(frequent))
    held = np.zeros((len(cid), len(frequent)), np.float32)
    often = place[codes] >= 0
    held[owner[often], place[codes[often]]] = 1
    rare = ~often & (counts[codes] > 1)
    codes, owner = codes[rare], owner[rare]
    first = np.searchsorted(owner, np.arange(len(cid) + 1))
    column = np.full(len(cid), -1)
    column[others] = np.arange(len(others))
    listed = column[owner] >= 0
    order = np.argsort(codes[listed], kind="stable")
    members = column[owner[listed]][order]
    length = np.bincount(codes[listed], minlength=len(counts))
    start = np.cumsum(length) - length
    steps = np.add.reduceat(np.r_[length[codes], 0], first[:-1]) * (first[1:] > first[:-1])
    a, b = [], []
    cost = np.cumsum(steps[rows] + len(others)) // CELLS
    for at in np.split(rows, np.flatnonzero(np.diff(cost)) + 1):
        both = (held[at] @ held[others].T).astype(np.float64)
        tokens = np.concatenate([np.arange(first[r], first[r + 1]) for r in at])
        line = np.repeat(np.arange(len(at)), first[at + 1] - first[at])
        many = length[codes[tokens]]
        cells = np.repeat(start[codes[tokens]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = np.repeat(line * len(others), many) + members[cells]
        both += np.bincount(cells, minlength=both.size).reshape(both.shape)
        similar = 100 * both >= SIMILAR * (n[at][:, None] + n[others][None, :] - both)
        for k in np.flatnonzero(similar.any(axis=1)):
            met = others[similar[k]]
            apart = met[label[met] != label[at[k]]]
            if len(apart):
                joined, one = np.unique(label[apart], return_index=True)
                a.extend(np.minimum(cid[apart[one]], cid[at[k]]))
                b.extend(np.maximum(cid[apart[one]], cid[at[k]]))
                label[np.isin(label, joined)] = label[at[k]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def perhaps_in(rows: DataFrame, ids: DataFrame, name: str = "id", *, inside: bool = True) -> DataFrame:
    """``rows`` (with ``name``) without most of those whose id isn't among ``ids``, or else those left out: one bit for each id, in pieces of 4 kB.

    The filter has FILTER_BITS at most, so it is broadcast; an exact join follows. It spares the shuffle of texts while ids are fewer than bits.
    """
    bit = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    pieces = ids.select(F.shiftright(bit, 15).alias("_piece"), bit.bitwiseAND(F.lit(32767)).alias("_bit"))
    pieces = pieces.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = bit.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_piece", F.shiftright(bit, 15)).join(F.broadcast(pieces), "_piece", "inner" if inside else "left")
    return found.where(F.coalesce(F.getbit(byte, place % 8), F.lit(0)) == int(inside)).select(rows.columns)


_perhaps_in = perhaps_in


def _freed(df: DataFrame) -> None:
    """Lets go of the shuffle files of finished tables: Spark deletes them once the driver has collected their plans."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 2, *, exact: bool = False) -> DataFrame:
    """A row per row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept``. ``exact`` is for callers of before: all long lists are now."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    fields = "id long, n long, fp long, fq long, sketch array<long>"
    hashed = materialise(rows.mapInArrow(_over(fields, _sketch, shingle), fields), "sketches")
    own = hashed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = own.groupBy("fp", "fq", "n").agg(F.min(F.struct("id", "sketch")).alias("x"))
    classes = materialise(classes.select(F.col("x.id").alias("cid"), "fp", "fq", "n", "x.sketch"), "classes")
    found = materialise(lists(classes), "lists")
    lengths = found.groupBy("key").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") > 1)
    found = materialise(found.join(lengths, "key"), "lists")
    _freed(docs)
    pairs = materialise(_of_short_lists(found.where(F.col("length") <= LIST), classes), "pairs")
    long = found.where(F.col("length") > LIST).drop("length")
    # every member of a long list stays in it: none is left to its short lists alone
    long = materialise(long, "long_lists")
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(long.select("cid")).distinct()
    fields = "cid long, fp long, items array<long>"
    needed = materialise(needed, "needed")
    full = perhaps_in(rows, needed).join(needed, "id").select("id", "text").mapInArrow(_over(fields, _set, shingle), fields)
    full = materialise(full.dropDuplicates(["cid", "fp"]), "sets")
    _freed(docs)
    links, labels = _links_of_short_lists(pairs, full)
    if not long.isEmpty():
        members = materialise(long.select("cid").distinct(), "members")
        links = _links_of_prefixes(members, full, links, labels)
    labels = components(links)
    member = classes.select("cid", "fp", "fq", "n").join(labels, F.col("cid") == F.col("id"), "left").select("fp", "fq", "n", F.coalesce("component", "cid").alias("component"))
    out = hashed.select("id", "n", "fp", "fq").join(member, ["fp", "fq", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
