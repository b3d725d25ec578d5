"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct k-word shingles (words lower-cased in A-Z, cut at ASCII white space; with fewer than
k words the whole sequence is one shingle). Its signature has CHUNKS * WIDTH symbols of 14 bits: the low bits of that
many minima. By pigeonhole, signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols agree in some chunk
up to ERRORS symbols, so each chunk is indexed with every choice of ERRORS symbols left out: all pairs within that
distance share a key. Pairs beyond it are found as long as one chunk agrees: at similarity 0.8 the chance to miss a
pair is (1 - 0.737)**9, or 6 in a million, and it falls fast above.

Documents with equal sets are one vertex. Candidates come in two rounds, so that a large group of near copies isn't
expanded into all its pairs. First each key's least document, its pivot, is confirmed against the others of the key,
and the links found are joined into components. Then each pivot with the documents of its keys is a family, which
holds every pair that shares one of those keys: families still in several components are compared on full sets (64-bit
shingle hashes) inside tasks, in pairs of blocks of a bounded number of documents and of shingles, and only links that
join two components of the task leave it. Pairs within a component are known to be connected: a family's greatest component
has blocks of its own, which meet the blocks of the others but not each other. So a document of it is sent once for each
block of the others, of which there is mostly one.

Null or empty texts, and texts of white space, have the empty set: they link with nothing and are kept. Rows with a
null id link only through an exact copy (an equal set) with an id: without one they join no others and have no
component; they are not kept. Rows that share an id are one document. Extra columns of the input are dropped from the result of `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Tables, small_batches
from ._words import BLANKS, U64, mix64, odd_constants, shingles, word_batches
from .components import components

CHUNKS, WIDTH, ERRORS = 9, 5, 1
SYMBOLS = CHUNKS * WIDTH
#: Documents of a family, and shingles of theirs, that are compared with as many others in one task; a longer text is taken whole.
FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 1_000_000
#: Shingles held by one in OFTEN of a task's documents are counted by matrix products, of matrices with so many cells.
OFTEN, PRODUCT_CELLS = 10, 4_000_000
#: Ids that are broadcast to pick the texts whose sets are needed; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
FEATURES = "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>"
SETS = "doc_id long, shingles array<long>"
SYMBOL_BITS = 14


def _distinct(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of the texts, one text's after the other's, and how many each has, piece by piece."""
    for _, _, hashes, counts in word_batches(column, BLANKS):
        runs, number = shingles(hashes, counts, k)
        sets = [np.unique(part) for part in np.split(runs, np.cumsum(number)[:-1])]
        yield (np.concatenate(sets) if sets else np.empty(0, U64)), np.array([len(s) for s in sets], np.int64)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbols of each set; `starts` are the places where the (non-empty) sets begin in `values`."""
    factors, adds = odd_constants(SYMBOLS, 1), odd_constants(SYMBOLS, 2)
    out = np.empty((len(starts), SYMBOLS), U64)
    for j in range(SYMBOLS):
        out[:, j] = mix64(np.minimum.reduceat(values * factors[j] + adds[j], starts))
    return out & U64((1 << SYMBOL_BITS) - 1)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Per signature, a key for each chunk and symbol of it left out."""
    factors = odd_constants(SYMBOLS, 3)
    salt = odd_constants(SYMBOLS, 4)
    terms = mix64((symbols + U64(1)) * factors).reshape(-1, CHUNKS, WIDTH)
    whole = terms.sum(axis=2, keepdims=True, dtype=U64)
    return mix64((whole - terms).reshape(-1, SYMBOLS) + salt)


def _feature_batches(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for values, number in _distinct(batch.column(1), k):
            full = np.flatnonzero(number)
            starts = (np.cumsum(number) - number)[full]
            symbols = signatures(values, starts) if len(full) else np.empty((0, SYMBOLS), U64)
            prints = np.zeros((2, len(number)), U64)
            if len(full):
                prints[0, full] = np.add.reduceat(mix64(values), starts)
                prints[1, full] = np.add.reduceat(mix64(values ^ U64(0x5555)), starts)
            empty = number == 0
            ends = np.cumsum(~empty)
            offs = lambda w: pa.array(np.concatenate([[0], ends * w]).astype(np.int32))
            longs = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(number)).cast(pa.int64()), pa.array(number), longs(prints[0]), longs(prints[1]),
                    pa.ListArray.from_arrays(offs(SYMBOLS), longs(index_keys(symbols))),
                ],
                names=["doc_id", "n_shingles", "fp1", "fp2", "keys"],
            )
            at += len(number)


def _set_batches(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for values, number in _distinct(batch.column(1), k):
            offs = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(number)).cast(pa.int64()), pa.ListArray.from_arrays(offs, pa.array(values.view(np.int64)))], names=["doc_id", "shingles"]
            )
            at += len(number)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents whose ids are given."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return texts.mapInArrow(lambda it: _set_batches(k, it), SETS)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common * 100 >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def _in_common(sets: list[np.ndarray], sizes: np.ndarray, asked: np.ndarray) -> Iterator[np.ndarray]:
    """For each of the sets asked for, how many elements it has in common with every set.

    Elements that many sets hold are counted by matrix products over blocks of them, the others by going through their
    holders; both are exact.
    """
    n = len(sets)
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    held = np.repeat(np.arange(n), sizes)[order]
    flat = flat[order]
    del order
    begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(begins, len(flat)))
    element = np.repeat(np.arange(len(begins)), counts)
    often = counts * OFTEN >= n
    common = np.zeros((len(asked), n), np.int32)
    shared = often[element]
    row, column = held[shared], (np.cumsum(often) - 1)[element[shared]]
    many = int(often.sum())
    width = max(1, min(many, PRODUCT_CELLS // n))
    for c in range(0, many, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        has = np.zeros((n, width), np.float32)
        has[row[lo:hi], column[lo:hi] - c] = 1
        common += (has[asked] @ has.T).astype(np.int32)
    del shared
    rest = np.flatnonzero((~often & (counts > 1))[element])
    rest = rest[np.argsort(held[rest], kind="stable")]
    ends = np.searchsorted(held[rest], asked, "right")
    for i, (lo, hi) in enumerate(zip(np.searchsorted(held[rest], asked), ends, strict=True)):
        own = element[rest[lo:hi]]
        spans = counts[own]
        at = np.repeat(begins[own] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        yield common[i] + np.bincount(held[at], minlength=n)


class _Family:
    """The documents of one task's pair of blocks, compared across components."""

    def __init__(self):
        self.ids, self.labels, self.sides, self.sets = [], [], [], []

    def links(self, percent: int, same: bool) -> list[tuple[int, int]]:
        """Links that join components here; between the two blocks, or within the one if they are the same."""
        n = len(self.ids)
        if n < 2 or len(set(self.labels)) < 2:
            return []
        root = {x: x for x in self.labels}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sizes = np.array([len(s) for s in self.sets], np.int64)
        sides = np.array(self.sides)
        # The component with most documents is gone through last, when few of its pairs are still open.
        labels = np.array(self.labels)
        _, code, often = np.unique(labels, return_inverse=True, return_counts=True)
        main = often.argmax()
        asked = np.flatnonzero((code != main) & (sizes > 0))
        out = []
        for i, common in zip(asked.tolist(), _in_common(self.sets, sizes, asked), strict=True):
            near = (common * 100 >= percent * (sizes + sizes[i] - common)) & ((code == main) | (np.arange(n) > i))
            if not same:
                near &= sides != sides[i]
            for j in np.flatnonzero(near).tolist():
                a, b = top(self.labels[i]), top(self.labels[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((self.ids[i], self.ids[j]))
        return out


def _family_links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, one, other, block, id, component, shingles), a task's together -> links (a, b)."""
    key, held = None, _Family()
    pack = lambda links: pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])
    for batch in batches:
        head = [batch.column(i).to_numpy() for i in range(6)]
        shingle = batch.column(6)
        offs, flat = shingle.offsets.to_numpy(), shingle.values.to_numpy().view(U64)
        for r in range(batch.num_rows):
            now = (head[0][r], head[1][r], head[2][r])
            if now != key:
                if key is not None and (found := held.links(percent, key[1] == key[2])):
                    yield pack(found)
                key, held = now, _Family()
            held.ids.append(int(head[4][r]))
            held.labels.append(int(head[5][r]))
            held.sides.append(int(head[3][r]))
            held.sets.append(flat[offs[r] : offs[r + 1]].copy())
    if key is not None and (found := held.links(percent, key[1] == key[2])):
        yield pack(found)


def _family_rows(first: DataFrame, joined: DataFrame, sizes: DataFrame, tables: Tables) -> DataFrame:
    """(pivot, one, other, block, id, component) of families of three documents or more in several components.

    Members and family sizes are tables, so that the join of the two can be split where a family is large.
    """
    members = first.select(F.col("a").alias("pivot"), F.col("b").alias("id")).unionByName(first.select(F.col("a").alias("pivot"), F.col("a").alias("id")).distinct())
    labelled = members.join(sizes, "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = tables.put("members", labelled)
    parts = labelled.groupBy("pivot", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    families = parts.groupBy("pivot").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts"), F.max(F.struct("n", "s", "component")).alias("most"))
    blocks = lambda n, s: F.ceil(F.greatest(n / FAMILY_BLOCK, s / FAMILY_SHINGLES)).cast("long")
    families = families.filter("n > 2 and parts > 1").select(
        "pivot", F.col("most.component").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("others"), blocks(F.col("most.n"), F.col("most.s")).alias("mains")
    )
    rows = labelled.join(tables.put("family_sizes", families), "pivot")
    own, zero = F.col("component") == F.col("main"), F.lit(0).cast("long")
    rows = rows.withColumn("block", F.when(own, F.col("others") + F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))))
    rows = rows.withColumn("with", F.explode(F.sequence(zero, F.when(own, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    return rows.select("pivot", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", "id", "component")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> a row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = tables.put("features", docs.mapInArrow(lambda it: _feature_batches(k, it), FEATURES))
    classes = features.filter("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # One row for each distinct set, with what its least document's row holds.
    held = features.filter("n_shingles > 0").select("doc_id", "fp1", "fp2", "n_shingles", "keys")
    classes = tables.put("classes", classes.filter("rep is not null"))
    reps = (
        held.join(classes.select("fp1", "fp2", "n_shingles", F.col("rep").alias("doc_id")), ["fp1", "fp2", "n_shingles", "doc_id"], "left_semi")
        .select("doc_id", "keys")
        .dropDuplicates()
    )
    index = tables.put("index", reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id")))
    shared = index.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last")
    first = index.join(shared.select("key", "pivot"), "key").filter("id > pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    first = tables.put("first", first)
    tables.drop("index")
    ids = tables.put("ids", first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = tables.put("sets", _sets(docs, ids, k))
    links = tables.put("links", _confirm(first, sets, percent))
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n_shingles").alias("n_shingles"))
    families = tables.put("families", _family_rows(first, components(links, "minhash-cc1"), sizes, tables))
    by = ["pivot", "one", "other"]
    full = families.join(sets.withColumnRenamed("doc_id", "id"), "id").select(*by, "block", "id", "component", "shingles")
    more = full.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _family_links(percent, it), "a long, b long")
    more = tables.put("more", more.distinct())
    tables.drop("sets", "families", "members", "family_sizes")
    joined = components(links.unionByName(more), "minhash-cc2")
    final = classes.join(joined, classes.rep == joined.id, "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "fp1", "fp2").join(final, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
