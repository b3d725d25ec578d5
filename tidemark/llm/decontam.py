"""Benchmark decontamination by SimHash of item-sized windows.

An item's words (runs of ASCII letters and digits, A-Z lower-cased, and of characters from U+0080, so that punctuation
makes no difference) give its bag of 5-word shingles; an item of fewer words is
one shingle of its own length. A document's window has as many words as the item, and a window matches if the weighted
(multiset) Jaccard similarity of the two bags is at least 0.8.

A window that shares no shingle with any item of its length can't match; all others of an item's length are
fingerprinted by running sums of their shingles' votes. Fingerprints have 128 bits in a multi-index of eight 16-bit blocks:
fingerprints within RADIUS = 31 bits agree in some block up to three bits, so a window looks up every value of each
block within three flipped bits, which is guaranteed to give all items within the radius. What is within it is compared
exactly. At a similarity of just 0.8, two fingerprints lie 19 bits apart with a deviation of 4, so the radius loses
about 2 windows in 1000 there, and fewer above.

Items of equal text are one entry. Entries come in blocks of about BLOCK_SHINGLES shingles, dealt by a hash, each made on
executors and broadcast as plain arrays, some 20 bytes a shingle; flipped
values aren't stored. A worker holds one block at a time: with several, documents go through them in turn, batch by batch
of rows. The documents' texts are not shuffled or collected. Null or empty texts and items match nothing. Repeated items
each match; null item ids are reported as null. Texts of any length are read whole.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Tables, small_batches
from ._words import U64, mix64, separators, shingles, word_batches

#: By byte: what stands between words.
BREAKS = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 16, 3
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
#: Every way to flip up to BLOCK_ERRORS bits of a block.
FLIPS = np.array([0] + [sum(1 << b for b in c) for n in range(1, BLOCK_ERRORS + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)
BLOCK_SHINGLES = 4_000_000
#: Windows whose prints are looked up at once.
_WINDOWS = 128
MATCH = "array<struct<item_id:bigint,start:bigint,n_words:bigint,distance:int,similarity:double>>"
_MATCH_TYPE = pa.list_(
    pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])
)


def votes(values: np.ndarray) -> np.ndarray:
    """A row of 128 ones and minus ones for each shingle."""
    pair = np.stack([mix64(values ^ U64(0xA5A5)), mix64(values ^ U64(0x5A5A))], axis=1)
    return np.unpackbits(pair.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """Rows of summed votes -> rows of eight 16-bit blocks."""
    return np.packbits(totals > 0, axis=1).view(np.uint16)


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a or b else 0.0


@dataclass
class Index:
    """Items sorted by their number of words, so that those of one length are a run."""

    ids: list[list[int | None]]
    words: np.ndarray
    sizes: np.ndarray  # the shingle length of each
    prints: np.ndarray
    bags: np.ndarray  # the items' shingles, each item's sorted; begin at `starts`
    starts: np.ndarray
    hashes: np.ndarray  # sorted distinct (shingle, run of items of one length); the run of each in `runs`
    runs: np.ndarray
    run_starts: np.ndarray  # where each run begins in the items
    seen: np.ndarray  # by the low bits of a shingle, packed, some 16 bits for each: whether an item may hold it
    block_starts: np.ndarray  # by block and value: where its items begin in `members`
    members: np.ndarray

    def near(self, prints: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of the items of so many words whose prints lie within RADIUS: they agree with the window's in some
        block up to BLOCK_ERRORS bits."""
        own, asked = self.prints.view(U64), np.ascontiguousarray(prints).view(U64)
        found = []
        for b in range(BLOCKS):
            slots = (prints[:, b].astype(np.int64)[:, None] ^ FLIPS) + b * (1 << BLOCK_BITS)
            lo, n = self.block_starts[slots], self.block_starts[slots + 1] - self.block_starts[slots]
            at = np.flatnonzero(n)
            lo, n = lo.ravel()[at], n.ravel()[at]
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item = self.members[places]
            right = np.flatnonzero(self.words[item] == words)
            window, item = np.repeat(at // len(FLIPS), n)[right], item[right]
            close = (np.bitwise_count(own[item, 0] ^ asked[window, 0]) + np.bitwise_count(own[item, 1] ^ asked[window, 1])) <= RADIUS
            found.append(window[close] * len(self.words) + item[close])
        window, item = np.divmod(np.unique(np.concatenate(found)), len(self.words))
        return window, item, np.bitwise_count(own[item] ^ asked[window]).sum(axis=1)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        low = (values & U64(8 * len(self.seen) - 1)).astype(np.int64)
        return (self.seen[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def item_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, words, sorted shingles, print) of the texts that have words."""
    for first, _, hashes, counts in word_batches(column, BREAKS):
        for k in np.unique(np.minimum(counts[counts > 0], SHINGLE)).tolist():
            of = np.minimum(counts, SHINGLE) == k
            runs, number = shingles(hashes[np.repeat(of, counts)], counts[of], k)
            ends = np.cumsum(number)
            for i, words, n, end in zip(np.flatnonzero(of).tolist(), counts[of].tolist(), number.tolist(), ends.tolist(), strict=True):
                bag = np.sort(runs[end - n : end])
                yield first + i, words, bag, fingerprints(votes(bag).sum(axis=0, keepdims=True))[0]


def build_index(items: list[tuple[list[int | None], int, np.ndarray, np.ndarray]]) -> Index | None:
    """Of (ids, words, sorted shingles, print)."""
    if not items:
        return None
    items = sorted(items, key=lambda x: x[1])
    words = np.array([x[1] for x in items])
    flat = np.concatenate([x[2] for x in items])
    starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in items])])
    new_run = np.concatenate([[True], words[1:] != words[:-1]])
    run_of = np.cumsum(new_run) - 1
    owner = np.repeat(run_of, np.diff(starts)).astype(np.int32)
    by = np.lexsort((owner, flat))
    hashes, runs = flat[by], owner[by]
    first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (runs[1:] != runs[:-1])])
    seen = np.zeros(1 << max(16, (16 * len(flat)).bit_length()), bool)
    seen[(flat & U64(len(seen) - 1)).astype(np.int64)] = True
    table = np.stack([x[3] for x in items])
    slots = (table.astype(np.int64) + np.arange(BLOCKS) * (1 << BLOCK_BITS)).T.ravel()
    order = np.argsort(slots, kind="stable")
    block_starts = np.searchsorted(slots[order], np.arange(BLOCKS * (1 << BLOCK_BITS) + 1)).astype(np.int32)
    return Index(
        [x[0] for x in items], words, np.minimum(words, SHINGLE), table, flat, starts, hashes[first], runs[first], np.flatnonzero(new_run),
        np.packbits(seen, bitorder="little"), block_starts, (order % len(items)).astype(np.int32),
    )


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted bags."""
    values, often = np.unique(a, return_counts=True)
    held = np.searchsorted(b, values, "right") - np.searchsorted(b, values)
    return int(np.minimum(often, held).sum())


def _matches(index: Index, runs: np.ndarray, k: int, places: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(item, start, distance, similarity) of the best window of each item that one document's k-word runs hold; `places`: runs that items may hold."""
    lo = np.searchsorted(index.hashes, runs[places])
    hi = np.searchsorted(index.hashes, runs[places], "right")
    hits: dict[int, list[int]] = {}  # by run of items of one length: the places that hold a shingle of theirs
    for p, a, b in zip(places.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for r in index.runs[a:b].tolist():
            hits.setdefault(r, []).append(p)
    best: dict[int, tuple[float, int, int]] = {}
    total: np.ndarray | None = None
    first = 0
    for r, at in hits.items():
        words = int(index.words[index.run_starts[r]])
        m = words - k + 1
        if int(index.sizes[index.run_starts[r]]) != k or m > len(runs):
            continue
        # Windows that hold a place, each once.
        edge = np.zeros(len(runs) - m + 2, np.int32)
        ends = np.array(at)
        np.add.at(edge, np.clip(ends - m + 1, 0, len(runs) - m + 1), 1)
        np.add.at(edge, np.clip(ends + 1, 0, len(runs) - m + 1), -1)
        windows = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        for part in np.array_split(windows, max(1, -(-len(windows) // _WINDOWS))):
            if not len(part):
                continue
            begin, end = int(part[0]), int(part[-1]) + m
            if total is None or begin < first or end > first + len(total) - 1:
                if end - begin > 64 * _WINDOWS:  # far apart: each window's votes by themselves
                    prints = np.concatenate([fingerprints(votes(runs[s : s + m]).sum(axis=0, keepdims=True)) for s in part.tolist()])
                else:
                    total, first = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(votes(runs[begin:end]), axis=0, dtype=np.int32)]), begin
                    prints = fingerprints(total[part + m - first] - total[part - first])
            else:
                prints = fingerprints(total[part + m - first] - total[part - first])
            window, item, distance = index.near(prints, words)
            for j in range(len(window)):
                i, start = int(item[j]), int(part[window[j]])
                common = _common(runs[start : start + m], index.bags[index.starts[i] : index.starts[i + 1]])
                similarity = common / (2 * m - common)
                if similarity >= SIMILARITY and (similarity, -start) > best.get(i, (0.0, 1))[:2]:
                    best[i] = (similarity, -start, int(distance[j]))
    for item, (similarity, start, distance) in sorted(best.items()):
        yield item, -start, distance, similarity


def match_texts(index: Index, column: pa.Array) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for first, _, hashes, counts in word_batches(column, BREAKS):
        for k in np.unique(index.sizes).tolist():
            fits = counts >= k
            if not fits.any():
                continue
            runs, number = shingles(hashes[np.repeat(fits, counts)], counts[fits], k)
            flagged = np.flatnonzero(index.may_hold(runs))
            ends = np.cumsum(number)
            docs = np.flatnonzero(fits)
            owner = np.searchsorted(ends, flagged, "right")
            for i in np.unique(owner).tolist():
                begin = int(ends[i] - number[i])
                for item, start, distance, similarity in _matches(index, runs[begin : ends[i]], k, flagged[owner == i] - begin):
                    out[first + docs[i]] += [
                        {"item_id": item_id, "start": start, "n_words": int(index.words[item]), "distance": distance, "similarity": similarity} for item_id in index.ids[item]
                    ]
    return out


#: The index a worker holds, by its broadcast; tasks that run in the same worker after each other use it again.
_held: dict[int, Index | None] = {}


def _indexes(sent: list) -> Iterator[Index | None]:
    for one in sent:
        if one.bid not in _held:
            _held.clear()
            _held[one.bid] = build_index(_unpack(one.value))
        yield _held[one.bid]


class _Sent:
    """A broadcast with an identity that workers can tell it by."""

    def __init__(self, bid: int, broadcast):
        self.bid, self.broadcast = bid, broadcast

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _match_column(sent: list, text: Column) -> Column:
    @F.arrow_udf(MATCH)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            for index in _indexes(sent):
                for all_of, more in zip(found, match_texts(index, texts), strict=True):
                    all_of += more
            yield pa.array([sorted(x, key=lambda m: (m["item_id"] is None, m["item_id"] or 0)) for x in found], _MATCH_TYPE)

    # Not repeated for the filter that explode brings.
    return match.asNondeterministic()(text)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(item_features(batch.column(1)))
        ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
        columns = [ids, pa.array([x[1] for x in found], pa.int64()), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (2, 3))]
        yield pa.RecordBatch.from_arrays(columns, names=["ids", "words", "shingles", "print"])


def _pack(rows: list) -> bytes:
    return pickle.dumps([(list(r.ids), r.words, bytes(r.shingles), bytes(r["print"])) for r in rows])


def _unpack(packed: bytes) -> list[tuple[list[int | None], int, np.ndarray, np.ndarray]]:
    return [(ids, words, np.frombuffer(values, U64), np.frombuffer(own, np.uint16)) for ids, words, values, own in pickle.loads(packed)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `leaks`: the benchmark items each text holds (a column of that name is replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    # collect_list leaves nulls out, so ids go as one-element arrays.
    entries = benchmark.groupBy("text").agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("item_id").cast("long"))))).alias("ids"))
    tables = Tables(spark, "leaks")
    features = tables.put("items", entries.select("ids", "text").mapInArrow(_features, "ids array<long>, words long, shingles binary, print binary"))
    total = features.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("shingles"), F.lit(blocks))
    sent = []
    for b in range(blocks):
        rows = features.filter(block == b).orderBy("words", "shingles").collect()
        if rows:
            packed = _pack(rows)
            sent.append(_Sent(xxhash.xxh3_64_intdigest(packed), spark.sparkContext.broadcast(packed)))
    none = F.array().cast(MATCH)
    docs = docs.drop("leaks")
    return docs.withColumn("leaks", F.coalesce(_match_column(sent, F.col(text)), none) if sent else none)


def leak_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): a row per document and item it holds."""
    return find_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.*")
