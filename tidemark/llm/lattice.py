"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector by random normal directions into one or two 8-dimensional spaces and decodes each
projection to the nearest point of the E8 lattice; the points together are the vector's cell. A vector is held by its
own cell and by the neighbouring ones that lie nearest to its projection (the neighbours of an E8 point are its 240
shortest vectors). Vectors that share a cell are candidates, and every link is verified by its cosine in double precision.

The scale of the projections sets the cells' size, which follows from the number of vectors (RESOLUTIONS). Sending a vector
to one more cell costs as much as some thousand comparisons by matrix products, so cells are coarse and tables few: a
vector of random components is compared with up to some 25,000 unrelated ones, up to 16 million vectors; beyond, that number
grows with the table. A pair at cosine 0.9 lies in one's own cell and a cell of the other's with probability 0.98 or
more at each resolution, as the tests measure; as pairs that share any cell are compared, it is found with 0.99 or more.

Two passes go over the cells. The first compares in single precision, a few tables at a time, and keeps which vectors
have a link at all. The second sends only those, with all their cells, and counts a pair in the least cell it shares. What
is on its way at once is bounded by some three times the vectors (ROOM), whatever their number, and its files are
deleted before more is sent.

Equal vectors are one class, counted by multiplicity. Vectors that are null, empty or zero, or that hold null or
non-finite components, link with nothing and are kept; so are vectors of different lengths not linked with each other.
Rows with a null id link only through an equal vector with an id: without one they count as copies of each other alone,
aren't counted by near vectors and have no component; they are not kept. Rows that share an id are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Tables, small_batches
from ._words import U64, mix64, odd_constants
from .components import components

NEIGHBOURS = 10
#: Vectors of fewer components have twice the tables.
SHORT = 4 * 8
#: Vectors of a cell that are compared with as many others in one task.
FAMILY_BLOCK = 16_384
#: Vectors compared at once, by as many.
_TILE = 512
#: Rows of vectors that are read or cross to Python at once.
_ROWS = 2_000
#: Cells' projections, of all tables and lattices, that are decoded at once.
_CHUNK = 256 * 52
_COLUMNS = 2048
#: Bytes on their way at once: so many times the vectors' own, and LEAST_ROOM at least.
ROOM, LEAST_ROOM = 3, 256 << 20
LINKED = "id long"
FOUND = "a long, b long, n long"


@dataclass(frozen=True)
class Resolution:
    upto: float  # vectors among which one meets some ten unrelated ones in the cells it looks into
    lattices: int
    scale: float
    probes: int
    tables: int


RESOLUTIONS = (
    Resolution(200, 1, 0.5, 1, 6),
    Resolution(500, 1, 0.6, 1, 9),
    Resolution(1_600, 2, 0.45, 1, 17),
    Resolution(6_500, 2, 0.5, 1, 24),
    Resolution(float("inf"), 2, 0.6, 1, 46),
)
#: Tables are this many times as large as their resolution's `upto`: comparisons are cheap beside cells.
CROWD = 2_500


def resolution(n: int) -> Resolution:
    return next(r for r in RESOLUTIONS if n <= r.upto * CROWD)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or all of one half with an even number of minus signs."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


SHORTEST = shortest_vectors()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    point = np.rint(y)
    off = y - point
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    point[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Hasher:
    """Cells of unit vectors of one length."""

    def __init__(self, length: int, of: Resolution = RESOLUTIONS[0]):
        rng = np.random.default_rng([length, 8])
        self.of = of
        # Projections of short vectors are less independent of each other.
        self.tables = of.tables * (2 if length < SHORT else 1)
        self.directions = rng.normal(size=(length, self.tables * of.lattices * 8)) * of.scale
        self.factors = odd_constants(8, 11)
        self.salts = mix64(np.arange(self.tables, dtype=U64) * U64(1 << 20) + U64(length))

    def _point_hash(self, points: np.ndarray) -> np.ndarray:
        return mix64(((points * 2).astype(np.int64).astype(U64) * self.factors).sum(axis=-1, dtype=U64))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, looked into): keys by table, and by table and probe; the latter include the former."""
        n, of = len(unit), self.of
        m = min(NEIGHBOURS, of.probes)
        y = (unit @ self.directions).reshape(n * self.tables * of.lattices, 8)
        point = decode(y)
        gain = (y - point) @ SHORTEST.T
        best = gain.argmax(axis=1)[:, None] if m == 1 else np.argpartition(-gain, m, axis=1)[:, :m]
        # The squared distance grows by |v|^2 - 2 (y - point) v; the shortest vectors have |v|^2 = 2. Its own point comes first.
        cost = np.concatenate([np.full((len(y), 1), -1.0), 2 - 2 * np.take_along_axis(gain, best, axis=1)], axis=1).reshape(-1, of.lattices, m + 1)
        around = np.concatenate([point[:, None], point[:, None] + SHORTEST[best]], axis=1)
        hashed = self._point_hash(around).reshape(-1, of.lattices, m + 1)
        joint, keys, own = cost[:, 0], hashed[:, 0] * U64(3), hashed[:, 0, 0] * U64(3)
        for i in range(of.lattices):
            if i:
                joint = (joint[:, :, None] + cost[:, i, None, :]).reshape(len(joint), -1)
                keys = (mix64(keys)[:, :, None] + hashed[:, i, None, :] * U64(7)).reshape(len(joint), -1)
                own = mix64(own) + hashed[:, i, 0] * U64(7)
            left = of.probes if i == of.lattices - 1 else 4 * of.probes
            if left + 1 < joint.shape[1]:
                nearest = np.argpartition(joint, left, axis=1)[:, : left + 1]
                joint, keys = np.take_along_axis(joint, nearest, axis=1), np.take_along_axis(keys, nearest, axis=1)
        salts = self.salts[None, :]
        return mix64(own.reshape(n, self.tables) + salts), mix64(keys.reshape(n, self.tables, -1) + salts[:, :, None]).reshape(n, -1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors in double precision, a row each) of the vectors that can link, for each length."""
    rows: dict[int, list[int]] = {}
    held = column.to_numpy(zero_copy_only=False)
    for i, v in enumerate(held):
        if v is None or not len(v):
            continue
        v = np.asarray(v, np.float64)
        if np.isfinite(v).all() and v.any():
            rows.setdefault(len(v), []).append(i)
    for of in rows.values():
        yield np.array(of), np.array([held[i] for i in of], np.float64) + 0.0  # a negative zero becomes zero


def _unit(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # so that neither huge nor tiny components are lost in the squares
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64).ravel())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) -> these with two fingerprints, of the vectors that can link."""
    for batch in batches:
        for of, x in _by_length(batch.column(1)):
            bits = mix64(x.view(U64) * odd_constants(x.shape[1], 12))
            columns = [*(c.take(pa.array(of)) for c in batch.columns), _longs(bits.sum(axis=1, dtype=U64)), _longs(mix64(bits).sum(axis=1, dtype=U64))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "fp1", "fp2"])


def _celled(of: Resolution, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, copies, vector) -> these and the cells of each table, a column each; null where a length has fewer tables."""
    hashers: dict[int, Hasher] = {}
    step = max(16, _CHUNK // (of.tables * of.lattices))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            for places, x in _by_length(part.column(2)):
                length = x.shape[1]
                if length not in hashers:
                    hashers[length] = Hasher(length, of)
                cells = hashers[length].cells(_unit(x))[1].reshape(len(x), hashers[length].tables, -1)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[2])
                columns = [pa.ListArray.from_arrays(offsets, _longs(cells[:, t])) for t in range(cells.shape[1])]
                columns += [pa.nulls(len(x), pa.list_(pa.int64()))] * (len(names) - len(columns))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(places)) for c in part.columns), *columns], names=["id", "copies", "vector", *names])


class _Family:
    """The vectors of one task's pair of blocks."""

    def __init__(self):
        self.ids, self.sides, self.copies, self.vectors, self.pivots = [], [], [], [], []

    def compare(self, pivot: int, same: bool, least: float) -> list[tuple[int, int | None, int | None]]:
        """(id, null, links counted here) and (a, b, null) of a spanning forest of the links, without those met in a family of a lesser pivot."""
        n = len(self.ids)
        if n < 2:
            return []
        lengths = np.array([len(v) for v in self.vectors])
        ids, sides, copies = np.array(self.ids), np.array(self.sides), np.array(self.copies, np.int64)
        lesser = _Lesser(self.pivots, pivot)
        number, root = np.zeros(n, np.int64), np.arange(n)
        out: list[tuple[int, int | None, int | None]] = []
        for length in np.unique(lengths):
            # Those with like pivots stand together, so that whole tiles turn out to have met before.
            of = np.array(sorted(np.flatnonzero(lengths == length), key=lesser.listed))
            x = _unit(np.array([self.vectors[i] for i in of], np.float64))
            common = [lesser.common(of[p : p + _TILE]) for p in range(0, len(of), _TILE)]
            for p, q in ((p, q) for p in range(len(common)) for q in range(p, len(common)) if common[p].isdisjoint(common[q])):
                at, to = slice(p * _TILE, (p + 1) * _TILE), slice(q * _TILE, (q + 1) * _TILE)
                rows, columns = of[at], of[to]
                link = (x[at] @ x[to].T >= least) & (ids[rows, None] != ids[columns])
                if not same:
                    link &= sides[rows, None] != sides[columns]
                if not link.any():
                    continue
                some, others = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
                rows, columns = rows[some], columns[others]
                link = link[np.ix_(some, others)] & ~lesser.met(rows, columns)
                number[rows] += _weighed(link, copies[columns])
                if p != q:
                    number[columns] += _weighed(link.T, copies[rows])
                out += _joined(root, rows, columns, link, ids)
        return [(int(ids[i]), None, int(number[i])) for i in np.flatnonzero(number)] + out

    def _met_before(self, pivot: int, n: int) -> np.ndarray:
        """Pairs that also meet in a family of a lesser pivot."""
        return _Lesser(self.pivots, pivot).met(np.arange(n), np.arange(n))


def _weighed(link: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The sum of the linked columns' copies in each row."""
    if (copies == 1).all():
        return np.count_nonzero(link, axis=1)
    return np.where(link, copies, 0).sum(axis=1)


class _Lesser:
    """Which of a family's members share a pivot that is less than the family's."""

    def __init__(self, pivots: list[np.ndarray], pivot: int):
        held = [np.unique(p) for p in pivots]
        held = [p[p < pivot] for p in held]
        _, self.column = np.unique(np.concatenate(held), return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum([len(h) for h in held])])

    def listed(self, member: int) -> list[int]:
        return self.column[self.start[member] : self.start[member + 1]].tolist()

    def common(self, members: np.ndarray) -> set[int]:
        """Columns that all of the members hold."""
        column, often = np.unique(self._of(members)[1], return_counts=True)
        return set(column[often == len(members)].tolist())

    def _of(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the members, column) of each pivot they hold."""
        owner = np.repeat(np.arange(len(members)), self.start[members + 1] - self.start[members])
        return owner, np.concatenate([self.column[self.start[m] : self.start[m + 1]] for m in members])

    def met(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        met = np.zeros((len(rows), len(columns)), bool)
        sides = [self._of(rows), self._of(columns)]
        common = np.intersect1d(sides[0][1], sides[1][1])
        # A bounded number of pivots at a time.
        for first in range(0, len(common), _COLUMNS):
            some, held = common[first : first + _COLUMNS], []
            for (owner, column), n in zip(sides, met.shape, strict=True):
                at = np.minimum(np.searchsorted(some, column), len(some) - 1)
                there = some[at] == column
                held.append(np.zeros((n, len(some)), np.float32))
                held[-1][owner[there], at[there]] = 1
            met |= held[0] @ held[1].T > 0
        return met


def _joined(root: np.ndarray, rows: np.ndarray, columns: np.ndarray, link: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, None]]:
    """Links, one for each two trees of the forest `root` that become one; `root` keeps the trees."""
    out: list[tuple[int, int, None]] = []
    while True:
        apart = link & (root[rows, None] != root[columns])
        open_ = np.flatnonzero(apart.any(axis=1))
        if not len(open_):
            return out
        for i, j in zip(rows[open_].tolist(), columns[apart[open_].argmax(axis=1)].tolist(), strict=True):
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[b] = a
                out.append((int(ids[i]), int(ids[j]), None))
        while (root[root] != root).any():
            root[:] = root[root]


def _compare_batches(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, one, other, block, id, vector, copies, pivots), a task's together -> FOUND."""
    key, held = None, _Family()

    def pack(found):
        columns = zip(*found, strict=True) if found else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    for batch in batches:
        head = [batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 6)]
        lists = [(batch.column(i).offsets.to_numpy(), batch.column(i).values.to_numpy()) for i in (5, 7)]
        for r in range(batch.num_rows):
            now = (head[0][r], head[1][r], head[2][r])
            if now != key:
                if key is not None:
                    yield pack(held.compare(key[0], key[1] == key[2], least))
                key, held = now, _Family()
            held.sides.append(head[3][r])
            held.ids.append(head[4][r])
            held.copies.append(head[5][r])
            for (offs, values), into in zip(lists, (held.vectors, held.pivots), strict=True):
                into.append(values[offs[r] : offs[r + 1]].copy())
    if key is not None:
        yield pack(held.compare(key[0], key[1] == key[2], least))


def _linked(ids: np.ndarray, sides: np.ndarray, x: np.ndarray, same: bool, least: float) -> np.ndarray:
    """The ids of unit vectors in single precision that may have a link, within the rounding of that precision."""
    least -= 2e-7 * (x.shape[1] + 8)
    if same and len(ids) <= _TILE:  # most cells
        near = x @ x.T
        np.fill_diagonal(near, -2)
        return ids[(near >= least).any(axis=1)] if near.max() >= least else ids[:0]
    one = np.arange(len(ids)) if same else np.flatnonzero(sides == sides[0])
    other = one if same else np.flatnonzero(sides != sides[0])
    some = np.zeros(len(ids), bool)
    for i in range(0, len(one), _TILE):
        for j in range(i if same else 0, len(other), _TILE):
            rows, columns = one[i : i + _TILE], other[j : j + _TILE]
            # Two that are known to have links needn't be compared.
            known = rows[some[rows]]
            for r, c in ((rows[~some[rows]], columns), (known, columns[~some[columns]])):
                if not len(r) or not len(c):
                    continue
                near = x[r] @ x[c].T
                if same and i == j:
                    near[r[:, None] == c] = -2
                if near.max() >= least:
                    near = near >= least
                    some[r] |= near.any(axis=1)
                    some[c] |= near.any(axis=0)
    return ids[some]


def _linked_batches(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, one, other, block, id, vector), a task's together -> LINKED."""
    key, held = None, {}

    def found():
        for parts in held.values():
            ids, sides, x = parts[0] if len(parts) == 1 else (np.concatenate(p) for p in zip(*parts, strict=True))
            if len(ids) > 1 and len(some := _linked(ids, sides, x, key[1] == key[2], least)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64())], names=["id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, one, other, side, ids = (batch.column(i).to_numpy() for i in range(5))
        offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
        lengths = np.diff(offsets)
        units = {}  # by length: the places of its vectors and these
        for length in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == length)
            units[length] = of, _unit(values[offsets[of][:, None] + np.arange(length)].astype(np.float64)).astype(np.float32)
        starts = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(one) != 0) | (np.diff(other) != 0)) + 1])
        keys = zip(cell[starts].tolist(), one[starts].tolist(), other[starts].tolist(), strict=True)
        for now, lo, hi in zip(keys, starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            if now != key:
                yield from found()
                key, held = now, {}
            for length, (of, x) in units.items():
                a, b = (lo, hi) if len(units) == 1 else np.searchsorted(of, (lo, hi))
                if a < b:
                    held.setdefault(length, []).append((ids[of[a:b]], side[of[a:b]], x[a:b]))
    yield from found()


def _dealt(tables: Tables, name: str, rows: DataFrame, cells: Column, n: int, most: int, columns: list[str]) -> Iterator[DataFrame]:
    """(cell, one, other, block, *columns) of rows for each of their `cells`, `n` in all, sorted by the first three, in parts of some
    `most` rows: cells with over FAMILY_BLOCK rows are cut into blocks, and every two blocks are a task's."""
    by, zero = ["cell", "one", "other"], F.lit(0).cast("long")
    held = rows.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("held")).filter(F.col("held") > FAMILY_BLOCK)
    crowded = tables.put(f"{name}-crowded", held.withColumn("blocks", F.ceil(F.col("held") / FAMILY_BLOCK).cast("long"))) if n > FAMILY_BLOCK else None
    more = crowded.agg(F.sum(F.expr("held * (blocks - 1)"))).first()[0] if crowded else None
    out = rows.select(*columns, F.explode(cells).alias("cell"))
    if more:  # as many cells as n / FAMILY_BLOCK, at most
        out = out.join(F.broadcast(crowded.select("cell", "blocks")), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        out = out.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    else:
        out = out.withColumns({"block": zero, "with": zero})
    out = out.select("cell", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", *columns)
    parts = max(1, -(-(n + (more or 0)) // most))
    for i in range(parts):
        part = out.filter(F.pmod(F.xxhash64(*by, F.lit(1)), F.lit(parts)) == i) if parts > 1 else out
        yield part.repartition(*by).sortWithinPartitions(*by)


def _all(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))


def near_vectors(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, embedding) -> a row per vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    small_batches(spark, _ROWS)
    tables = Tables(spark, "lattice", tidy=True)
    kind, width = ("array<float>", 4) if dict(embeddings.dtypes)["embedding"] == "array<float>" else ("array<double>", 8)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    features = rows.mapInArrow(_features, f"vec_id long, vector {kind}, fp1 long, fp2 long")
    prints = tables.put("prints", features.select("vec_id", "fp1", "fp2", F.size("vector").alias("length")))
    classes = tables.put("classes", prints.groupBy("fp1", "fp2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("length").alias("length")))
    n, components_, shortest = classes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.min("length")).first()
    of, short = resolution(n), n > 0 and shortest < SHORT
    # One row for each distinct vector. Classes whose rows all lack an id have no vertex of their own.
    reps = features.join(classes.select("fp1", "fp2", F.col("rep").alias("vec_id"), "copies"), ["fp1", "fp2", "vec_id"]).dropDuplicates(["fp1", "fp2", "vec_id"])
    names = [f"cells{t}" for t in range(of.tables * (2 if short else 1))]
    celled = f"id long, copies long, vector {kind}, " + ", ".join(f"{c} array<long>" for c in names)
    reps = tables.put("reps", reps.select(F.col("vec_id").alias("id"), "copies", "vector").mapInArrow(lambda it: _celled(of, names, it), celled))
    # Which vectors have a link.
    cells, room = of.probes + 1, max(LEAST_ROOM, ROOM * width * components_)
    own = width * components_ / max(n, 1) + 80
    most, parts = int(room / own), []
    some = max(1, most // max(1, n * cells))
    for i in range(0, len(names), some):
        here = names[i : i + some]
        for dealt in _dealt(tables, f"looked{i}", reps, F.concat(*(_listed(c) for c in here)), n * cells * len(here), most, ["id", "vector"]):
            parts.append(tables.put(f"linked{len(parts)}", dealt.mapInArrow(lambda it: _linked_batches(least, it), LINKED)))
    linked = tables.put("linked", _all(spark, parts, LINKED).distinct())
    # Their links.
    pivots = F.concat(*(_listed(c) for c in names)).alias("pivots")
    told = tables.put("told", reps.select("id", "vector", "copies", pivots).join(linked, "id"))
    tables.drop("reps", *(f"linked{i}" for i in range(len(parts))))
    met, most, parts = told.count() * cells * len(names), int(room / (own + 8 * cells * len(names))), []
    for dealt in _dealt(tables, "met", told, F.col("pivots"), met, most, ["id", "vector", "copies", "pivots"]):
        parts.append(tables.put(f"found{len(parts)}", dealt.mapInArrow(lambda it: _compare_batches(least, it), FOUND)))
    found = _all(spark, parts, FOUND)
    tables.drop("told", "linked")
    degree = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    joined = components(found.filter("b is not null").select("a", "b"), "lattice-cc")
    final = (
        classes.join(degree, classes.rep == degree.a, "left")
        .join(joined, classes.rep == joined.id, "left")
        .select("fp1", "fp2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = prints.select("vec_id", "fp1", "fp2").join(final, ["fp1", "fp2"]).select("vec_id", "n_links", "component_id")
    return _with_the_rest(rows, linked)


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<bigint>"))


def valid(embedding: Column) -> Column:
    """Whether a vector can link: some components, none null or non-finite, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _with_the_rest(rows: DataFrame, linked: DataFrame) -> DataFrame:
    alone = rows.filter(~valid(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
