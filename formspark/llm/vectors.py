"""Embedding near-duplicates (operator 2) and approximate nearest neighbours (operator 3).

Vectors that are null, zero, or hold null or non-finite components link with
nothing and take no part in a search.  Vectors of several lengths are joined
and searched length by length: only those of one length have a cosine or an
inner product.  Equal vectors link like any others.  Null ids are left out of
searches; as rows of ``near_duplicates`` they have no links and a null
component.  Rows that share an id are one node.  Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formspark.llm import common
from formspark.llm.textscan import mix64

#: Vectors that a cell has on average, and those of a block of a large cell.
CELL, BLOCK = 4096, 8192
#: Most pivots: they, and so many distances for a vector, go to every task.  Cells of more than BLOCK
#: vectors, which come of more rows than these can part, are joined block by block, so the result is the same.
MOST_PIVOTS = 8192
#: Bytes of what a task gives on at a time, copies of vectors included.
CHUNK_BYTES = 4 << 20
#: Rows compared at a time.
STRIP = 1024
#: What angles of single precision may be off, in radians.
SLACK = 5e-3
#: Bytes of the blocks of a partition: two of these meet in a task.  Vectors with links that a task holds.
PARTITION_BYTES, HELD = 64 << 20, 1 << 19


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Blobs of ``width`` doubles as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, list[int]]:
    """(id, vector) of the vectors that count, as arrays of doubles, and the lengths that they have."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    good = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
    return good, sorted(r[0] for r in good.select(F.size("vector")).distinct().collect())


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _batches(width: int, work, names: list[str]):
    """mapInArrow of ``work``, which gives one or more lists of columns, over (ids, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                for columns in work(batch.column(0).to_numpy(), flat.reshape(-1, width)):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return common.tidy(run)


def _blobs(x: np.ndarray, kind=np.float64) -> pa.Array:
    """Rows of doubles, or floats, as binary values."""
    x = np.ascontiguousarray(x, kind)
    offsets = np.arange(0, x.nbytes + 1, x.itemsize * x.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


# ---- near-duplicates: exact metric range join


def _pivots(good: DataFrame, rows: int) -> np.ndarray:
    """A bounded, seeded sample of unit vectors as pivots."""
    n = min(MOST_PIVOTS, max(1, round(rows / CELL)))
    sample = common.sample(good, n, ["id"], 5).collect()
    out = np.array([r["vector"] for r in sample])
    return np.unique(out / np.linalg.norm(out, axis=1, keepdims=True), axis=0)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _radii(pivots, width: int):
    def work(ids: np.ndarray, x: np.ndarray) -> Iterator[list]:
        p = pivots.value
        near = np.clip(_units(x) @ p.T, -1, 1)
        cell = near.argmax(axis=1)
        reach = np.arccos(near[np.arange(len(cell)), cell])
        most = np.full(len(p), -1.0)
        np.maximum.at(most, cell, reach)
        n = np.bincount(cell, minlength=len(p))
        found = np.flatnonzero(n)
        yield [pa.array(found), pa.array(most[found]), pa.array(n[found])]

    return _batches(width, work, ["cell", "reach", "own"])


def _homes(pivots, blocks, width: int, kind):
    """Each vector, once, with its cell and its block there."""

    def work(ids: np.ndarray, x: np.ndarray) -> Iterator[list]:
        few = max(1, CHUNK_BYTES // (8 * len(pivots.value)))  # distances to all pivots at a time
        for a in range(0, len(ids), few):
            own, y = ids[a : a + few], x[a : a + few]
            cell = (_units(y) @ pivots.value.T).argmax(axis=1)
            block = mix64(own.view(np.uint64)) % blocks.value[cell].astype(np.uint64)
            yield [pa.array(own), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), _blobs(y, kind)]

    return _batches(width, work, ["id", "cell", "block", "vector"])


def _packed(pivots, reach, angle: float):
    """One row a block: its ids, its vectors, and for each cell whether a partner can be there.

    The metric is the angle: vectors of cells p and q are no nearer than the
    pivots' angle less both cells' reach.
    """

    def run(t: pa.Table) -> pa.Table:
        cell, block = t.column("cell")[0].as_py(), t.column("block")[0].as_py()
        apart = np.arccos(np.clip(pivots.value @ pivots.value[cell], -1, 1))
        meets = apart <= reach.value[cell] + reach.value + angle + SLACK
        meets[cell] = True
        row = {"at": [cell << 32 | block], "cell": [cell], "meets": [meets.tolist()], "ids": [t.column("id").to_numpy().tobytes()], "vectors": [b"".join(t.column("vector").to_pylist())]}
        return pa.table(row, pa.schema([("at", pa.int64()), ("cell", pa.int32()), ("meets", pa.list_(pa.bool_())), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return common.tidy(run)


def _tally(ids: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same counts and classes: an id a row, and links of a spanning forest."""
    found, back = np.unique(ids, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64), *common.forest(a, b)


def _linked(pivots, reach, width: int, kind, cosine: float):
    """(id, n, dst): how many links each vector has in pairs of blocks, and one of a spanning forest."""
    angle = math.acos(cosine)

    def loaded(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(vectors.as_buffer(), kind).reshape(-1, width)
        small = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
        return np.frombuffer(ids.as_buffer(), np.int64), x, small / np.linalg.norm(small, axis=1, keepdims=True)

    def facing(small: np.ndarray, home: int, cell: int) -> np.ndarray:
        """Vectors of cell ``home`` that can have a partner in another.

        A partner y is no nearer to x's pivot than to its own, so x is within
        the angle and y's reach of y's pivot, and no further from it than from
        its own by more than two angles.
        """
        own, far = np.arccos(np.clip(small @ pivots.value[[home, cell]].astype(np.float32).T, -1, 1)).T
        return np.flatnonzero((far <= reach.value[cell] + angle + SLACK) & (far <= own + 2 * angle + SLACK))

    def links(one: tuple, other: tuple, same: bool, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (ids, x, small), (others, y, near) = one, other
        near = near if len(j) == len(near) else near[j]
        for a in range(0, len(i), STRIP):
            strip = small[i[a : a + STRIP]]
            p, q = np.divmod(np.flatnonzero(strip @ near.T >= cosine - 1e-4), len(near))  # of two dimensions nonzero takes as long as the product
            p, q = i[p + a], j[q]
            if same:
                p, q = p[q > p], q[q > p]
            for c in range(0, len(p), 1 << 17):
                r, s = p[c : c + (1 << 17)], q[c : c + (1 << 17)]
                true = (np.einsum("ij,ij->i", _units(x[r].astype(np.float64)), _units(y[s].astype(np.float64))) >= cosine) & (ids[r] != others[s])
                if true.any():
                    yield ids[r[true]], others[s[true]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),) * 4
        held, left, at = none, None, None

        def rows(ids: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            dst = ids.copy()
            dst[np.searchsorted(ids, a)] = b
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(dst)], ["id", "n", "dst"])

        for batch in batches:
            for k in range(batch.num_rows):
                first, second, p, q = (batch.column(c)[k].as_py() for c in ("at", "at2", "cell", "cell2"))
                if first != at:
                    left, at = loaded(batch.column("ids")[k], batch.column("vectors")[k]), first
                right = left if first == second else loaded(batch.column("ids2")[k], batch.column("vectors2")[k])
                i, j = (np.arange(len(left[0])), np.arange(len(right[0]))) if p == q else (facing(left[2], p, q), facing(right[2], q, p))
                for a, b in links(left, right, first == second, i, j) if len(i) and len(j) else ():
                    ids = np.concatenate([a, b])
                    fresh = _tally(ids, np.ones(len(ids)), a, b)
                    held = _tally(*map(np.concatenate, zip(held, fresh, strict=True)))
                    if len(held[0]) > HELD:
                        yield rows(*held)
                        held = none
        if len(held[0]):
            yield rows(*held)

    return common.tidy(run)


def near_duplicates(vectors: DataFrame, id_col: str, vector_col: str, cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of cosine ``cosine`` or more.

    An exact range join in the angle: pivots part the vectors into cells, a
    large cell into blocks, and each vector is dealt once, to its block.  The
    triangle inequality says which cells meet, and which vectors of these.
    Blocks meet by a product of partitions, which are read again and not
    copied, so disk grows with the vectors where nothing can be ruled out
    too.  Tasks send counts and the links of a spanning forest, so a family
    of k copies costs k rows, not its k * k pairs.
    """
    common.lean(vectors.sparkSession)
    good, widths = usable(vectors, id_col, vector_col)
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    if not widths:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    kind = np.float32 if vectors.schema[vector_col].dataType.elementType == T.FloatType() else np.float64
    links = _united([_links(good.where(F.size("vector") == w), w, cosine, kind) for w in widths])
    roots = common.components(links.select(F.col("id").alias("src"), "dst"))
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    out = ids.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links(good: DataFrame, width: int, cosine: float, kind) -> DataFrame:
    """(id, n, dst) of vectors of one length: how many links a task found for it, and one of a spanning forest."""
    spark, angle, rows = good.sparkSession, math.acos(cosine), good.count()
    pivots = spark.sparkContext.broadcast(_pivots(good, rows))
    cells = good.mapInArrow(_radii(pivots, width), "cell long, reach double, own long").groupBy("cell").agg(F.max("reach"), F.sum("own")).collect()  # a row a pivot
    reach, blocks = np.full(len(pivots.value), -1.0), np.ones(len(pivots.value), np.int64)
    for c, r, n in cells:
        reach[c], blocks[c] = r, math.ceil(n / BLOCK)
    reach, blocks = spark.sparkContext.broadcast(reach), spark.sparkContext.broadcast(blocks)
    dealt = good.mapInArrow(_homes(pivots, blocks, width, kind), "id long, cell int, block int, vector binary")
    packed = common.cut(dealt.groupBy("cell", "block").applyInArrow(_packed(pivots, reach, angle), "at long, cell int, meets array<boolean>, ids binary, vectors binary"))
    common.release(spark)
    # two partitions a task: enough of these for all cores, and bounded bytes each
    size = np.dtype(kind).itemsize * width + 8
    parts = max(math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)), math.ceil(rows * size / PARTITION_BYTES))
    one = packed.coalesce(parts)
    other = one.select(*[F.col(c).alias(c + "2") for c in one.columns])
    # of the two orders of a pair of blocks one, by hash
    chosen = (F.col("at") == F.col("at2")) | ((F.col("at") < F.col("at2")) == (F.pmod(F.xxhash64(F.col("at").bitwiseXOR(F.col("at2"))), F.lit(2)) == 0)) & (F.col("at") != F.col("at2"))
    pairs = one.hint("shuffle_replicate_nl").join(other, chosen & F.get("meets", F.col("cell2"))).select("at", "cell", "ids", "vectors", "at2", "cell2", "ids2", "vectors2")
    return common.cut(pairs.mapInArrow(_linked(pivots, reach, width, kind, cosine), "id long, n long, dst long"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


# ---- nearest neighbours: shifted space-filling curves

#: Most orderings, projected axes and bits of an axis.
CURVES, AXES, BITS = 12, 4, 3
#: Rows of the bounded sample that scales come from, queries whose true neighbours tell the window, and the recall asked for on these.
SAMPLE, SAMPLE_QUERIES, RECALL = 4096, 128, 0.93
#: Rows of a sorted range, and rows of a block, the unit in which a window is dealt.
RANGE_ROWS, LEAST_BLOCK, MOST_BLOCK = 1 << 20, 256, 8192


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with whole coordinates below 2**bits, one a column.

    The coordinates' bits are turned into the curve's by Gray code, from the
    highest bit down, exchanging or inverting lower bits as the curve turns.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(n):
            turned = (x[i] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


class Curves:
    """Seeded projections and shifts of several curves; their scales are fitted on a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        axes = min(AXES, width)
        self.center = sample.mean(axis=0)
        self.turn = [np.linalg.qr(rng.normal(size=(width, axes)))[0] for _ in range(CURVES)]
        self.shift = rng.random((CURVES, axes))
        self.low, self.high = [], []
        for k in range(CURVES):
            y = (sample - self.center) @ self.turn[k]
            low, high = np.quantile(y, 0.002, axis=0), np.quantile(y, 0.998, axis=0)
            self.low.append(low)
            self.high.append(np.where(high > low, high, low + 1))

    def keys(self, x: np.ndarray, k: int) -> np.ndarray:
        y = ((x - self.center) @ self.turn[k] - self.low[k]) / (self.high[k] - self.low[k])
        y = (np.clip(y, 0, 1) + self.shift[k]) / 2  # shifted inside a grid of twice the side
        return hilbert(np.minimum((y * (1 << BITS + 1)).astype(np.int64), (1 << BITS + 1) - 1), BITS + 1)


def fitted_window(places: np.ndarray, queries: np.ndarray, rows: int, recall: float = RECALL) -> tuple[int, int, float]:
    """(curves, window, recall): the least work that finds so many of some queries' true neighbours.

    places (queries, neighbours, curves) and queries (queries, curves) are
    places on the curves; the window counts rows to either side.  Work is
    rows looked at, and two curves are used at least.
    """
    apart = np.abs(places - queries[:, None, :]).reshape(-1, places.shape[2])
    best = (2, rows, 1.0)
    for n in range(2, places.shape[2] + 1):
        near = np.sort(apart[:, :n].min(axis=1))
        if len(near):
            window = int(near[min(len(near) - 1, math.ceil(recall * len(near)) - 1)])
            found = float((near <= window).mean())
            if n * min(2 * window + 1, rows) < best[0] * min(2 * best[1] + 1, rows):
                best = (n, max(window, 1), found)
    return best


def _exact(queries, width: int, top: int):
    """(q, id, score): the ``top`` rows of a partition for each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = queries.value
        kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            score = q @ x.T
            for j in range(len(own)):
                mine = np.where(ids == own[j], -np.inf, score[j])
                if len(ids) > top:
                    near = np.flatnonzero((mine >= np.partition(mine, len(mine) - top)[len(mine) - top]) & (mine > -np.inf))
                else:
                    near = np.flatnonzero(mine > -np.inf)
                both, at = np.concatenate([kept[j][0], ids[near]]), np.concatenate([kept[j][1], mine[near]])
                best = np.lexsort((both, -at))[:top]
                kept[j] = both[best], at[best]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(i), j) for j, (i, _) in enumerate(kept)] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([i for i, _ in kept] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([s for _, s in kept] or [np.zeros(0)]))], ["q", "id", "score"])

    return common.tidy(run)


def _keyed(curves, width: int):
    """(curve, key, id, h) of each row on each curve."""

    def work(ids: np.ndarray, x: np.ndarray) -> Iterator[list]:
        h = _row_hash(x)
        for k in range(CURVES):
            yield [pa.array(np.full(len(ids), k, np.int32)), pa.array(curves.value.keys(x, k)), pa.array(ids), pa.array(h)]

    return _batches(width, work, ["curve", "key", "id", "h"])


def _row_hash(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for k in range(bits.shape[1]):
        out = mix64(out + bits[:, k] + np.uint64(k))
    return out.view(np.int64)


def _dealt_blocks(width: int, every: int, curves: int, window: int, block: int, rows: int):
    """Rows to their block of each curve; queries also to the blocks that their window reaches.

    A block's queries come in chunks of about four blocks' size, each with a
    copy of the block's rows, however wide the window is.
    """
    chunk, last = 4 * block * every, rows - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK_BYTES // (8 * width + 40))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                ids = batch.column(0).to_numpy()
                data = _blobs(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                places = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, CURVES)
                asks = np.flatnonzero(ids % every == 0)
                for k in range(curves):
                    own = places[:, k] // block
                    low, high = np.maximum(own * block - window, 0) // chunk, np.minimum((own + 1) * block - 1 + window, last) // chunk
                    row = np.repeat(np.arange(len(ids)), high - low + 1)
                    yield from dealt(k, ids, data, places, row, own[row], common.ranges(low, high - low + 1), False, step)
                    at = places[asks, k]
                    low, high = np.maximum(at - window, 0) // block, np.minimum(at + window, last) // block
                    row = np.repeat(asks, high - low + 1)
                    yield from dealt(k, ids, data, places, row, common.ranges(low, high - low + 1), places[row, k] // chunk, True, step)

    def dealt(k: int, ids: np.ndarray, data: pa.Array, places: np.ndarray, row: np.ndarray, block: np.ndarray, chunk: np.ndarray, ask: bool, step: int) -> Iterator[pa.RecordBatch]:
        for b in range(0, len(row), step):
            r = row[b : b + step]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(np.full(len(r), k, np.int32)), pa.array(block[b : b + step]), pa.array(chunk[b : b + step]), pa.array(np.full(len(r), ask)), pa.array(places[r, k]), data.take(pa.array(r))], names)

    names = ["id", "curve", "block", "chunk", "ask", "place", "vector"]
    return common.tidy(run)


def _nearest(width: int, top: int, window: int):
    """The ``top`` rows of a block's windows for each query that came to it, and how many rows were looked at."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("id", "ascending")])
        ids, ask, place = t.column("id").to_numpy(), t.column("ask").to_numpy(), t.column("place").to_numpy()
        x = _matrix(t.column("vector").combine_chunks(), width)
        queries, rows = np.flatnonzero(ask), np.flatnonzero(~ask)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for a in range(0, len(queries) if len(rows) else 0, 256):
            q = queries[a : a + 256]
            # the queries follow each other on the curve, so their windows are one run of rows
            low, high = np.searchsorted(place[rows], place[q[0]] - window), np.searchsorted(place[rows], place[q[-1]] + window, side="right")
            near = rows[low:high]
            if not len(near):
                continue
            score = x[q] @ x[near].T
            score[(ids[q][:, None] == ids[near][None, :]) | (np.abs(place[q][:, None] - place[near][None, :]) > window)] = -np.inf
            k = min(top, len(near))
            least = np.partition(score, len(near) - k, axis=1)[:, len(near) - k]
            i, j = np.nonzero((score >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None]))) & (score > -np.inf))
            exact = (x[q[i]] * x[near[j]]).sum(axis=1)  # sums in one order, so that equal vectors tie
            order = np.lexsort((ids[near[j]], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            keep = nth < top
            seen = (score > -np.inf).sum(axis=1)
            out.append((ids[q[i[keep]]], ids[near[j[keep]]], exact[keep], np.where(nth[keep] == 0, seen[i[keep]], 0)))
        query, found, score, seen = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": query, "vec_id": found, "score": score, "seen": seen})

    return common.tidy(run)


def candidates(good: DataFrame, width: int, every: int, top: int) -> DataFrame:
    """(query_id, vec_id, score, seen) that the curves' windows find among vectors of one length.

    seen adds up to the rows that a query was compared with.
    """
    spark = good.sparkSession
    rows = good.count()
    sample = np.array([r["vector"] for r in common.sample(good, SAMPLE, ["id"], 3).collect()])
    curves = spark.sparkContext.broadcast(Curves(sample))
    keyed = good.mapInArrow(_keyed(curves, width), "curve int, key long, id long, h long")
    ranges = max(2 * CURVES, math.ceil(rows * CURVES / RANGE_ROWS))
    placed = common.numbered(keyed, ["curve", "key", "id", "h"], "place", ranges)
    # all curves end to end: a curve's first place is its number times the rows
    places = placed.withColumn("place", F.col("place") - F.col("curve") * F.lit(rows)).groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("curve", "place"))).alias("at"))
    # rows equal in id and vector stand side by side: one place is enough
    places = common.cut(places.select("id", "h", F.transform(F.sequence(F.lit(0), F.lit(CURVES - 1)), lambda k: F.array_min(F.transform(F.filter("at", lambda x: x["curve"] == k), lambda x: x["place"]))).alias("places")))

    # true neighbours of a few queries, from one pass over all rows; where they stand tells the window
    asked = common.sample(good.where(F.col("id") % every == 0), SAMPLE_QUERIES, ["id"], 7).dropDuplicates(["id"]).collect()
    queries = spark.sparkContext.broadcast((np.array([r["id"] for r in asked], np.int64), np.array([r["vector"] for r in asked]).reshape(-1, width)))
    first = good.mapInArrow(_exact(queries, width, top), "q long, id long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = first.distinct().withColumn("n", nth).where(F.col("n") <= top).select("q", "id").collect() if asked else []
    of = sorted({r["id"] for r in true} | {r["id"] for r in asked})
    known = spark.createDataFrame([(i,) for i in of], "id long")  # SAMPLE_QUERIES times top + 1 ids at most
    where = {r["id"]: r["places"] for r in places.join(F.broadcast(known), "id").groupBy("id").agg(F.min("places").alias("places")).collect()}
    own = np.array([where[asked[r["q"]]["id"]] for r in true], np.int64).reshape(-1, CURVES)
    there = np.array([where[r["id"]] for r in true], np.int64).reshape(-1, 1, CURVES)
    many, window, _ = fitted_window(there, own, rows)
    if rows <= top + 1:
        window = rows
    block = max(LEAST_BLOCK, min(MOST_BLOCK, window // 2))

    joined = good.mapInArrow(_hashed(width), "id long, h long, vector array<double>").join(places, ["id", "h"]).select("id", "vector", "places")
    dealt = joined.mapInArrow(_dealt_blocks(width, every, many, window, block, rows), "id long, curve int, block long, chunk long, ask boolean, place long, vector binary")
    return dealt.groupBy("curve", "block", "chunk").applyInArrow(_nearest(width, top, window), "query_id long, vec_id long, score double, seen long")


def _hashed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_row_hash(x)), batch.column(1)], ["id", "h", "vector"])

    return common.tidy(run)


def nearest_neighbours(vectors: DataFrame, id_col: str, vector_col: str, every: int = 20, top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of largest inner product found for each query.

    Queries are rows whose id ``every`` divides.  Several Hilbert curves, each
    of a seeded projection and shift, order all rows: Spark deals (curve, key)
    to sorted ranges, whose counts give each row its place.  A query is
    compared with the rows whose places are within a window of its own on
    each curve; the window counts rows and crosses the ranges' borders.  How
    many curves and how wide a window the data ask for is measured on the
    true neighbours of a few queries.  What the curves find is merged and
    ranked by the exact product.
    """
    common.lean(vectors.sparkSession)
    good, widths = usable(vectors, id_col, vector_col)
    if not widths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = _united([candidates(good.where(F.size("vector") == w), w, every, top) for w in widths])
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
