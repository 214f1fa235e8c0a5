"""Near-duplicate join on word shingles (operator 9).

Two texts link when their sets of distinct word shingles have a Jaccard
similarity of ``percent`` / 100 or more.  Shingles are compared by 64-bit
hashes; given these the join is exact.  Only the class of each document is
returned, so no list of all pairs is ever made.

Method: filtering under several global token orders.  With c = n -
ceil(percent * n / 100), what a set of n can miss, linking sets share one of
their c + 1 first tokens under any order of all tokens.

1. First order: the tokens' hashes.  Linking sets also share one token at
   least among the first 2c of each and miss c of these at most.  These
   tokens are dealt by hash as packed arrays and counted over all sets.
   Tokens that a sample shows to be very common are not counted: they are the
   last of the next order, and stay with their sets.
2. Second order: rarest first by that count, within the first order's prefix.
   Tokens of one set only count but are not kept, so most sets leave here.
   In each token's list, sorted by size, neighbours within the size filter
   are linked; the classes of those links, found by distributed rounds, hold
   every true pair together.
3. Only texts in a class of two sets or more are fetched, one for a set.
   Where a class is too large for a task, all tokens of its sets are counted,
   and the second order's links drawn again under that order, which parts
   sets that only common passages hold together.
4. In a class a pair is a candidate only if it shares a prefix token under every
   one of ORDERS orders (rarest first in its class, by hash, two seeded ones):
   the orders' filters are intersected pair by pair.  A candidate is verified
   on whole sets, unless links that are known already join its two sides.

A class that still has more than BLOCK_SHINGLES shingles or BLOCK_SETS sets
is verified by blocks: within each block, then among one set of each class
that the blocks found, and at last the sets outside the largest class that
came of this against all, MERGED blocks at a time.  A family of any size costs each of its blocks
once; nothing is dropped.

Defined cases: null and empty texts have no shingles and link with nothing;
a text with fewer words than ``width`` has its whole sequence as one
shingle; equal sets are collapsed before any pairing; rows that share an id
are one node; a null id gets its size, and a null class.  Extra columns are
ignored by ``jaccard_components`` and kept by ``keep_one``, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm import common
from formspark.llm.textscan import mix64, shingle_sets

#: Orders whose filters a candidate pair has to pass.
ORDERS = 4
#: Shingles and sets of a block of a large class.
BLOCK_SHINGLES, BLOCK_SETS = 25_000, 250
#: Blocks that the last step takes together.
MERGED = 8
#: Rows of the sample that common tokens are found in, and the share of them that such a token is in.
SAMPLE_ROWS, COMMON = 2048, 1 / 64
_MOST = np.uint32(0xFFFFFFFF)


def _set_ids(tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and id of each row's set; the id is a sum of mixed tokens."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(tokens + np.uint64(0x2545F491)), dtype=np.uint64)))
    bounds = np.searchsorted(rows, np.arange(n + 1))
    sizes = np.diff(bounds)
    return sizes, mix64(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def _missable(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of its tokens a linking partner may lack."""
    return sizes + (-percent * sizes) // 100


def _prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of the first order's prefix: the missable ones twice, one at least."""
    c = _missable(sizes, percent)
    return np.minimum(sizes, c + np.maximum(c, 1))


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, n, tokens, rows in shingle_sets(batch.column(2), width):
                sizes[first : first + n], ids[first : first + n] = _set_ids(tokens, rows, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(ids)], ["id", "h", "n_shingles", "set_id"])

    return common.tidy(run)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def _batch(names: list[str], rows: list[tuple], ints: int = 1) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i >= ints else pa.int32()) for i, c in enumerate(columns)], names)


def _of(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(values.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _prefix_tokens(width: int, percent: int):
    """(token, set) of the first order's prefix: rows, so for a bounded sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, tokens, rows in shingle_sets(batch.column(0), width):
                sizes, ids = _set_ids(tokens, rows, n)
                keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows] < _prefix(sizes, percent)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(ids[rows[keep]])], ["token", "set_id"])

    return common.tidy(run)


def _common_tokens(base: DataFrame, rows: int, width: int, percent: int) -> np.ndarray:
    """Tokens in COMMON of a sample's distinct sets or more: 64 times the tokens of a prefix at most."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    few = base.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = few.mapInArrow(_prefix_tokens(width, percent), "token long, set_id long").distinct()
    least = max(8, int(COMMON * min(rows, SAMPLE_ROWS)))
    return np.sort(np.array([r["token"] for r in found.groupBy("token").count().where(F.col("count") >= least).select("token").collect()], np.int64).view(np.uint64))


def _among(tokens: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
    return some[at] == tokens


def _postings(width: int, percent: int, parts: int, frequent, whole: bool):
    """Packed prefix tokens under the first order, of each distinct set of a batch: dealt by token, common ones by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in common.gathered(batches):
            found, every = [], set()
            for _, n, tokens, rows in shingle_sets(batch.column(0), width):
                sizes, ids = _set_ids(tokens, rows, n)
                fresh = np.array([x not in every and not every.add(x) for x in ids.tolist()], bool) & (sizes > 0)
                bounds = np.searchsorted(rows, np.arange(n))
                keep = (np.arange(len(rows)) - bounds[rows] < (sizes if whole else _prefix(sizes, percent))[rows]) & fresh[rows]
                found.append((tokens[keep], ids[rows[keep]], sizes[rows[keep]].astype(np.uint32)))
            if not found:
                continue
            tokens, sets, sizes = map(np.concatenate, zip(*found, strict=True))
            del found
            usual = ~_among(tokens, often)
            rows = []
            for kind, chosen in ((0, np.flatnonzero(usual)), (1, np.flatnonzero(~usual))):
                for p, own in _by_part(_of(sets[chosen] if kind else tokens[chosen], parts), parts):
                    own = chosen[own]
                    first = np.concatenate(([True], sets[own][1:] != sets[own][:-1]))
                    lead = own[first]
                    rows.append((p, kind, *map(common.pack, (tokens[own], first, sets[lead], sizes[lead]))))
            if rows:
                yield _batch(["part", "kind", "tokens", "fresh", "sets", "sizes"], rows, 2)

    return common.tidy(run)


def _spread(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.cumsum(common.blobs(t, "fresh", "bool")) - 1
    return common.blobs(t, "tokens", "uint64"), common.blobs(t, "sets", "int64")[place], common.blobs(t, "sizes", "uint32")[place]


def _count(blocks: int):
    """Tokens that two sets or more share, with their counts, for the sets' blocks; common tokens pass."""

    def run(t: pa.Table) -> pa.Table:
        rows = []

        def deal(tokens: np.ndarray, sets: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> None:
            for block, own in _by_part(_of(sets, blocks), blocks):
                rows.append((block, *map(common.pack, (tokens[own], sets[own], sizes[own], count[own]))))

        kinds = t.column("kind").to_numpy()
        tokens, sets, sizes = _spread(t.filter(pa.array(kinds == 1)))
        deal(tokens, sets, sizes, np.full(len(tokens), _MOST))
        tokens, sets, sizes = _spread(t.filter(pa.array(kinds == 0)))
        order = np.argsort(tokens, kind="stable")
        same = tokens[order][1:] == tokens[order][:-1]
        together = np.zeros(len(order), bool)
        together[:-1] |= same
        together[1:] |= same
        order = order[together]
        order = order[np.lexsort((sets[order], tokens[order]))]
        tokens, sets, sizes = tokens[order], sets[order], sizes[order]
        fresh = np.ones(len(order), bool)  # equal sets of several batches are one
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
        tokens, sets, sizes = tokens[fresh], sets[fresh], sizes[fresh]
        _, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
        count = np.minimum(count, int(_MOST) - 1)[back].astype(np.uint32)
        shared = count > 1
        deal(tokens[shared], sets[shared], sizes[shared], count[shared])
        return pa.Table.from_batches([_batch(["block", "tokens", "sets", "sizes", "counts"], rows)])

    return common.tidy(run)


def _rarest(percent: int, parts: int, whole: bool):
    """Each set's rarest prefix tokens.

    Of the sets of a block with the same token and size class one goes on,
    linked here to the others, so that a token gives a row for each block and
    class at most, in however many documents it stands.
    """

    def run(t: pa.Table) -> pa.Table:
        tokens, sets = common.blobs(t, "tokens", "uint64"), common.blobs(t, "sets", "int64")
        sizes, counts = common.blobs(t, "sizes", "uint32").astype(np.int64), common.blobs(t, "counts", "uint32")
        order = np.lexsort((tokens, counts, sets))
        tokens, sets, sizes = tokens[order], sets[order], sizes[order]
        fresh = np.ones(len(order), bool)  # a common token of equal sets of several batches
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
        tokens, sets, sizes = tokens[fresh], sets[fresh], sizes[fresh]
        _, first, whose, have = np.unique(sets, return_index=True, return_inverse=True, return_counts=True)
        own = sizes[first]
        alone = (own if whole else _prefix(own, percent)) - have  # prefix tokens that no other set has are the rarest
        wanted = _missable(own, percent) + 1 - alone
        keep = np.arange(len(sets)) - first[whose] < wanted[whose]
        tokens, sets, kinds = tokens[keep], sets[keep], _size_class(sizes[keep], percent).astype(np.uint16)
        order = np.lexsort((kinds, tokens))
        tokens, sets, kinds = tokens[order], sets[order], kinds[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (kinds[1:] != kinds[:-1])
        lead = sets[np.maximum.accumulate(np.where(fresh, np.arange(len(sets)), 0))] if len(sets) else sets
        a, b = common.forest(sets[~fresh], lead[~fresh])
        tokens, sets, kinds = tokens[fresh], sets[fresh], kinds[fresh]
        rows = [(p, *map(common.pack, (tokens[o], kinds[o], sets[o])), None, None) for p, o in _by_part(_of(tokens, parts), parts)]
        if len(a):
            rows.append((int(a[0]) % parts, None, None, None, common.pack(a), common.pack(b)))
        return pa.Table.from_batches([_batch(["part", "tokens", "kinds", "sets", "src", "dst"], rows)])

    return common.tidy(run)


def _size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Sizes within the ratio percent / 100 are in one class or in neighbouring ones."""
    if percent == 100:
        return np.zeros(len(sizes), np.int64)
    return np.floor(np.log(np.maximum(sizes, 1)) / -math.log(percent / 100) + 1e-9).astype(np.int64)


def _prefix_links(t: pa.Table) -> pa.Table:
    """Links between sets that stand together in a token's list; the gap of one class more covers rounding."""
    tokens, kinds, sets = common.blobs(t, "tokens", "uint64"), common.blobs(t, "kinds", "uint16").astype(np.int64), common.blobs(t, "sets", "int64")
    order = np.lexsort((kinds, tokens))
    tokens, kinds, sets = tokens[order], kinds[order], sets[order]
    near = (tokens[1:] == tokens[:-1]) & (kinds[1:] - kinds[:-1] <= 2) & (sets[1:] != sets[:-1])
    a, b = common.forest(np.concatenate([sets[1:][near], common.blobs(t, "src", "int64")]), np.concatenate([sets[:-1][near], common.blobs(t, "dst", "int64")]))
    return pa.table({"src": a, "dst": b})


class Candidates:
    """The pairs of some sets that share a prefix token under every order."""

    def __init__(self, own: list[np.ndarray], percent: int) -> None:
        self.sizes = np.array([len(x) for x in own], np.int64)
        whose = np.repeat(np.arange(len(own)), self.sizes)
        every, token, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        self.orders = []
        wanted = _missable(self.sizes, percent) + 1
        begin = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        for k in range(ORDERS):
            if k == 0:
                by = np.lexsort((every, count))
            else:
                by = np.arange(len(every)) if k == 1 else np.argsort(mix64(every + np.uint64(k * 0x9E3779B1)))
            rank = np.empty(len(every), np.int64)
            rank[by] = np.arange(len(every))
            order = np.lexsort((rank[token], whose))
            order = order[np.arange(len(order)) - begin[whose[order]] < wanted[whose[order]]]
            tokens, sets = token[order], whose[order]
            firsts = np.searchsorted(sets, np.arange(len(own) + 1))
            by = np.argsort(tokens, kind="stable")
            lists = np.searchsorted(tokens[by], np.arange(len(every) + 1))
            self.orders.append((tokens, firsts, sets[by], lists))

    def shared(self, k: int) -> np.ndarray:
        """For each set, in how many prefix tokens it meets set k, over all orders; 0 unless it does under each."""
        out, all_orders = np.zeros(len(self.sizes), np.int64), None
        for tokens, firsts, sets, lists in self.orders:
            own = tokens[firsts[k] : firsts[k + 1]]
            n = np.bincount(sets[common.ranges(lists[own], lists[own + 1] - lists[own])], minlength=len(out))
            out += n
            all_orders = n > 0 if all_orders is None else all_orders & (n > 0)
        return np.where(all_orders, out, 0)


def verified(own: list[np.ndarray], percent: int, labels: np.ndarray | None = None, guest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """True links that join all sets that links join, given sorted token arrays.

    Sets with equal ``labels`` are joined already.  With guests among them
    only pairs of a guest and another set count.
    """
    sizes = np.array([len(x) for x in own], np.int64)
    group = np.arange(len(own)) if labels is None else np.unique(labels, return_inverse=True)[1]
    mixed = guest is not None and guest.any()
    found: list[tuple[int, int]] = []
    if len(own) < 2:
        return found
    pairs = Candidates(own, percent)
    place = np.empty(len(own), np.int64)
    order = np.lexsort((np.arange(len(own)), sizes))
    place[order] = np.arange(len(own))
    for k in order[1:].tolist():
        shared = pairs.shared(k)
        open_ = (shared > 0) & (place < place[k]) & (100 * sizes >= percent * sizes[k])
        if mixed:
            open_ &= guest != guest[k]
        tried = np.flatnonzero(open_)
        tried = tried[np.argsort(-shared[tried], kind="stable")]
        for j in tried.tolist():  # the likeliest first: a link closes its whole class
            if group[j] == group[k]:
                continue
            n = len(np.intersect1d(own[k], own[j], assume_unique=True))
            if 100 * n >= percent * (sizes[k] + sizes[j] - n):
                group[group == group[j]] = group[k]
                found.append((k, j))
    return found


def _verify(width: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        wanted, label, guest = (t.column(c).to_numpy() for c in ("set_id", "label", "guest"))
        sets: list[np.ndarray | None] = [None] * t.num_rows
        for first, n, tokens, rows in shingle_sets(t.column("text"), width):
            _, ids = _set_ids(tokens, rows, n)
            bounds = np.searchsorted(rows, np.arange(n + 1))
            for i in np.flatnonzero(ids == wanted[first : first + n]):  # else another text of equal hash
                sets[first + i] = tokens[bounds[i] : bounds[i + 1]].copy()
        root, block = t.column("root").to_numpy(), t.column("block").to_numpy()
        rows = np.array([i for i, s in enumerate(sets) if s is not None], np.int64)
        rows = rows[np.lexsort((guest[rows], wanted[rows], block[rows], root[rows]))]
        key = np.stack([root[rows], block[rows], wanted[rows], guest[rows].astype(np.int64)])
        rows = rows[np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))] if len(rows) else rows
        edges = np.flatnonzero((root[rows][1:] != root[rows][:-1]) | (block[rows][1:] != block[rows][:-1])) + 1
        a, b = [], []
        for own in np.split(rows, edges):
            for i, j in verified([sets[x] for x in own], percent, label[own], guest[own]):
                a.append(wanted[own[i]])
                b.append(wanted[own[j]])
        a, b = common.forest(np.array(a, np.int64), np.array(b, np.int64))
        return pa.table({"src": a, "dst": b})

    return common.tidy(run)


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, n_shingles, set_id) of every row, and (node, root) of the sets that links join."""
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width at least 1")
    spark = docs.sparkSession
    common.lean(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), _row_key(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = common.cut(base.mapInArrow(_scan(width), "id long, h long, n_shingles long, set_id long"))
    rows, shingles = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(_common_tokens(base, rows, width, percent))

    def classes(texts: DataFrame, tokens: int, whole: bool) -> DataFrame:
        """(set_id, root) of the sets that prefix tokens, rarest first, hold together; prefixes are of 2c tokens or of all."""
        parts = common.parts_for(tokens * (1.0 if whole else min(1.0, (100 - percent) / 50)) * 16, spark)
        dealt = texts.mapInArrow(_postings(width, percent, parts, frequent, whole), "part int, kind int, tokens binary, fresh binary, sets binary, sizes binary")
        counted = dealt.groupBy("part").applyInArrow(_count(parts), "block int, tokens binary, sets binary, sizes binary, counts binary")
        rare = counted.groupBy("block").applyInArrow(_rarest(percent, parts, whole), "part int, tokens binary, kinds binary, sets binary, src binary, dst binary")
        found = common.components(rare.groupBy("part").applyInArrow(_prefix_links, "src long, dst long"))
        return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "set_id")

    def sized(members: DataFrame) -> DataFrame:
        """Members with the blocks of their class, where it is too large for a task, and their own."""
        blocks = F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count(F.lit(1)) / F.lit(BLOCK_SETS)))
        large = members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")
        return members.join(large, "root", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("set_id"), "blocks"), F.lit(0)).cast("int"))

    sets = sizes.where("n_shingles > 0").groupBy("set_id").agg(F.min("h").alias("h"), F.first("n_shingles").alias("n"))
    members = common.cut(sized(sets.join(classes(base.select("text"), shingles, False), "set_id")))
    # one row of each text that is wanted, found before texts are dealt
    texts = base.groupBy("h").agg(F.first("text").alias("text")).join(members.select("h", "set_id"), "h").select("set_id", "text")
    of_large = members.where("blocks is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if of_large:
        texts = common.cut(texts)
        large = members.where("blocks is not null").select("set_id", "h", "n", F.col("root").alias("of"))
        again = large.join(classes(texts.join(large.select("set_id"), "set_id").select("text"), of_large, True), "set_id")
        again = sized(again.withColumn("root", F.xxhash64("of", "root")).drop("of"))
        members = common.cut(members.where("blocks is null").unionByName(again))
    several = members.where("blocks is not null").limit(1).count() > 0
    texts = members.join(texts, "set_id").select("root", "block", "blocks", "set_id", "text")
    weight = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a shingle for a word of some eight bytes; at least as many parts as a shuffle has, as classes differ in size
    tasks = max(common.parts_for(8 * weight, spark), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def links(rows: DataFrame, label: Column, guest: Column) -> DataFrame:
        dealt = rows.select(F.pmod(F.xxhash64("root", "block"), F.lit(tasks)).alias("part"), "root", "block", "set_id", label.alias("label"), guest.alias("guest"), "text")
        return dealt.groupBy("part").applyInArrow(_verify(width, percent), "src long, dst long")

    found = common.cut(links(texts, F.col("set_id"), F.lit(False)))
    if several:
        whole = texts.where("blocks is not null")
        mine = members.where("blocks is not null").select("root", "set_id")
        # a set of each class that a block found; classes with more of these than the last step takes at once go there as they are
        leads = mine.join(found.select(F.col("src").alias("set_id")).distinct(), "set_id", "left_anti")
        few = leads.groupBy("root").agg(F.count(F.lit(1)).alias("leads")).where(F.col("leads") <= MERGED * BLOCK_SETS).select("root")
        chosen = leads.join(few, "root", "left_semi").select("set_id")
        found = common.cut(found.unionByName(links(whole.join(chosen, "set_id", "left_semi").withColumn("block", F.lit(-1)), F.col("set_id"), F.lit(False))))
        joined = common.components(found).select(F.col("node").alias("set_id"), F.col("root").alias("label"))
        told = common.cut(mine.join(joined, "set_id", "left").select(F.col("root").alias("of"), "set_id", F.coalesce("label", "set_id").alias("label")))
        most = told.groupBy("of", "label").count().groupBy("of").agg(F.max_by("label", F.struct("count", "label")).alias("label"))
        rest = common.cut(told.join(most, ["of", "label"], "left_anti"))
        if rest.limit(1).count():
            # classes with sets outside their largest part: these meet all others
            merged = whole.withColumn("block", F.floor(F.col("block") / MERGED).cast("int"))
            native = merged.join(rest.select(F.col("of").alias("root")).distinct(), "root", "left_semi").join(told.select("set_id", "label"), "set_id").withColumn("guest", F.lit(False))
            there = F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / MERGED).cast("int"))
            guests = merged.join(rest.select("set_id", "label"), "set_id").withColumn("block", F.explode(there)).withColumn("guest", F.lit(True))
            found = found.unionByName(links(native.unionByName(guests), F.col("label"), F.col("guest")))
    # rows that share an id are one node
    twice = sizes.where("id is not null and n_shingles > 0").groupBy("id").agg(F.min("set_id").alias("dst"), F.max("set_id").alias("other")).where("dst <> other")
    same = sizes.where("n_shingles > 0").join(twice.select("id", "dst"), "id").select(F.col("set_id").alias("src"), "dst")
    return sizes, common.components(found.unionByName(same))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row; see the module's head."""
    sizes, found = _classes(docs, id_col, text_col, width, percent)
    sets = sizes.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    sets = sets.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    roots = sets.groupBy("root").agg(F.min("least").alias("component"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    named = sets.join(roots, "root").select("set_id", "component")
    out = sizes.join(named, "set_id", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one row of each class: that of the smallest id, null last, then of the smallest hash.

    Rows without shingles all stay.  Of rows equal in id and text the one
    with the smallest other columns stays.
    """
    sizes, found = _classes(docs, id_col, text_col, width, percent)
    sets = sizes.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least"), F.count(F.lit(1)).alias("rows"))
    sets = sets.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    roots = sets.groupBy("root").agg(F.min("least").alias("first"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    named = sets.join(roots, "root").select("set_id", F.col("first.h").alias("stays"))
    judged = common.cut(sizes.where("n_shingles > 0").join(named, "set_id").select("h", (F.col("h") == F.col("stays")).alias("stays")).groupBy("h", "stays").agg(F.count(F.lit(1)).alias("rows")))
    key = common.free(docs.columns, "__h")
    keyed = docs.withColumn(key, _row_key(id_col, text_col))
    gone, twice = judged.where("not stays").select(F.col("h").alias(key)), judged.where("stays and rows > 1").select(F.col("h").alias(key))
    kept = keyed.join(gone, key, "left_anti")
    if not twice.limit(1).count():
        return kept.select(docs.columns)
    one = kept.join(twice, key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(twice, key, "left_anti").select(docs.columns).unionByName(one)


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"), width=3, percent=90)
