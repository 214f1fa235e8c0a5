"""Mixing sources to target weights by minimum-cost flow (operator 1).

A document may belong to several sources.  Documents are counted by
membership pattern, so the flow network has a node for each pattern and
source, whatever the number of documents.  From each pattern leave as many
arcs as a document may be taken times, of the pattern's size each and of
rising cost, so that repeats are spread before they pile up; from a pattern
words go to any of its sources, and from a source as many as its target.
Successive shortest paths give the words to take from each pattern.

A source whose documents have no other needs no network: its words are its
target.  The others' patterns come to the driver, up to MOST_PATTERNS of
them; beyond, sources and patterns stay tables, and each connected part of
the network is solved in a task.

A pattern's words are taken as whole rounds of all its documents and one
seeded part: documents in order of a seeded hash.  Sums by hash bucket say
which buckets go whole and in which one the part ends; that one is cut into
buckets again until it has some hundred documents, of which each goes that
still fits.  So the part is nearly exact, and a pattern that holds most
documents is never in one task.  Of rows equal in all columns, of which some
go, about the right number does.

Targets: sources in code point order, null last, have the weights given, in
turn; they share all sizes, none above ``most`` times its own, the excess
going to the others by weight.

Defined cases: null text has size 0; null is a source of its own; documents
of size 0 are taken 0 words; repeated and null ids are rows like others; an
empty table gives no rows.  Extra columns are kept by ``mix_documents``,
whatever their names, and ignored by the query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formspark.llm import common

#: Patterns and sources that may come to the driver.
MOST_PATTERNS = 50_000
#: Documents that a last bucket of a pattern's seeded order has, and buckets of one cut.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 16
#: Documents of a last bucket, the smallest, that are decided all together, and bits that this may take.
LAST, MOST_BITS = 64, 1 << 28
#: Decisions about single documents that may be broadcast: 24 bytes each.
MOST_DECISIONS = 500_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), most: float = 3.0, total: float | None = None) -> dict[str | None, float]:
    """Each source's share of all words by weight, none above ``most`` times its size; ``total`` counts documents of several sources once."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    cap = {s: float(most * sizes[s]) for s in order}
    total = float(sum(sizes.values()) if total is None else total)
    # filled up in the order in which sources reach their caps, the water level stands where the rest share alike
    left, open_weight = total, sum(weight.values())
    target = {}
    for s in sorted(order, key=lambda s: cap[s] / weight[s]):
        level = left / open_weight if open_weight else 0.0
        target[s] = min(cap[s], level * weight[s])
        if target[s] == cap[s]:
            left -= cap[s]
            open_weight -= weight[s]
    return target


def min_cost_flow(patterns: dict[tuple, int], quotas: dict[str | None, float], most: int) -> dict[tuple, float]:
    """Words to take of each pattern: a cheapest flow of largest size into the quotas.

    The k-th time that a pattern is taken costs k for each word.
    """
    sources = {s: i for i, s in enumerate(quotas)}
    names = list(patterns)
    start, end = 0, 1 + len(names) + len(sources)
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # arcs: to, room, cost, place of the arc back

    def arc(a: int, b: int, room: float, cost: float) -> list:
        there, back = [b, room, cost, len(graph[b])], [a, 0.0, -cost, len(graph[a])]
        graph[a].append(there)
        graph[b].append(back)
        return there

    taken: dict[tuple, list[list]] = {}
    for i, p in enumerate(names):
        taken[p] = [arc(start, 1 + i, float(patterns[p]), float(k)) for k in range(1, most + 1)]
        for s in p:
            if s in sources:
                arc(1 + i, 1 + len(names) + sources[s], float("inf"), 0.0)
    for s, quota in quotas.items():
        arc(1 + len(names) + sources[s], end, float(quota), 0.0)

    height = [0.0] * (end + 1)
    while True:
        dist, by = [float("inf")] * (end + 1), [None] * (end + 1)
        dist[start] = 0.0
        queue = [(0.0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for x in graph[a]:
                if x[1] > 1e-9 and (e := d + x[2] + height[a] - height[x[0]]) < dist[x[0]] - 1e-12:
                    dist[x[0]], by[x[0]] = e, (a, x)
                    heapq.heappush(queue, (e, x[0]))
        if by[end] is None:
            break
        height = [h + min(d, dist[end]) for h, d in zip(height, dist, strict=True)]
        path, b = [], end
        while b != start:
            a, x = by[b]
            path.append(x)
            b = a
        room = min(x[1] for x in path)
        for x in path:
            x[1] -= room
            graph[x[0]][x[3]][1] += room
    return {p: sum(patterns[p] - x[1] for x in taken[p]) for p in names}


def nearest_sum(sizes: Sequence[int], target: int) -> list[int]:
    """Positions of sizes whose sum is nearest to the target, ties to the smaller; sums are the bits of one number."""
    mask = (1 << (target + max(sizes, default=0) + 1)) - 1
    sums, before = 1, []
    for n in sizes:
        before.append(sums)
        sums |= (sums << n) & mask
    low = (sums & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = sums >> (target + 1)
    high = target + (above & -above).bit_length() if above else None
    at = low if high is None or target - low <= high - target else high
    chosen = []
    for i in range(len(sizes) - 1, -1, -1):
        if not before[i] >> at & 1:
            chosen.append(i)
            at -= sizes[i]
    return chosen


def _fitting(t: pa.Table) -> pa.Table:
    """Of a bucket's documents how many copies of each go, for a sum near the rest of the part.

    In seeded order each goes that still fits; what is left then is met as
    near as LAST of the documents can, or by one more or less of any.
    """
    t = t.sort_by([("order", "ascending"), ("size", "ascending")])
    left = t.column("limit")[0].as_py() - t.column("base")[0].as_py()
    sizes, copies = t.column("size").to_pylist(), t.column("copies").to_pylist()
    take = []
    for n, c in zip(sizes, copies, strict=True):
        take.append(min(c, max(0, int(left // n))) if n else c)
        left -= n * take[-1]
    # the last documents are decided again, all together
    some = sorted((n, i) for i, n in enumerate(sizes) if n and copies[i] == 1)[:LAST]
    again = left + sum(n for n, i in some if take[i])
    if some and len(some) * (again + some[-1][0]) < MOST_BITS:
        for _, i in some:
            take[i] = 0
        for k in nearest_sum([n for n, _ in some], max(0, round(again))):
            take[some[k][1]] = 1
    else:
        more = min(((abs(left - n), i) for i, n in enumerate(sizes) if take[i] < copies[i]), default=(left, -1))
        if more[0] < left:
            take[more[1]] += 1
    share = [x / c for x, c in zip(take, copies, strict=True)]
    return pa.table({"order": t.column("order"), "size": t.column("size"), "share": pa.array(share, pa.float64())})


_PLAN = "pattern array<string>, quotas array<struct<source: string, size: bigint, target: double>>, flow double"


def _planned_here(patterns: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """(pattern, quotas, flow), solved on the driver."""
    rows = {tuple(r["pattern"]): r["size"] for r in patterns.select("pattern", "size").collect()}
    rows = dict(sorted(rows.items(), key=lambda x: [(s is None, s or "") for s in x[0]]))
    sizes: dict[str | None, int] = {}
    for p, n in rows.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = source_targets(sizes, weights, most, sum(rows.values()))
    tied = {s for p in rows if len(p) > 1 for s in p}
    network = {p: n for p, n in rows.items() if p[0] in tied}
    flow = {p: min(target[p[0]], float(most * n)) for p, n in rows.items() if p[0] not in tied}
    flow |= min_cost_flow(network, {s: target[s] for s in target if s in tied}, most)
    return patterns.sparkSession.createDataFrame([(list(p), [(s, sizes[s], target[s]) for s in p], float(flow[p])) for p in rows], _PLAN)


def _targets(sources: DataFrame, weights: Sequence[float], most: float, total: float) -> DataFrame:
    """(source, size, target): as ``source_targets``, for any number of sources."""
    ordered = sources.withColumn("none", F.col("source").isNull())
    parts = max(2, math.ceil(ordered.count() / 1e6))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = common.cut(common.numbered(ordered, ["none", "source"], "place", parts).select("source", "size", weight.alias("weight"), (F.col("size") * F.lit(float(most))).alias("cap")))
    level, capped = total / table.agg(F.sum("weight")).first()[0], -1
    while True:  # the level rises as sources reach their caps
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, kept, rest = table.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - kept) / rest
    return table.select("source", "size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _planned_apart(patterns: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """(pattern, quotas, flow), from tables: each connected part of the network is solved in a task."""
    arcs = patterns.select("pattern", F.col("size").alias("words"), F.explode("pattern").alias("source"))
    total = patterns.agg(F.sum("size")).first()[0]
    targets = _targets(arcs.groupBy("source").agg(F.sum("words").alias("size")), weights, most, total)
    of = arcs.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    quotas = F.transform(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "size", "target"))), lambda x: F.struct(x["source"].alias("source"), x["size"].alias("size"), x["target"].alias("target")))
    known = common.cut(of.groupBy("pattern", "words").agg(quotas.alias("quotas")))
    code = lambda c: F.xxhash64(F.coalesce(F.concat(F.lit("="), c), F.lit("")))
    several = known.where(F.size("pattern") > 1)
    links = several.select(code(F.col("pattern")[0]).alias("src"), F.explode(F.slice("pattern", 2, 1 << 30)).alias("other")).select("src", code(F.col("other")).alias("dst"))
    parts = common.components(links)
    tied = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part"))
    marked = known.join(tied, code(F.col("pattern")[0]) == F.col("node"), "left").drop("node")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        network = {tuple(p): int(n) for p, n in zip(pdf["pattern"], pdf["words"], strict=True)}
        network = dict(sorted(network.items(), key=lambda x: [(s is None, s or "") for s in x[0]]))
        target = {s: float(t) for p, aims in zip(pdf["pattern"], pdf["aims"], strict=True) for s, t in zip(p, aims, strict=True)}
        flow = min_cost_flow(network, target, most)
        return pd.DataFrame({"pattern": pdf["pattern"], "flow": [flow[tuple(p)] for p in pdf["pattern"]]})

    alone = marked.where("part is null").select("pattern", "quotas", F.least(F.col("quotas")[0]["target"], F.col("words") * F.lit(float(most))).alias("flow"))
    rest = marked.where("part is not null")
    solved = rest.select("part", "pattern", "words", F.transform("quotas", lambda q: q["target"]).alias("aims")).groupBy("part").applyInPandas(solve, "pattern array<string>, flow double")
    return alone.unionByName(rest.select("pattern", "quotas").join(solved, "pattern"))


def result_names(columns: Sequence[str]) -> list[str]:
    """What ``mix_documents`` calls its four results beside these columns: with underscores in front of taken names."""
    return [common.free(columns, x) for x in ("__size", "__pattern", "__quotas", "__taken")]


def mix_documents(docs: DataFrame, size: Column, sources: Column, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with __size, __pattern (its sources, sorted), __quotas (their sizes and targets) and __taken.

    sources is an array of strings; a null or empty array means the null source.  See
    ``result_names`` for inputs that have such columns.
    """
    key = F.array_sort(F.array_distinct(F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    every = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), key.alias("pattern"), F.xxhash64(*every, F.lit(seed)).alias("order"))
    # sizes are counted here and once more where the rows are given out
    small = common.cut(base.select("size", "pattern", "order"))
    patterns = common.cut(small.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    few = patterns.count() <= MOST_PATTERNS and patterns.select(F.explode("pattern")).distinct().count() <= MOST_PATTERNS
    plan = _planned_here(patterns, weights, most) if few else _planned_apart(patterns, weights, most)
    rounds = F.when(F.col("size") > 0, F.least(F.lit(most), F.floor((F.col("flow") + 1e-6) / F.col("size")))).otherwise(most).cast("int")
    plan = patterns.join(plan, "pattern").withColumn("rounds", rounds)
    part = F.when(F.col("rounds") < most, F.col("flow") - F.col("rounds") * F.col("size")).otherwise(0.0)
    plan = common.cut(plan.select("pattern", "quotas", "rounds", "rows", F.when(part >= 1, part).otherwise(0.0).alias("limit")))
    hint = F.broadcast if few else (lambda df: df)  # MOST_PATTERNS rows at most

    # where a pattern's part ends: a bucket, a bucket of that, and so on
    inside = small.join(hint(plan.where("limit > 0").select("pattern", "limit", "rows")), "pattern").withColumn("base", F.lit(0.0))
    edges = plan.where("limit > 0").select("pattern")
    largest = plan.where("limit > 0").agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    cuts = max(1, math.ceil(math.log(max(largest / BUCKET_ROWS, 2)) / math.log(MOST_BUCKETS)))
    for k in range(cuts):
        inside = inside.withColumn("bucket", _bucket(k))
        sums = inside.groupBy("pattern", "bucket").agg(F.sum("size").alias("in"), F.count(F.lit(1)).alias("left"), F.first("limit").alias("limit"), F.first("base").alias("base"))
        before = F.col("base") + F.coalesce(F.sum("in").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = sums.withColumn("before", before).where("before < limit and before + in >= limit")
        edge = common.cut(edge.groupBy("pattern").agg(F.min("bucket").alias("edge"), F.min_by("before", "bucket").alias("base"), F.min_by("left", "bucket").alias("rows")))
        inside = inside.drop("base", "rows").join(hint(edge), "pattern").where("bucket = edge").drop("edge")
        edges = edges.join(edge.select("pattern", F.col("edge").alias(f"edge{k}"), F.col("rows").alias(f"rows{k}")), "pattern", "left")
    last = inside.groupBy("pattern", "order", "size", "limit", "base").agg(F.count(F.lit(1)).alias("copies"))
    decided = common.cut(last.groupBy("pattern").applyInArrow(_fitting, "order long, size long, share double"))
    decided = decided.select("order", "share")
    decided = F.broadcast(decided) if decided.count() <= MOST_DECISIONS else decided

    given = base.join(hint(plan.join(edges, "pattern", "left")), "pattern").join(decided, "order", "left")
    # before the edge a document goes, after it not; at the edge of the last cut its own decision counts
    extra = F.when(F.pmod(F.xxhash64("order", F.monotonically_increasing_id()), F.lit(1 << 20)) < F.coalesce("share", F.lit(0.0)) * (1 << 20), 1).otherwise(0)
    for k in reversed(range(cuts)):
        at = _bucket(k, F.col("rows") if k == 0 else F.col(f"rows{k - 1}"))
        extra = F.when(at < F.col(f"edge{k}"), 1).when(at == F.col(f"edge{k}"), extra).otherwise(0)
    extra = F.when((F.col("limit") > 0) & F.col("edge0").isNotNull(), extra).otherwise(0)
    s, p, q, t = result_names(docs.columns)
    return given.select("row.*", F.col("size").alias(s), F.col("pattern").alias(p), F.col("quotas").alias(q), (F.col("size") * (F.col("rounds") + extra)).cast("long").alias(t))


def _bucket(k: int, rows: Column | None = None) -> Column:
    """A document's bucket of the k-th cut of so many rows."""
    rows = F.col("rows") if rows is None else rows
    return F.pmod(F.xxhash64("order", F.lit(k)), F.least(F.lit(MOST_BUCKETS).cast("long"), F.floor(rows / BUCKET_ROWS) + 1))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.cut(common.table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")))
    mixed = mix_documents(docs, F.col("words"), F.array("source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__quotas")[0]["size"].alias("source_size"), F.col("__quotas")[0]["target"].alias("target"), F.col("__taken").alias("taken"))
