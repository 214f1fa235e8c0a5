import pytest
from pyspark.sql import functions as F

from formspark.llm import mixing


def water(sizes, weights=(1, 2, 3), most=3, total=None):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left = {}, float(sum(sizes.values()) if total is None else total)
    free = list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 5, None: 40}, {"x": 0, "y": 7}, {"only": 5}])
def test_targets(sizes):
    assert mixing.source_targets(sizes) == pytest.approx(water(sizes))


def test_flow_spreads_repeats_and_fills_overlaps():
    patterns = {("a",): 10, ("a", "b"): 20, ("b",): 5}
    flow = mixing.min_cost_flow(patterns, {"a": 20.0, "b": 30.0}, 3)
    assert sum(flow.values()) == pytest.approx(50)
    # cheapest: all once (35), then 15 more twice; nothing three times
    assert all(flow[p] <= 2 * n + 1e-9 for p, n in patterns.items())
    assert mixing.min_cost_flow({("a",): 4}, {"a": 100.0}, 3) == {("a",): 12.0}


def mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix_documents(df, mixing.word_count(F.col("text")), F.array("source"))
    return out.select("doc_id", "source", "size", F.col("__size"), F.col("__quotas")[0]["target"].alias("target"), F.col("__taken")).collect()


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (i * 37 % 90 + 1), None if i % 7 == 0 else f"s{i % 5 if i % 3 else 0}", "keep") for i in range(3000)]
    out = mix(spark, rows)
    assert len(out) == 3000 and all(r["size"] == "keep" for r in out)
    taken, size, target = {}, {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["__taken"]
        size[r["source"]] = size.get(r["source"], 0) + r["__size"]
        target[r["source"]] = r["target"]
        assert r["__taken"] % max(1, r["__size"]) == 0 and r["__taken"] <= 3 * r["__size"]
    assert target == pytest.approx(water(size))
    for s in size:
        assert abs(taken[s] - target[s]) <= 5
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mix(spark, list(reversed(rows)))), key=str)


def test_defined_cases(spark):
    rows = [(1, None, "a", ""), (None, "x y z", "a", ""), (2, "", None, ""), (3, "p q", "b", ""), (3, "p q", "b", "")]
    out = mix(spark, rows)
    assert len(out) == 5 and {r["__taken"] for r in out if r["__size"] == 0} == {0}
    assert mix(spark, []) == []


def test_flow_is_the_cheapest_of_all_on_small_nets():
    import itertools

    for sizes, quotas in [((2, 1, 2), (3, 2)), ((1, 2, 1), (4, 1)), ((3, 1, 0), (2, 5)), ((1, 1, 3), (3, 3))]:
        patterns = dict(zip([("a",), ("a", "b"), ("b",)], sizes, strict=True))
        aims = dict(zip("ab", map(float, quotas), strict=True))
        best = None
        ways = [[(x, y) for x in range(2 * n + 1) for y in range(2 * n + 1 - x)] if len(p) > 1 else [(x, 0) if p == ("a",) else (0, x) for x in range(2 * n + 1)] for p, n in patterns.items()]
        for way in itertools.product(*ways):
            if sum(x for x, _ in way) <= quotas[0] and sum(y for _, y in way) <= quotas[1]:
                words = sum(map(sum, way))
                cost = sum(min(sum(w), n) + 2 * max(0, sum(w) - n) for w, n in zip(way, sizes, strict=True))
                if best is None or (words, -cost) > best:
                    best = (words, -cost)
        flow = mixing.min_cost_flow(patterns, aims, 2)
        cost = sum(min(flow[p], n) + 2 * max(0, flow[p] - n) for p, n in patterns.items())
        assert (sum(flow.values()), -cost) == pytest.approx(best)


def test_nearest_sums():
    import itertools

    for sizes, target in [([5, 9, 14, 30], 20), ([7], 3), ([7], 4), ([], 5), ([3, 3, 8], 100), ([10, 20, 40], 0)]:
        chosen = mixing.nearest_sum(sizes, target)
        every = [sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)]
        assert abs(sum(sizes[i] for i in chosen) - target) == min(abs(x - target) for x in every) and len(set(chosen)) == len(chosen)


def overlapping(spark):
    rows = [(i, "w " * (i * 31 % 70 + 1), [None, ["a"], ["a", "b"], ["b", "c"], ["d"], ["e", "d"], ["f"], []][i % 8]) for i in range(1600)]
    return spark.createDataFrame(rows, "doc_id long, text string, of array<string>").withColumn("__pattern", F.lit("mine"))


def test_overlaps_from_tables_equal_those_from_the_driver(spark, monkeypatch):
    df = overlapping(spark)
    names = mixing.result_names(df.columns)
    assert names[1] == "___pattern"

    def totals():
        out = mixing.mix_documents(df, mixing.word_count(F.col("text")), F.col("of"))
        assert out.columns == [*df.columns, *names] and {r[0] for r in out.select("__pattern").distinct().collect()} == {"mine"}
        rows = out.groupBy("___pattern").agg(F.sum("__taken").alias("t"), F.sum("__size").alias("n"), F.max("__quotas").alias("q"), F.count("*").alias("rows")).collect()
        return {tuple(r["___pattern"]): (r["t"], r["n"], r["rows"], [(q["source"], q["size"], round(q["target"], 6)) for q in r["q"]]) for r in rows}

    here = totals()
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    apart = totals()
    for p, (taken, *rest) in here.items():
        assert apart[p][1:] == tuple(rest) and taken <= 3 * rest[0]
    assert sum(t for t, *_ in here.values()) == pytest.approx(sum(t for t, *_ in apart.values()), abs=20)
    sizes = {s: n for *_, q in here.values() for s, n, _ in q}
    assert {s: t for *_, q in here.values() for s, _, t in q} == pytest.approx(water(sizes, total=sum(n for _, n, *_ in here.values())))


def test_buckets_are_cut_again_and_equal_rows_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "MOST_BUCKETS", 4)
    rows = [(i, "w " * (i * 37 % 90 + 1), f"s{i % 2}", "") for i in range(1500)] + [(7, "x y z", "s1", "")] * 900
    taken, target = {}, {}
    for r in mix(spark, rows):
        taken[r["source"]] = taken.get(r["source"], 0) + r["__taken"]
        target[r["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s]


def test_query_against_brute_force(spark):
    import re

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target, taken = water(sizes), {}
    out = mixing.op1_mixing(spark, sf).collect()
    for r in out:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    assert len(out) == len(docs) and all(abs(taken[s] - target[s]) <= max(0.01 * target[s], 30) for s in sizes)
