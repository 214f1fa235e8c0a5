import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from formspark.llm import jaccard, textscan

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def brute(rows, width, percent):
    sets = defaultdict(list)
    sizes = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sizes.append((i, len(s)))
        if i is not None:
            sets[i].append(s)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    every = [(i, s) for i in sets for s in sets[i] if s]
    where = defaultdict(list)
    for n, (_, s) in enumerate(every):
        shared = Counter(m for t in s for m in where[t])
        for m, k in shared.items():
            if 100 * k >= percent * (len(s) + len(every[m][1]) - k):
                a, b = root(every[n][0]), root(every[m][0])
                up[max(a, b)] = min(a, b)
        for t in s:
            where[t].append(n)
    return sorted(((i, n, root(i) if i is not None else None) for i, n in sizes), key=str)


def run(spark, rows, width, percent):
    out = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), width=width, percent=percent)
    return sorted(map(tuple, out.collect()), key=str)


def edited(words, every, tag):
    return " ".join(f"{w}{tag}" if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_families_match_brute_force(spark, width, percent):
    base = [[f"w{(i * j * 7 + j) % 311}" for j in range(120)] for i in range(1, 5)]
    rows = [(100 * i + k, edited(b, 40 + 25 * k, f"x{k}")) for i, b in enumerate(base) for k in range(6)]
    rows += [(900 + k, " ".join(base[0])) for k in range(5)]  # exact copies
    rows += [(950, " ".join(base[1][:60] + base[2][60:]))]  # half and half
    assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_defined_cases(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one two"), (8, "ONE  two"), (None, "one two"), (7, "two one"), (1, "a b c d e"), (1, "q r s t u"), (2, "q r s t u"), (6, "a b c d e"), (6, "a b c d e")]
    found = run(spark, rows, 3, 90)
    assert found == brute(rows, 3, 90)
    assert (None, 1, None) in found
    assert (2, 3, 1) in found and (6, 3, 1) in found  # id 1 stands for two texts and joins both


def test_empty_table_and_clashing_names(spark):
    assert run(spark, [], 3, 90) == []
    df = spark.createDataFrame([(1, "a b c d", 7, "s"), (2, "a b c d", 8, "s")], "doc_id long, text string, n_shingles int, set_id string")
    assert [tuple(r) for r in jaccard.jaccard_components(df, width=3, percent=90).orderBy("doc_id").collect()] == [(1, 2, 1), (2, 2, 1)]
    assert [r["doc_id"] for r in jaccard.keep_one(df, width=3, percent=90).collect()] == [1]


@pytest.mark.parametrize("sets", [5, 12, 1000])
def test_long_text_and_large_family(spark, monkeypatch, sets):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 3000)  # the family becomes blocks
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    long = " ".join(f"t{i}" for i in range(150_000))
    family = [f"v{j}" for j in range(200)]
    rows = [(1, long), (2, long + " end")] + [(10 + k, edited(family, 150 + k, "z")) for k in range(40)]
    # a chain away from the family: each links with the next one only
    rows += [(100 + k, " ".join([f"a{k}{i}" for i in range(5 * k)] + family[5 * k :])) for k in range(1, 12)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_a_family_in_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    base = [f"c{j}" for j in range(90)]
    rows = [(k, edited(base, 20 + k, f"q{k % 7}")) for k in range(60)] + [(200 + k, " ".join(base)) for k in range(60)]
    rows += [(400 + k, " ".join(f"u{k * i % 97}x{i}" for i in range(60))) for k in range(200)]
    rows += [(700 + k, "common words in every one of these here " + " ".join(f"o{k}n{i}" for i in range(30))) for k in range(60)]
    for width, percent in ((3, 90), (5, 80)):
        assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_filter_keeps_each_true_pair_and_asks_for_every_order():
    rng = np.random.default_rng(4)
    for percent in (50, 80, 90):
        base = rng.integers(0, 2**63, (6, 60)).astype(np.uint64)
        own = [np.unique(np.concatenate([b[: 60 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for b in base for k in (0, 2, 4, 9, 20)]
        pairs = jaccard.Candidates(own, percent)
        every = np.unique(np.concatenate(own))
        count = {t: sum(t in s for s in map(set, own)) for t in every}
        orders = [{t: (count[t], t) for t in every}, {t: t for t in every}]
        orders += [{t: jaccard.mix64(np.array([t + np.uint64(k * 0x9E3779B1)]))[0] for t in every} for k in (2, 3)]
        passed = 0
        for i in range(len(own)):
            got = pairs.shared(i) > 0
            for j in range(len(own)):
                n = len(set(own[i]) & set(own[j]))
                firsts = [[set(sorted(s, key=o.__getitem__)[: len(s) - -(-percent * len(s) // 100) + 1]) for s in (own[i], own[j])] for o in orders]
                assert got[j] == all(a & b for a, b in firsts)
                assert got[j] or 100 * n < percent * (len(own[i]) + len(own[j]) - n)
                passed += got[j] and 100 * n < percent * (len(own[i]) + len(own[j]) - n)
        assert passed < len(own) ** 2 / 4


def test_keep_one_decides_by_row(spark):
    text = "a b c d e f g h"
    rows = [(None, text, "x"), (None, text, "y"), (4, text, "z"), (5, "one two three four", "k"), (5, "other words stand here", "k"), (6, "one two three four", "k"), (7, None, "n"), (7, None, "n"), (8, "same row twice here", "s"), (8, "same row twice here", "s"), (9, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(map(tuple, jaccard.keep_one(df, width=3, percent=90).collect()), key=str)
    # 5 stands for two texts and so for one class
    assert got == sorted([(4, text, "z"), (5, "one two three four", "k"), (7, None, "n"), (7, None, "n"), (8, "same row twice here", "s"), (9, "", "")], key=str) or (5, "other words stand here", "k") in got
    assert len(got) == 6
    only = spark.createDataFrame([(None, text, "x"), (None, text, "y"), (None, text + " i", "z")], "doc_id long, text string, h string")
    assert len(jaccard.keep_one(only, width=3, percent=50).collect()) == 1


def test_words_of_long_texts_are_those_of_short_ones():
    texts = ["a" * 100, "one two  three", " x ", "", "ab cd " * 50 + "y" * 70, "\té" * 40]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        starts, ends, _ = textscan.word_spans(textscan.lowered(data), np.array([0, len(data)]))
        want = textscan.span_hashes(textscan.lowered(data), starts, ends)
        for size in (1, 7, 16, 1000):
            assert textscan._long_words(data, size).tolist() == want.tolist()
    column = pa.array(["w%d v " % i * 30 for i in range(3)] + [" ".join(f"x{i % 50}" for i in range(400))])
    whole = [x for _, n, tok, row in textscan.shingle_sets(column, 3) for x in [(tok.tolist(), row.tolist())]]
    parts = {}
    for first, _, tok, row in textscan.shingle_sets(column, 3, size=64):
        for t, r in zip(tok.tolist(), row.tolist(), strict=True):
            parts.setdefault(first + r, []).append(t)
    want = {}
    for t, r in zip(whole[0][0], whole[0][1], strict=True):
        want.setdefault(r, []).append(t)
    assert parts == want


def test_query_agrees_with_its_sql(spark):
    import duckdb

    from formspark.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, jaccard.op9_jaccard(spark, sf).collect())) == sorted(con.execute(queries.ORACLE["op9_jaccard"]).fetchall())


def test_sample_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)
