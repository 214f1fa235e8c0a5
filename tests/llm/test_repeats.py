import hashlib

import numpy as np

from formspark.llm import repeats


def brute(rows, length):
    """rows are (id, text) in any order; equal rows are one document."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i, t]) for i, t in rows), key=str)


def run(spark, rows, length=100):
    out = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length)
    return sorted(((None if r["doc"] == repeats._LAST else r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()), key=str)


def noise(rng, n):
    return "".join(rng.choice(list("abcdefgh éü,."), n))


def test_planted_passages(spark):
    rng = np.random.default_rng(0)
    passage, other = noise(rng, 180), noise(rng, 101)
    rows = [(i, noise(rng, 150) + (passage if i % 2 else other) + noise(rng, 60) + (passage[30:150] if i % 3 == 0 else "")) for i in range(20)]
    rows += [(50, rows[3][1]), (51, rows[3][1][:-1] + "!")]  # a copy, and nearly one
    rows += [(60, noise(rng, 20) + "ha" * 300), (61, "ha" * 80 + noise(rng, 30)), (62, "x" * 99), (63, "x" * 99)]
    for length in (100, 150):
        assert run(spark, rows, length) == brute(rows, length)


def test_defined_cases(spark):
    rng = np.random.default_rng(1)
    a, b = noise(rng, 240), noise(rng, 260)
    rows = [(1, a), (1, a), (2, None), (3, ""), (None, a), (4, "short"), (5, b), (6, a + b)]
    assert run(spark, rows) == brute(rows, 100)
    assert run(spark, []) == []


def test_windows_by_digits_match_a_dictionary():
    rng = np.random.default_rng(2)
    data = np.frombuffer("".join(rng.choice(list("ab"), 4000)).encode(), np.uint8)
    windows = np.arange(0, 3900)
    for length in (30, 100):
        kind = repeats.repeated_windows(data, windows, length)
        by = {}
        for w in windows:
            by.setdefault(data[w : w + length].tobytes(), []).append(w)
        for own in by.values():
            assert (len(set(kind[own])) == 1) and ((kind[own[0]] >= 0) == (len(own) > 1))
        assert len(set(kind[kind >= 0])) == sum(len(x) > 1 for x in by.values())


def test_cut_texts_keep_columns_and_characters(spark):
    rng = np.random.default_rng(3)
    p = "é" * 3 + noise(rng, 200)
    rows = [(1, "A" + p, "x", 1), (2, "é" + p[1:] + "Z", None, 2), (3, None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, doc int")
    out = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    assert out[1]["text"] == "A" + p and out[1]["n_bytes"] == "x" and out[3]["text"] is None
    assert "Z" in out[2]["text"] and "�" not in out[2]["text"] and len(out[2]["text"]) < 10
    assert out[2].asDict().keys() == set(df.columns)


def test_common_lines_in_many_contexts(spark):
    rng = np.random.default_rng(7)
    line, passage = noise(rng, 70), noise(rng, 300)
    rows = [(i, noise(rng, 130) + line + noise(rng, 110)) for i in range(60)] + [(100 + i, noise(rng, 90) + passage + noise(rng, 90)) for i in range(60)]
    rows += [(200 + i, noise(rng, 300)) for i in range(60)] + [(300 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "0L as tie", "text")
    assert len(repeats._common_grams(df, len(rows), 100)) > 0
    assert run(spark, rows) == brute(rows, 100)


def test_long_texts_are_scanned_in_pieces(spark):
    rng = np.random.default_rng(8)
    long = noise(rng, 700_000)
    rows = [(1, long), (2, noise(rng, 40) + long[100_000:400_000] + noise(rng, 30)), (3, long[262_000:262_300])]
    assert run(spark, rows) == brute(rows, 100)


def test_columns_with_any_names(spark):
    rng = np.random.default_rng(9)
    p = noise(rng, 200)
    df = spark.createDataFrame([(1, p, 7, "a"), (2, "x" + p, 8, "b"), (2, "x" + p, 9, "c"), (None, p, None, None)], "doc_id long, text string, __doc long, __tie string")
    out = repeats.remove_repeats(df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert out.columns == df.columns
    assert got == sorted([(1, p, 7, "a"), (2, "x", 8, "b"), (2, "x", 9, "c"), (None, "", None, None)], key=str)
    assert repeats.repeats(df).count() == 4


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, repeats.op10_repeats(spark, sf).collect()), key=str) == brute(rows, 100)


def test_sample_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows, 100)
