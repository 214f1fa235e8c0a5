import corpus_pipeline
from tests.llm import test_jaccard, test_packing, test_repeats

SF = "/root/testdata/sf0.001"


def test_stages_hold_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert len(rows) == len(kept)  # all of these documents have a language
        elif name == "ngram_join":
            classes = test_jaccard.brute([(r["doc_id"], r["text"]) for r in kept], 5, 80)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _, c in classes if i == c)
        elif name == "repeated_passages":
            exact = {i: n - gone for i, n, gone, *_ in test_repeats.brute([(r["doc_id"], r["text"]) for r in kept], corpus_pipeline.PASSAGE_BYTES)}
            for r in rows:  # a character at a span's edge may stay whole
                assert 0 <= len(r["text"].encode()) - exact[r["doc_id"]] <= 6 * 50 and r["n_chars"] == len(r["text"])
        elif name == "mixture":
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in kept}
            taken, times = {}, {}
            for r in rows:
                taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
            for s, target in brute_mixture(kept).items():
                assert abs(taken[s] - target) <= max(0.02 * target, 40)
            assert max(times.values()) <= 3
        else:
            fill, own = {}, {}
            for r in rows:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
                own[r["doc_id"]] = own.get(r["doc_id"], 0) + r["length"]
            want = {}
            for r in kept:
                want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(test_packing.ids_of(r["text"]))
            assert own == want and max(fill.values()) <= 2048 and len(fill) <= -(-sum(want.values()) // 2048) + 1
        kept = rows
    assert sum(r["length"] for r in kept) > 0


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns: nothing raises, clean documents stay."""
    en = "the quick brown fox jumps over the lazy dog while many other animals of the forest look on and wonder"
    words = en.split()
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 60)), "en", f"s{i % 3}", 1) for i in range(1, 30)]
    rows += [(None, "for those who wander over hills and along the rivers there are " + en, "en", None, None), (None, None, None, None, None), (50, "", "en", "s0", 0), (51, "   ", None, "s1", 3)]
    rows += [(60, en * 3000, "en", "s2", 9), (1, rows[0][1], "en", "s1", 1), (1, rows[0][1], "en", "s1", 1), (61, en, None, "s2", None), (61, en + " again", "en", "s2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("__size", "__h", "__doc", "__text", "root", "row", "h", "id", "piece"):
        df = df.withColumn(c, df.doc_id if c == "__h" else df.lang)
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "packing":
            assert out.columns == df.columns
            schema = docs.schema
            docs = spark.createDataFrame([tuple(r) for r in rows], schema)
            ids = {r["doc_id"] for r in rows}
            assert {2, 3, 60} <= ids or name == "mixture"  # which may take a document no time
            if name == "ngram_join":
                assert sum(r["doc_id"] == 1 for r in rows) == 1 and None in ids
    assert sum(r["length"] for r in rows) > 0


def brute_mixture(kept):
    """Words of each source that a mix of one source a document takes."""
    from tests.llm import test_mixing

    sizes = {}
    for r in kept:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    return test_mixing.water(sizes)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
