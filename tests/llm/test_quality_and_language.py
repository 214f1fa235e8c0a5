import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formspark.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.op5_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count() and out.score.between(0, 1).all()
    m = out[out.held_out].merge(labels, on="doc_id")
    rank, y = m.score.rank(), m.quality
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9 and (m.predicted == y).mean() > 0.9


def small_bags(rng):
    first, of = np.array([0, 2, 3, 9]), np.array([0, 0, 0, 1, 3, 4, 4, 8])
    return rng.normal(size=(9, quality.FEATURES)), first, rng.integers(0, quality.WORDS, len(of)), of


def test_gradient():
    rng = np.random.default_rng(0)
    model = quality.Attention()
    bags, y = small_bags(rng), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model._forward(*bags)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = model._gradient(*bags, y)
    for name, g in grad.items():
        flat, step = model.p[name].reshape(-1), 1e-6
        places = rng.choice(len(flat), min(5, len(flat)), replace=False) if name != "E" else [bags[2][0] * quality.WIDE, bags[2][-1] * quality.WIDE + 3]
        for i in places:
            keep = flat[i]
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_scores_equal_a_plain_forward_pass():
    import math

    model = quality.Attention()
    model.mean, model.scale = np.full(quality.FEATURES, 0.1), np.full(quality.FEATURES, 2.0)
    x, first, words, of = small_bags(np.random.default_rng(1))
    p = {k: v.tolist() for k, v in model.p.items()}
    dot = lambda row, m: [sum(a * m[i][j] for i, a in enumerate(row)) for j in range(len(m[0]))]
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        hidden, weights = [], []
        for i in range(a, b):
            own = [w for w, o in zip(words, of, strict=True) if o == i]
            mean = [sum(p["E"][w][j] for w in own) / max(1, len(own)) for j in range(quality.WIDE)]
            row = [(v - 0.1) / 2.0 for v in x[i]] + mean
            h = [math.tanh(v + c) for v, c in zip(dot(row, p["A"]), p["a"], strict=True)]
            gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(dot(h, p["V"]), dot(h, p["U"]), strict=True)]
            hidden.append(h)
            weights.append(math.exp(dot(gate, p["w"])[0]))
        z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
        want.append(1 / (1 + math.exp(-dot(z, p["c"])[0] - p["b"][0])))
    assert model.scores(x, first, words, of) == pytest.approx(want)


def test_long_texts_are_bags_of_all_their_passages():
    texts = pa.array(["short one", "word " * 150_000, None, "x " * 10])
    got = {}
    for x, first, words, of, rows in quality.bags(texts):
        for k, r in enumerate(rows.tolist()):
            got[r] = (first[k + 1] - first[k], int(((of >= first[k]) & (of < first[k + 1])).sum()))
    assert [got[i][1] for i in range(4)] == [2, 150_000, 0, 10]
    assert got[0][0] == got[2][0] == got[3][0] == 1 and 150_000 / 48 <= got[1][0] <= 150_000 / 48 + 10


def test_quality_defined_cases(spark):
    texts = [(i, ("good words here and there. " * 30) if i % 2 else ("BAD!! " * 90), i, 0.0) for i in range(80)]
    docs = spark.createDataFrame([*texts, (None, None, 0, 0.0), (900, "", 0, 0.0), (901, "\n\t", 0, 0.0), (902, "word " * 40_000, 0, 0.0), (1, "x", 0, 0.0)], "doc_id long, text string, h long, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = spark.sparkContext.broadcast(quality.fit(docs, labels, "doc_id", "text", "quality"))
    got = [r["s"] for r in docs.select(quality.score(model, F.col("text")).alias("s")).collect()]
    assert len(got) == 85 and all(0 <= s <= 1 for s in got) and got[1] > 0.7 > 0.3 > got[2]
    assert got[80] == got[81] == got[82]
    flat = quality.fit(docs, labels.where("quality = 1"), "doc_id", "text", "quality")
    assert flat.flat == 1.0
    assert quality.fit(docs, labels.limit(0), "doc_id", "text", "quality").flat == 0.5
    assert docs.limit(0).select(quality.score(model, F.col("text"))).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs.withColumn("known", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), F.col("text"), F.col("known"), F.col("source")).where("known is null").select("lang", "__language", "__accepted").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["__language"] and r["__accepted"] for r in rows]) > 0.98


def test_evidence_is_fused(spark):
    en, fr = "the cat and the dog were with the other ones ", "les chats avec leurs amis dans une maison "
    rows = [(i, en * 5, "en", "a.example.com") for i in range(60)] + [(100 + i, fr * 5, "fr", "b.example.fr") for i in range(60)]
    unsure = "zz"
    rows += [(200, unsure, None, "b.example.fr"), (201, unsure, None, "new.example.com"), (202, unsure, "fr-CA", None), (203, fr, None, "a.example.com"), (204, fr, "en", "a.example.com")]
    rows += [(300, None, "en", "a.example.com"), (301, "", "en", None), (302, "123 !!", None, None), (303, "漢字漢字漢字漢字" * 20, None, None), (None, en * 3, None, None), (303, en * 400, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string").withColumn("n", F.lit("clash"))
    got = {}
    for r in langid.identify(df, F.col("text"), F.col("lang"), F.col("host")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[200][0]["__language"] == "fr" and got[201][0]["__language"] == "en" and got[202][0]["__language"] == "fr"
    assert got[203][0]["__language"] == "fr"
    assert not any(got[i][0]["__accepted"] for i in (300, 301, 302))
    assert got[None][0]["__language"] == "en" and got[None][0]["__accepted"] and len(got[303]) == 2
    assert got[0][0]["n"] == "clash"


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r["__accepted"] for r in langid.identify(df, F.col("text"), F.col("lang")).collect()] == [False]
    assert langid.identify(df.limit(0), F.col("text"), F.col("lang")).count() == 0


def test_posterior_equals_a_plain_computation(spark):
    """The fusion, from the operator's own text likelihoods, by hand."""
    import math

    rows = [(i, t, lang, h) for i, (t, lang, h) in enumerate([("the cat and the dog were here again", "en", "a.x.com")] * 9 + [("les chats avec leurs amis dans la maison", "fr", "b.x.com")] * 5 + [("les chats avec leurs amis", "en", "c.y.fr"), ("the zz", None, "new.x.com"), ("zz zz", "fr", "lone"), ("zz cat", None, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    got = {r["doc_id"]: r for r in langid.identify(df, F.col("text"), F.col("lang"), F.col("host")).collect()}
    names, models = langid.train(df, F.col("text"), F.col("lang"))
    tables = [langid._dense(*m) for m in models]

    def text_scores(t):
        data = np.frombuffer(t.encode(), np.uint8)
        slot, _ = langid._grams(data, np.array([0, len(data)]))
        s = [float(table[slot].sum()) for table in tables] + [-len(slot) * langid.GRAM_BITS * math.log(2)]
        s = [langid.TEMPER * min(len(slot), langid.MOST_GRAMS) / len(slot) * v for v in s]
        return [v - max(s) for v in s]

    scores = {i: text_scores(t) for i, t, _, _ in rows}
    best = {i: int(np.argmax(s)) for i, s in scores.items()}
    n = len(names)
    every = [sum(b == k for b in best.values()) for k in range(n)]
    root = [(c + 1) / (len(rows) + n) for c in every]

    def shrunk(test, up):
        own = [sum(bool(best[i] == k and test(h)) for i, _, _, h in rows) for k in range(n)]
        return [(c + langid.STRENGTH * u) / (sum(own) + langid.STRENGTH) for c, u in zip(own, up, strict=True)]

    for i, _, lang, host in rows:
        prior = root
        if host and "." in host:
            suffix, domain = host.split(".")[-1], ".".join(host.split(".")[-2:])
            prior = shrunk(lambda h: h and "." in h and h.split(".")[-1] == suffix, prior)
            prior = shrunk(lambda h: h and "." in h and ".".join(h.split(".")[-2:]) == domain, prior)
        if host:
            prior = shrunk(lambda h: h == host, prior)
        says = [math.log((sum(best[j] == k and other == lang for j, _, other, _ in rows) + 0.5) / (every[k] + 0.5 * (n + 1))) if lang else 0.0 for k in range(n)]
        total = [a + math.log(b) + c for a, b, c in zip(scores[i], prior, says, strict=True)]
        sure = 1 / sum(math.exp(v - max(total)) for v in total)
        assert got[i]["__language"] == names[int(np.argmax(total))] and got[i]["__confidence"] == pytest.approx(sure)


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "the cat and the dog were with the other ones ", "en") for i in range(30)] + [(50, "the cat and the dog were with the other ones " * 20_000, "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string").withColumn("__language", F.lit("mine")).withColumn("__host", F.lit(None).cast("string"))
    out = langid.identify(df, F.col("text"), F.col("__text"), F.col("__host"))
    assert out.columns == [*df.columns, *langid.result_names(df.columns)] and "___language" in out.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[50]["__language"] == "mine" and got[50]["___language"] == "en" and got[50]["__accepted"] and not got[None]["__accepted"]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.identify_pages(pages).select("__language", F.regexp_extract("html", 'lang="([a-z]+)', 1).alias("declared")).collect()
    assert len(got) == pages.count() and np.mean([r["__language"] == r["declared"] for r in got]) > 0.98


def test_query_reads_documents_and_pages(spark):
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op6_langid(spark, SF).toPandas()
    assert len(got) == docs.count() + pages.count()
    assert set(got.doc_id.dropna()) == {r[0] for r in docs.select("doc_id").collect()}
    declared = {r["page_id"]: r["declared"] for r in pages.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)', 1).alias("declared")).collect()}
    of_pages = got[got.page_id.notna()]
    assert set(of_pages.page_id) == set(declared)
    assert np.mean([declared[i] == x and ok for i, x, ok in zip(of_pages.page_id, of_pages.language, of_pages.accepted)]) > 0.98


def test_every_declared_language_has_a_model(spark):
    rng = np.random.default_rng(1)
    words = {f"x{chr(97 + i // 26)}{chr(97 + i % 26)}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for i in range(70)}
    rows = [(name, " ".join(rng.permutation(own)), name if j else None) for name, own in words.items() for j in range(5)]
    df = spark.createDataFrame(rows, "truth string, text string, lang string")
    got = langid.identify(df, F.col("text"), F.col("lang")).collect()
    assert len(got) == 350 and all(r["__language"] == r["truth"] and r["__accepted"] for r in got)


def test_training_takes_distinct_texts(spark):
    few = [("xx", f"grosse {w} kleine") for w in ("haus", "baum", "stadt")]
    many = [("yy", f"petite maison {i}") for i in range(50)]
    copies = spark.createDataFrame(few * 3000 + many, "lang string, text string")
    once = spark.createDataFrame(few + many, "lang string, text string")
    got = [langid.train(x, F.col("text"), F.col("lang"), 4) for x in (copies, once)]
    assert got[0][0] == ["xx", "yy", "und"] and got[0] == got[1]
    # three texts of "xx" and four of "yy", each of them once
    for (_, counts), texts in zip(got[0][1], (3, 4)):
        assert langid.common.unpack(counts, "float64").max() == texts
