import numpy as np

from formspark.llm import common, vectors

SCHEMA = "vec_id long, embedding array<float>, label string, id int"


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in r], "l", 1) for i, r in enumerate(x)]


def brute(rows, cosine=0.9):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    place = {v: i for i, v in enumerate(ids)}
    good = [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    links, labels = dict.fromkeys(ids, 0), np.arange(len(ids))
    for i in range(len(good)):
        for j in range(i):
            if good[i][0] != good[j][0] and u[i] @ u[j] >= cosine:
                for k in (i, j):
                    links[good[k][0]] += 1
                labels = common.join_labels(labels, np.array([place[good[i][0]]]), np.array([place[good[j][0]]]))
    return {i: (links[i], ids[labels[place[i]]]) for i in ids}


def test_families_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 25)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base[i] + rng.normal(scale=s, size=(12, 16)) for i, s in enumerate((0.05, 0.2, 0.3, 0.35, 0.4))])
    x = np.concatenate([base, near, np.repeat(base[:1], 30, axis=0), 3 * base[1:4]]).astype(np.float32)
    rows = rows_of(x)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()}
    assert found == brute(rows)


def test_defined_cases(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, "", 0), (2, [0.0, 0.0, 0.0], "", 0), (3, None, "", 0), (4, [1.0, None, 0.0], "", 0), (5, [float("nan"), 1.0, 0.0], "", 0), (6, [float("inf"), 0.0, 0.0], "", 0), (7, e, "", 0), (None, e, "", 0), (8, [], "", 0), (20, e, "", 0)]
    out = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()), key=str)
    assert (1, 2, 1, True) in out and (7, 2, 1, False) in out and (2, 0, 2, True) in out and (None, 0, None, False) in out and len(out) == 10
    near = vectors.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    assert [tuple(r) for r in sorted(near)] == [(20, 1, 1, 1.0), (20, 2, 7, 1.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicates(none, "vec_id", "embedding").count() == 0 and vectors.nearest_neighbours(none, "vec_id", "embedding").count() == 0


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0], "", 0), (2, [2.0, 0.1], "", 0), (3, [1.0, 0.0, 0.0], "", 0), (20, [1.0, 0.1, 0.0], "", 0), (40, [1.0, 0.0], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, "vec_id", "embedding").collect()}
    assert found == {1: (2, 1), 2: (2, 1), 40: (2, 1), 3: (1, 3), 20: (1, 3)}
    near = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vectors.nearest_neighbours(df, "vec_id", "embedding").collect())
    assert near == [(20, 1, 3), (40, 1, 2), (40, 2, 1)]


def test_repeated_ids_and_rows(spark):
    e, f = [1.0, 0.0], [0.5, 0.5]
    rows = [(20, e, "", 0), (20, e, "", 0), (20, f, "", 0), (1, e, "", 0), (1, f, "", 0), (1, e, "", 0)]
    near = sorted(map(tuple, vectors.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()))
    assert near == [(20, 1, 1, 1.0)]


def test_a_family_of_a_third_of_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 60)
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 1 << 12)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 12)), np.repeat(rng.normal(size=(1, 12)), 50, axis=0), rng.normal(size=(1, 12)) + rng.normal(scale=0.05, size=(50, 12))]).astype(np.float32)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows_of(x), SCHEMA), "vec_id", "embedding").collect()}
    assert found == brute(rows_of(x))


def recall_and_work(spark, x, top=20):
    good, widths = vectors.usable(spark.createDataFrame(rows_of(x), SCHEMA), "vec_id", "embedding")
    out = vectors.candidates(good, widths[0], 20, top).toPandas()
    d, hit, asks = x.astype(float), 0, range(0, len(x), 20)
    for q in asks:
        score = d @ d[q]
        score[q] = -np.inf
        wanted = np.lexsort((np.arange(len(d)), -score))[:top]
        hit += len(set(wanted) & set(out[out.query_id == q].vec_id))
    return hit / (top * len(asks)), out.seen.sum() / len(asks)


def test_clustered_data_asks_for_little_work(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(150, 32)).repeat(40, axis=0) + rng.normal(scale=0.15, size=(6000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    recall, work = recall_and_work(spark, x[rng.permutation(len(x))])
    assert recall >= 0.9 and work < 0.35 * len(x)  # inner products a query, over all curves


def test_recall_on_a_table_larger_than_the_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect()
    x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], np.float32)
    recall, work = recall_and_work(spark, np.concatenate([x, x[::2] * 0.99, -x, x[:, ::-1]]))
    assert len(x) * 3.5 > vectors.SAMPLE and recall >= 0.9 and work < 2 * 3.5 * len(x)


def test_query_agrees_with_its_sql(spark):
    import duckdb

    from formspark.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    out = vectors.op2_neardup(spark, sf).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(queries.ORACLE["op2_neardup"]).fetchall())
    near = vectors.op3_neighbours(spark, sf).toPandas()
    assert near.groupby("query_id").size().eq(20).all() and near.columns.tolist() == ["query_id", "rank", "vec_id", "score"]


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 24)), rng.normal(size=(10, 24)).repeat(30, axis=0) + rng.normal(scale=0.1, size=(300, 24))]).astype(np.float32)
    out = vectors.nearest_neighbours(spark.createDataFrame(rows_of(x), SCHEMA), "vec_id", "embedding").toPandas()
    d, hit = x.astype(float), 0
    asks = range(0, len(x), 20)
    for q in asks:
        score = d @ d[q]
        score[q] = -np.inf
        wanted = np.lexsort((np.arange(len(d)), -score))[:20]
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, score[own.vec_id]) and (np.diff(own.score) <= 1e-12).all()
        hit += len(set(wanted) & set(own.vec_id))
    assert hit / (20 * len(asks)) >= 0.9


def test_hilbert_curve_visits_neighbours():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    place = vectors.hilbert(points, 3)
    assert sorted(place) == list(range(side**3))
    walk = points[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_vectors_without_structure_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    x = np.random.default_rng(8).normal(size=(1500, 64)).astype(np.float32)
    x[1000:1020] = x[:20] * 2
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    found = vectors.near_duplicates(df, "vec_id", "embedding")
    assert found.where("n_links > 0").count() == 40 and found.where("not kept").count() == 20
    assert written() - before < 3 * x.nbytes  # copies for every cell within reach: some 25 times
