import numpy as np
import pytest

from formspark.llm import common


def links_of(rng):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(5000 + i, 4999) for i in range(300)]
    loose = [tuple(map(int, p)) for p in rng.integers(10_000, 11_000, (400, 2))]
    return chain + star + loose + [(1, 1), (7, None), (-3, 2), (2, -3)]


def plain(links):
    links = [p for p in links if None not in p]
    a, b = common.forest(np.array([p[0] for p in links]), np.array([p[1] for p in links]))
    return dict(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_classes_by_rounds_and_in_one_task(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(common, "TASK_LINKS", in_one_task, raising=False)
    links = links_of(np.random.default_rng(1))
    found = [tuple(r) for r in common.components(spark.createDataFrame(links, "src long, dst long").repartition(3)).collect()]
    assert len(found) == len(dict(found)) and dict(found) == plain(links)
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_few_links_cost_no_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    spark.sparkContext.setJobGroup("few links", "")
    found = common.components(chain).count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext.setJobGroup("", "")
    assert found == 300 and len(jobs) <= 8
