import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formspark.operators import images, layout, readers, records
from formspark.sources import pages
from formspark.streaming import jobs


def test_rows_follow_their_anchor_not_their_neighbour(spark):
    df = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate([0, 2, 3, 4, 6, 7.5, 20])], "page int, i int, y double")
    rows = [r["row"] for r in layout.anchored_rows(df, ["page"], "y", ["i"], 3.0).orderBy("i").collect()]
    assert rows == [1, 1, 1, 2, 2, 3, 4]


def test_tolerant_distinct_is_greedy(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 1.0, 2.0, 3.4])], "page int, i int, x double")
    assert [r["i"] for r in layout.tolerant_distinct(df, ["page"], ["x"], ["x"], 1.5).orderBy("i").collect()] == [0, 2]


def test_words_are_cut_at_gaps(spark):
    chars = [(1, i, c, float(x), x + 5.0, 10.0) for i, (c, x) in enumerate([("i", 0), ("s", 5), ("t", 11.1), ("h", 16), (" ", 21), ("e", 26)])]
    df = spark.createDataFrame(chars, "line int, i int, c string, x0 double, x1 double, size double")
    assert [r["text"] for r in layout.continuing_words(df, ["line"], ["i"], "x0", "x1", "c", "size").orderBy("x0").collect()] == ["is", "th", "e"]


def test_contained_across_bands(spark):
    rng = np.random.default_rng(0)
    points = [(1, i, *map(float, rng.uniform(0, 100, 2))) for i in range(300)]
    boxes = [(1, f"b{k}", *map(float, (x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 90)))) for k, (x, y) in enumerate(rng.uniform(0, 60, (8, 2)))]
    got = layout.contained(spark.createDataFrame(points, "page int, i int, x double, y double"), spark.createDataFrame(boxes, "page int, box string, x0 double, y0 double, x1 double, y1 double"), ["page"], band=7.0)
    want = {(i, b) for _, i, x, y in points for _, b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    assert {(r["i"], r["box"]) for r in got.collect()} == want and got.count() == len(want)


def test_pick_one_and_pick_many(spark):
    rows = [("q1", "a", 0.2, 0.3), ("q1", "b", 0.01, 0.3), ("q2", "a", 0.0, 0.05), ("q2", "b", 0.0, 0.04), ("q3", "a", 0.05, 0.0), ("q3", "b", 0.05, 0.0), ("lone", "a", 0.04, 0.0)]
    df = spark.createDataFrame(rows, "q string, o string, inner double, halo double")
    got = {(r["q"], r["o"]): (r["checked"], r["confidence"]) for r in records.resolve_options(df, ["q"], "inner", "halo", F.col("q") == "q3").collect()}
    assert got[("q1", "a")] == (True, "high") and got[("q1", "b")] == (False, "high")
    assert got[("q2", "a")] == (True, "low") and got[("q2", "b")] == (False, "low")  # seen around the box only
    assert got[("q3", "a")] == (True, "low") and got[("q3", "b")] == (True, "low") and got[("lone", "a")][0]


def test_edits_keep_the_first_original_and_revert(spark):
    log = [("d", "f", "1", "model", 1.0, False), ("d", "f", "l2345", "x", 2.0, False), ("d", "g", "2", "m", 1.0, False), ("d", "g", None, None, 2.0, True), ("d", "h", "12", "m", 1.0, False)]
    edits = records.current_edits(spark.createDataFrame(log, "doc string, field string, value string, original string, at double, reverted boolean"), ["doc", "field"])
    base = spark.createDataFrame([("d", f, "old", "postcode", "text", True, "", "vlm-page", "high", False) for f in "fgh"], "doc string, field string, value string, type string, kind string, valid boolean, note string, source string, confidence string, needs_review boolean")
    got = {r["field"]: r for r in records.overlay(base, edits, ["doc", "field"]).collect()}
    assert (got["f"]["value"], got["f"]["edited_from"], got["f"]["source"]) == ("12345", "model", "reviewer")
    assert (got["g"]["value"], got["g"]["edited"]) == ("old", False)
    assert got["h"]["needs_review"] and not got["h"]["valid"]


def test_cross_check_finds_each_rule(spark):
    rows = [("d", "p1_date_of_issue", "text", "01012020", 1, "", ""), ("d", "p1_date_of_expiry", "text", "01012019", 2, "", ""), ("d", "p1_date_of_birth", "text", "01012021", 3, "", ""), ("d", "p1_id_no", "text", "35810-0234568-4", 4, "", ""), ("d", "p1_m", "checkbox", "true", 5, "Male", "Gender"),
            ("d", "p1_f", "checkbox", "false", 6, "Female", "Gender"), ("d", "title_of_account", "text", "Ali Khan 12", 7, "", ""), ("d", "first_name", "text", "Sara", 8, "", ""), ("d", "last_name", "text", "Shah", 9, "", ""), ("e", "p1_date_of_issue", "text", "0101202x", 1, "", ""),
            ("f", "p1_date_of_issue", "text", "01012020", 1, "", ""), ("f", "p2_spouse_date_of_birth", "text", "01012021", 2, "", ""), ("f", "title_of_account", "text", "Al i", 3, "", ""), ("f", "first_name", "text", "Ali 2", 4, "", ""), ("f", "last_name", "text", "x", 5, "", "")]
    found = records.cross_check(spark.createDataFrame(rows, "doc string, field string, kind string, value string, ordinal int, label string, group string")).collect()
    assert len(found) == 5 and {r["doc"] for r in found} == {"d"}
    assert "CNIC ends in 4, which means female, but Gender is ticked Male" in {r["issue"] for r in found}


def test_names_probe_for_a_free_one(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", "a (2)", "b", "a"])], "s int, i int, label string")
    assert [r["name"] for r in layout.numbered_labels(df, ["s"], "label", ["i"]).orderBy("i").collect()] == ["a", "a (2)", "a (2) (2)", "b", "a (3)"]


def test_names_of_large_groups_null_labels_and_null_groups(spark):
    rng = np.random.default_rng(4)
    labels = [str(x) for x in rng.choice(["a", "a (2)", "a (2) (2)", "a (3)", "a (x)", "b", "b (2) ", "(2)"], 600)]
    rows = [(1, i, x) for i, x in enumerate(labels)] + [(2, i, "c") for i in range(20_000)] + [(None, 0, "d"), (None, 1, "d"), (3, 0, None), (3, 1, "e"), (3, 2, None), (3, 3, "e")]
    got = {(r["s"], r["i"]): r["name"] for r in layout.numbered_labels(spark.createDataFrame(rows, "s int, i int, label string"), ["s"], "label", ["i"]).collect()}
    taken = set()
    for i, x in enumerate(labels):
        n = 1
        while (name := x if n == 1 else f"{x} ({n})") in taken:
            n += 1
        taken.add(name)
        assert got[1, i] == name
    assert len(got) == len(rows) and got[2, 0] == "c" and all(got[2, i] == f"c ({i + 1})" for i in range(1, 20_000))
    assert [got[k] for k in [(None, 0), (None, 1), (3, 0), (3, 1), (3, 2), (3, 3)]] == ["d", "d (2)", None, "e", None, "e (2)"]


CELLS = "page int, n int, x0 double, x1 double, y0 double, label string"


def test_columns_take_the_nearest_label_above(spark):
    rng = np.random.default_rng(6)
    texts = ["", "", "", "", None, "head", "head (row 7)", "rate (row one)", "head (row 2) (row 3)", " (row 4)"]
    cells = [(1, i, float(rng.choice([0, 3, 6, 8.5, 20])), float(rng.choice([40, 44, 46, 52])), float(rng.integers(0, 60)), texts[rng.integers(0, len(texts))]) for i in range(400)] + [(1, 900, float("nan"), 40.0, 5.0, "lost"), (1, 901, 0.0, 40.0, float("nan"), ""), (1, 902, float("inf"), 40.0, 70.0, "")]
    got = {r["n"]: r["label"] for r in layout.column_labels(spark.createDataFrame(cells, CELLS), ["page"], ["y0", "n"]).collect()}
    cells = sorted(cells, key=lambda c: (np.isnan(c[4]), c[4], c[1]))
    labels = [c[5] or "" for c in cells]
    for i, (_, _, x0, x1, y0, _) in enumerate(cells):
        above = [j for j, (_, _, a, b, y, _) in enumerate(cells) if abs(a - x0) < 6 and abs((b - a) - (x1 - x0)) < 6 and y < y0 and labels[j]]
        if not labels[i] and above:
            base = re.sub(r"\s*\(row [0-9]+\)$", "", labels[max(above, key=lambda j: (cells[j][4], -j))])
            labels[i] = f"{base} (row {sum(x.startswith(base + ' (row') for x in labels) + 2})"
    assert got == {c[1]: x for c, x in zip(cells, labels, strict=True)}


def test_columns_of_a_large_page(spark):
    cells = [(1, i, float(i % 50), i % 50 + 40.0, float(i // 50), "top" if i < 50 else "") for i in range(30_000)]
    began = time.monotonic()
    got = {r["n"]: r["label"] for r in layout.column_labels(spark.createDataFrame(cells, CELLS), ["page"], ["y0", "n"]).collect()}
    assert time.monotonic() - began < 20 and all(got[i] == f"top (row {i - 48})" for i in range(50, 30_000))


def test_the_expected_page_is_trusted(spark):
    df = spark.createDataFrame([(1, 1, 30, 1), (1, 2, 100, 1), (2, 1, 24, 1), (2, 2, 24, 1), (2, 3, 90, 1), (3, 2, 5, 2), (3, 1, 5, 2)], "scan int, page int, inliers int, preferred int")
    got = {r["scan"]: (r["template"], r["inliers"], r["searched"]) for r in records.best_template(df, ["scan"], "inliers", "page", "preferred").collect()}
    assert got == {1: (1, 30, False), 2: (3, 90, True), 3: (2, 5, True)}


def test_whole_results(spark):
    fields = spark.createDataFrame([("d", "p1_a", 1, "S", "A", "text", "text", 1, "", "T", "", ""), ("d", "p1_b", 1, "S", "B", "text", "text", 2, "", "", "p1_a", ""), ("d", "p1_m", 1, "S", "Male", "checkbox", "", 3, "Gender", "", "", ""), ("d", "p1_f", 1, "S", "Female", "checkbox", "", 4, "Gender", "", "", "")], "doc string, field string, page int, section string, label string, kind string, type string, ordinal int, group string, table string, continuation_of string, select_mode string")
    index = spark.createDataFrame([("d", "p1_a", "strong", 5000, 0), ("d", "p1_b", "strong", 5000, 0)], "doc string, field string, ink_hint string, ink_px int, baseline_px int")
    reads = spark.createDataFrame([("d", "p1_a", "one,", "page", "m", False), ("d", "p1_b", "two", "with-parent", "m", False)], "doc string, field string, value string, source string, model string, disputed boolean")
    pages_ = spark.createDataFrame([("d", 1, ["few matches"])], "doc string, page int, problems array<string>")
    ticks = spark.createDataFrame([("d", "p1_m", True, 0.2, "high"), ("d", "p1_f", False, 0.0, "high")], "doc string, field string, checked boolean, score double, confidence string")
    out = records.assemble(fields, index, reads, pages_, ticks)
    assert out.count() == 4 and out.where("needs_review").count() == 4
    [whole] = records.result_documents(out, records.cross_check(out), pages_).collect()
    assert whole["document"] == "d" and len(whole["fields"]) == 4 and whole["cross_check"] == []
    assert whole["answers"] == {"S": {"T - A": ["one, two"], "Gender": ["Male"]}} and whole["alignment"][0]["problems"] == ["few matches"]


def test_doubtful_values_are_read_again(spark):
    items = [("d", 1, "bad", "Post/Zip Code", "postcode", 2, 5000, 0, "12", "77777"), ("d", 1, "gone", "Notes", "text", 3, 5000, 0, None, "found"), ("d", 2, "kept", "Post/Zip Code", "postcode", 5, 5000, 0, "1", "55555")]
    df = spark.createDataFrame(items, "doc string, page int, field string, label string, type string, ordinal int, ink_px int, baseline_px int, a string, c string")
    cache = spark.createDataFrame([("d", 2, "kept", "1", "page", "m", False)], "doc string, page int, field string, value string, source string, model string, disputed boolean")
    got = {r["field"]: (r["value"], r["source"]) for r in readers.run(df, cache, readers.EchoReader("a"), None, readers.EchoReader("c")).collect()}
    # a page that nothing was missing on is left as it is
    assert got == {"bad": ("77777", "retry"), "gone": ("found", "retry"), "kept": ("1", "page")}


def test_reading_resumes_and_takes_a_second_opinion(spark):
    items = [("d", 1, f"f{i}", "Post/Zip Code", "postcode", i, 5000 if i else 0, 0, "12345", "12346" if i % 2 else "x") for i in range(8)]
    df = spark.createDataFrame(items, "doc string, page int, field string, label string, type string, ordinal int, ink_px int, baseline_px int, a string, b string")
    cache = spark.createDataFrame([("d", 1, "f7", "kept", "page", "m", False)], "doc string, page int, field string, value string, source string, model string, disputed boolean")
    got = {r["field"]: r for r in readers.run(df, cache, readers.EchoReader("a"), readers.EchoReader("b", "ocr")).collect()}
    assert got["f7"]["value"] == "kept" and got["f0"]["source"] == "ink-gate" and len(got) == 8
    assert got["f1"]["value"] == "12346" and got["f1"]["disputed"] and got["f1"]["model"] == "ocr" and got["f2"]["value"] == "12345"
    assert records.forced(cache, "page", [2]).count() == 1 and records.forced(cache, "page", [1]).count() == 0 and records.forced(cache, "page", None).count() == 0


def test_page_selections(spark):
    specs = [(1, "2"), (2, "1,3"), (3, "4-2"), (4, "all"), (5, " "), (6, "9-12")]
    got = pages.selected_pages(spark.createDataFrame(specs, "id int, spec string"), ["id"], "spec", 5)
    by = got.groupBy("id").agg(F.sort_array(F.collect_list("page")).alias("p")).collect()
    assert {r["id"]: r["p"] for r in by} == {1: [2], 2: [1, 3], 3: [2, 3, 4], 4: [1, 2, 3, 4, 5], 5: [1, 2, 3, 4, 5]}
    with pytest.raises(Exception, match="not a page"):
        pages.selected_pages(spark.createDataFrame([(1, "x-2")], "id int, spec string"), ["id"], "spec", 5).collect()


def test_sinks_and_missing_sources(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "v"), ("a", 1, "w")], "field string, page int, value string")
    pages.write_csv(df, str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith("\ufeffpage,section,group,label,kind,type,value,raw,source,model,confidence,valid,needs_review,note,field\n".encode())
    assert raw.splitlines()[1].startswith(b"1,") and raw.splitlines()[1].endswith(b",a")
    pages.write_pages(df, str(tmp_path / "t"), ["page"])
    pages.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert pages.read_json(spark, str(tmp_path / "none"), "reads", required=False).count() == 0


def test_components_and_rules():
    ink = np.zeros((40, 120), bool)
    ink[5, 5:100] = True  # a printed rule
    ink[20:25, 10:14] = True
    ink[25, 14] = True  # touches at a corner
    ink[35, 60] = True
    labels = images.components(ink)
    assert len(np.unique(labels)) - 1 == 3 and labels[24, 13] == labels[25, 14]
    assert images.strip_rules(ink).sum() == ink.sum() - 95
    assert images.drop_specks(ink, 2).sum() == ink.sum() - 1


def test_components_match_flood_fill():
    rng = np.random.default_rng(1)
    ink = rng.random((30, 30)) < 0.4
    labels, seen, n = images.components(ink), np.zeros_like(ink), 0
    for y, x in zip(*np.nonzero(ink), strict=True):
        if seen[y, x]:
            continue
        n, todo, part = n + 1, [(y, x)], set()
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            part.add(labels[a, b])
            for c in range(max(0, a - 1), min(30, a + 2)):
                for d in range(max(0, b - 1), min(30, b + 2)):
                    if ink[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        assert len(part) == 1
    assert len(np.unique(labels[ink])) == n


def test_alignment():
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 100, (60, 2))
    h = np.array([[1.02, 0.03, 4], [-0.02, 0.98, -3], [1e-5, 2e-5, 1]])
    moved = images.project(h, points)
    moved[:15] += rng.uniform(20, 40, (15, 2))  # wrong matches
    found, inliers = images.robust_homography(points, moved)
    assert inliers == 45 and np.allclose(found, h, atol=1e-4)
    assert images.robust_homography(points[:10], moved[:10])[0] is None
    page = images.dilate(rng.random((64, 64)) < 0.02, 2)
    assert images.offset(page.astype(float), np.roll(page, (3, -5), (0, 1)).astype(float)) == (-5.0, 3.0)
    gray = np.where(page, 0, 255).astype(np.uint8)
    back = images.warp(images.warp(gray, np.array([[1, 0, 2], [0, 1, 3], [0, 0, 1.0]]), gray.shape), np.array([[1, 0, -2], [0, 1, -3], [0, 0, 1.0]]), gray.shape)
    assert (back[:-4, :-4] == gray[:-4, :-4]).all()


def test_ownership_and_measurement(spark):
    whose, far = images.ownership((20, 40), np.array([[2, 2, 10, 10], [25, 2, 35, 10]]))
    assert whose[5, 5] == 0 and whose[5, 30] == 1 and whose[5, 17] == 0 and far[5, 5] == 0
    ink = np.zeros((20, 40), bool)
    ink[4:6, 4:8] = True
    df = spark.createDataFrame(pd.DataFrame([(1, 20, 40, np.packbits(ink).tobytes())], columns=["page", "height", "width", "ink"]))
    got = {r["field"]: r for r in images.measured(df, {"a": (2, 2, 10, 10), "b": (25, 2, 35, 10)}, inset=1.0, halo=2.0).collect()}
    assert got["a"]["interior"] == pytest.approx(8 / 36) and got["b"]["interior"] == 0


def test_streamed_documents_are_there_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = jobs.documents_stream(spark, str(tmp_path / "in"), "doc long, text string")
    query = jobs.each_batch(stream, lambda df: df.groupBy("text").count(), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_streamed_edits(spark, tmp_path):
    edits = spark.createDataFrame([("f", "1", "m", "2024-01-01 10:00:00"), ("f", "2", "x", "2024-01-01 11:00:00")], "field string, value string, original string, at string").withColumn("at", F.to_timestamp("at"))
    edits.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edits.schema).parquet(str(tmp_path / "in"))
    query = jobs.edits_in_force(stream, ["field"]).writeStream.format("memory").queryName("edits_now").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["edit"], r["original"]) for r in spark.table("edits_now").collect()] == [("2", "m")]
