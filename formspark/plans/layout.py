"""Queries of the layout operators over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formspark.operators import layout
from formspark.plans.registry import Tables, query

HOUR = 3600


def _seconds(c: str = "ts"):  # noqa: ANN202
    return F.unix_timestamp(F.col(c).cast("timestamp"))


_EVENTS = "(SELECT event_id, user_id, event_type, value, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", "ts", _seconds().alias("sec"))


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM {_EVENTS}),
    f AS (SELECT user_id, i, event_id, sec, sec AS anchor, CAST(1 AS BIGINT) AS row FROM o WHERE i = 1 UNION ALL
        SELECT o.user_id, o.i, o.event_id, o.sec, CASE WHEN o.sec - f.anchor > {6 * HOUR} THEN o.sec ELSE f.anchor END, f.row + CASE WHEN o.sec - f.anchor > {6 * HOUR} THEN 1 ELSE 0 END
        FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT event_id, user_id, row FROM f""")
def q_row_fold(t: Tables) -> DataFrame:
    return layout.anchored_rows(_events(t), ["user_id"], "sec", ["event_id"], 6 * HOUR).select("event_id", "user_id", "row")


def _runs(where: str, flag: str) -> str:
    return f"""SELECT event_id, user_id, CAST(sum(CASE WHEN coalesce({flag}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS BIGINT) AS run FROM (
        SELECT *, lag(sec) OVER w AS psec, lag(value) OVER w AS pvalue, lag(event_type) OVER w AS ptype FROM {_EVENTS} {where} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id))"""


@query(_runs("", f"sec - psec > {12 * HOUR} OR abs(value - pvalue) >= 20"))
def q_run_split(t: Tables) -> DataFrame:
    out = layout.islands(_events(t), ["user_id"], ["sec", "event_id"], lambda p: (F.col("sec") - p("sec") > 12 * HOUR) | (F.abs(F.col("value") - p("value")) >= 20), "run")
    return out.select("event_id", "user_id", "run")


@query(_runs("", "event_type <> ptype"))
def q_word_split(t: Tables) -> DataFrame:
    return layout.islands(_events(t), ["user_id"], ["sec", "event_id"], lambda p: F.col("event_type") != p("event_type"), "run").select("event_id", "user_id", "run")


@query(f"""SELECT user_id, run, CAST(count(*) AS BIGINT) AS cells, min(sec) AS first_sec, max(sec) AS last_sec FROM (SELECT r.*, e.sec FROM ({_runs("", f"sec - psec > {24 * HOUR}")}) r JOIN {_EVENTS} e USING (event_id)) GROUP BY ALL""")
def q_segment_merge(t: Tables) -> DataFrame:
    runs = layout.islands(_events(t), ["user_id"], ["sec", "event_id"], lambda p: F.col("sec") - p("sec") > 24 * HOUR, "run")
    return runs.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("cells"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


@query("""SELECT o_custkey, min(d) AS first_page, max(d) AS last_page, count(*) AS pages FROM (SELECT o_custkey, d, d - row_number() OVER (PARTITION BY o_custkey ORDER BY d) AS g FROM (
    SELECT DISTINCT o_custkey % 200 AS o_custkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS d FROM orders)) GROUP BY o_custkey, g""")
def q_page_ranges(t: Tables) -> DataFrame:
    days = t.orders.select((F.col("o_custkey") % 200).alias("o_custkey"), F.floor(_seconds("o_orderdate") / 86400).alias("d"))
    return layout.page_ranges(days, ["o_custkey"], "d")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '__' || n END AS id FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM (
    SELECT p_partkey, 'p1_tex_' || lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS base FROM part))""")
def q_id_dedupe(t: Tables) -> DataFrame:
    from formspark.functions.text import slug

    return layout.numbered_ids(t.part, F.concat(F.lit("p1_tex_"), slug(F.col("p_name"))), ["p_partkey"]).select("p_partkey", "id")


@query("""SELECT p_partkey, p_brand, CASE WHEN n = 1 THEN p_type ELSE p_type || ' (' || n || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)""")
def q_dup_label_suffix(t: Tables) -> DataFrame:
    return layout.numbered_labels(t.part.select("p_partkey", "p_brand", "p_type"), ["p_brand"], "p_type", ["p_partkey"]).select("p_partkey", "p_brand", "name")


SPECS = [(1, "2"), (2, "1,3"), (3, "2-4"), (4, "1,4-6"), (5, "all"), (6, ""), (7, "6-2, 9,40"), (8, "3,3,1-2")]


@query(f"""WITH s(id, spec) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in SPECS)}),
    p AS (SELECT id, unnest(string_split(CASE WHEN trim(spec) = '' OR lower(trim(spec)) = 'all' THEN '1-9' ELSE replace(spec, ' ', '') END, ',')) AS p FROM s),
    r AS (SELECT id, CAST(split_part(p, '-', 1) AS INT) AS a, CAST(coalesce(nullif(split_part(p, '-', 2), ''), p) AS INT) AS b FROM p WHERE p <> '')
    SELECT DISTINCT CAST(id AS INT) AS id, CAST(page AS INT) AS page FROM (SELECT id, unnest(range(least(a, b), greatest(a, b) + 1)) AS page FROM r) WHERE page BETWEEN 1 AND 9""")
def q_parse_pages(t: Tables) -> DataFrame:
    from formspark.sources.pages import selected_pages

    return selected_pages(t.values(SPECS, "id int, spec string"), ["id"], "spec", 9)


@query("""SELECT e.event_id, coalesce(s.event_id, -1) AS section FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def q_section_asof(t: Tables) -> DataFrame:
    heads = t.events.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("section"))
    return layout.last_before(t.events, heads, ["user_id"], "ts", "ts", "section").select("event_id", F.coalesce("section", F.lit(-1)).alias("section"))


@query("""SELECT o_orderkey, CAST(count(*) AS BIGINT) AS labels, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 7 DAY AND o_orderdate + INTERVAL 7 DAY GROUP BY o_orderkey""")
def q_label_range_join(t: Tables) -> DataFrame:
    week = F.expr("INTERVAL 7 DAYS")
    near = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("l_shipdate").between(F.col("o_orderdate") - week, F.col("o_orderdate") + week))
    return near.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("labels"), F.min("l_linenumber").alias("first_line"))


_CELLS = [("c1", 0, 0, 10, 200), ("c2", 10, 0, 20, 200), ("c3", 22, 50, 30, 100), ("c4", 28, 0, 50, 60)]


@query("""SELECT event_id, box FROM (SELECT event_id, box, row_number() OVER (PARTITION BY event_id ORDER BY box) AS n FROM events JOIN (VALUES ('c1', 0, 0, 10, 200), ('c2', 10, 0, 20, 200), ('c3', 22, 50, 30, 100), ('c4', 28, 0, 50, 60)) b(box, x0, y0, x1, y1)
    ON event_id % 53 BETWEEN x0 - 1 AND x1 + 1 AND value BETWEEN y0 - 3 AND y1 + 3) WHERE n = 1""")
def q_grid_hint_first(t: Tables) -> DataFrame:
    points = t.events.select("event_id", F.lit(1).alias("page"), (F.col("event_id") % 53).cast("double").alias("x"), F.col("value").alias("y"))
    boxes = t.values([(b, *map(float, r)) for b, *r in _CELLS], "box string, x0 double, y0 double, x1 double, y1 double").withColumn("page", F.lit(1))
    return layout.first_in(layout.contained(points, boxes, ["page"], margin_x=1, margin_y=3), ["event_id"], ["box"]).select("event_id", "box")


@query("""SELECT CAST(count(*) AS BIGINT) AS ink, box FROM events JOIN (VALUES ('c1', 0, 0, 10, 200), ('c2', 10, 0, 20, 200), ('c3', 22, 50, 30, 100), ('c4', 28, 0, 50, 60)) b(box, x0, y0, x1, y1) ON event_id % 53 BETWEEN x0 AND x1 AND value BETWEEN y0 AND y1 GROUP BY box""")
def q_ink_count(t: Tables) -> DataFrame:
    points = t.events.select("event_id", F.lit(1).alias("page"), (F.col("event_id") % 53).cast("double").alias("x"), F.col("value").alias("y"))
    boxes = t.values([(b, *map(float, r)) for b, *r in _CELLS], "box string, x0 double, y0 double, x1 double, y1 double").withColumn("page", F.lit(1))
    return layout.contained(points, boxes, ["page"]).groupBy("box").agg(F.count(F.lit(1)).alias("ink"))


@query("""SELECT event_id, box, round(distance, 6) AS distance FROM (SELECT event_id, box, distance, row_number() OVER (PARTITION BY event_id ORDER BY distance, box) AS n FROM (
    SELECT event_id, box, sqrt(pow(greatest(x0 + 1 - x, x - x1 + 1, 0), 2) + pow(greatest(y0 + 1 - y, y - y1 + 1, 0), 2)) AS distance FROM (SELECT event_id, event_id % 53 AS x, value AS y FROM events)
    CROSS JOIN (VALUES ('c1', 0, 0, 10, 200), ('c2', 10, 0, 20, 200), ('c3', 22, 50, 30, 100), ('c4', 28, 0, 50, 60)) b(box, x0, y0, x1, y1))) WHERE n = 1""")
def q_owner_nearest(t: Tables) -> DataFrame:
    points = t.events.select("event_id", (F.col("event_id") % 53).cast("double").alias("x"), F.col("value").alias("y"))
    return layout.owners(points, _CELLS).select("event_id", "box", F.round("distance", 6).alias("distance"))


def _nearest_sql(condition: str, distance: str = "a.sec - b.sec") -> str:
    return f"""SELECT event_id, nearest, distance FROM (SELECT a.event_id, b.event_id AS nearest, {distance} AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY {distance}, b.event_id) AS n
        FROM {_EVENTS} a JOIN {_EVENTS} b ON a.user_id = b.user_id AND {condition}) WHERE n = 1"""


def _near(t: Tables, reach: int, condition, distance) -> DataFrame:  # noqa: ANN001
    left, right = layout.near_band(_events(t), "sec", reach)
    return layout.nearest(left, right, ["user_id", "band"], condition, distance, ["event_id"], {"nearest": F.col("b.event_id"), "distance": distance}, ["event_id"])


def _a(c: str):  # noqa: ANN202
    return F.col(f"a.{c}")


def _b(c: str):  # noqa: ANN202
    return F.col(f"b.{c}")


def _apart():  # noqa: ANN202
    return _a("sec") - _b("sec")


@query(_nearest_sql(f"a.event_type = b.event_type AND a.sec - b.sec > 0 AND a.sec - b.sec < {24 * HOUR}"))
def q_nearest_above(t: Tables) -> DataFrame:
    return _near(t, 24 * HOUR, (_a("event_type") == _b("event_type")) & (_apart() > 0) & (_apart() < 24 * HOUR), _apart())


@query(_nearest_sql(f"b.event_type <> a.event_type AND a.sec - b.sec > 0 AND a.sec - b.sec < {8 * HOUR}"))
def q_nearest_left(t: Tables) -> DataFrame:
    return _near(t, 8 * HOUR, (_a("event_type") != _b("event_type")) & (_apart() > 0) & (_apart() < 8 * HOUR), _apart())


@query(_nearest_sql(f"a.event_type = 'purchase' AND b.event_type = 'click' AND a.sec - b.sec > 0 AND a.sec - b.sec < {12 * HOUR}", "b.event_id"))
def q_specify_slot(t: Tables) -> DataFrame:
    return _near(t, 12 * HOUR, (_a("event_type") == "purchase") & (_b("event_type") == "click") & (_apart() > 0) & (_apart() < 12 * HOUR), _b("event_id"))


@query(_nearest_sql(f"a.event_type = b.event_type AND a.sec - b.sec > 0 AND a.sec - b.sec < {48 * HOUR} AND abs(a.value - b.value) <= 1.5", "b.event_id"))
def q_mirror_pairs(t: Tables) -> DataFrame:
    return _near(t, 48 * HOUR, (_a("event_type") == _b("event_type")) & (_apart() > 0) & (_apart() < 48 * HOUR) & (F.abs(_a("value") - _b("value")) <= 1.5), _b("event_id"))


@query(_nearest_sql(f"a.event_type = b.event_type AND a.sec - b.sec >= 0 AND a.sec - b.sec < {36 * HOUR} AND a.event_id <> b.event_id AND least(a.value, b.value) / greatest(a.value, b.value) > 0.7 AND b.value - a.value >= 5"))
def q_continuation_links(t: Tables) -> DataFrame:
    ratio = F.least(_a("value"), _b("value")) / F.greatest(_a("value"), _b("value"))
    return _near(t, 36 * HOUR, (_a("event_type") == _b("event_type")) & (_apart() >= 0) & (_apart() < 36 * HOUR) & (_a("event_id") != _b("event_id")) & (ratio > 0.7) & (_b("value") - _a("value") >= 5), _apart())


@query("""SELECT r_name, p_size, r_name || ' / ' || p_size AS label FROM region CROSS JOIN (SELECT DISTINCT p_size FROM part)""")
def q_table_cells(t: Tables) -> DataFrame:
    cells = layout.table_cells(t.part.select("p_size").distinct(), t.region.select("r_name"))
    return cells.select("r_name", "p_size", F.concat_ws(" / ", "r_name", F.col("p_size").cast("string")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN n >= 3 AND w <= 21 THEN 'grid' WHEN h >= 20 AND w > 14 THEN 'block' WHEN w <= 14 THEN 'checkbox' ELSE 'text' END AS kind FROM (SELECT p_partkey, p_size AS w, p_partkey % 37 AS h, p_partkey % 5 AS n FROM part)""")
def q_box_kind(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", layout.box_kind(F.col("p_size"), F.col("p_partkey") % 37, F.col("p_partkey") % 5).alias("kind"))


@query("""SELECT vec_id, abs(embedding[1]) <= 0.12 AND abs(embedding[2] - 0.1) <= 0.12 AND abs(embedding[3]) <= 0.12 AS teal FROM embeddings""")
def q_color_match(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", layout.close_to(F.slice("embedding", 1, 3), [0.0, 0.1, 0.0], 0.12).alias("teal"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.004), 4) AS low, round(quantile_cont(l_extendedprice, 0.996), 4) AS high FROM lineitem GROUP BY l_returnflag""")
def q_trim_extent(t: Tables) -> DataFrame:
    q = F.percentile("l_extendedprice", F.array(F.lit(0.004), F.lit(0.996)))
    return t.lineitem.groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))


@query("""SELECT doc_id, n, coalesce(CASE WHEN regexp_matches(lead, 'holder\\s+of\\s+cnic$') THEN 'Undertaking - CNIC' WHEN regexp_matches(lead, 's/o,?\\s*d/o,?\\s*w/o$') THEN 'Undertaking - Father''s/Husband''s Name'
    WHEN regexp_matches(lead, '\\bas\\s+on$') THEN 'Undertaking - As on Date' WHEN regexp_matches(lead, '^i$') THEN 'Undertaking - Name of Applicant' END, nullif(lead, ''), 'Undertaking') AS label FROM (
    SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, trim(lower(parts[n])) AS lead FROM (SELECT o_orderkey, string_split_regex('I ____ s/o d/o w/o _____ holder of CNIC ________ as on ____ of ' || o_orderpriority || ' ______', '_{4,}') AS parts FROM orders) CROSS JOIN (SELECT unnest(range(1, 6)) AS n))""")
def q_blank_rules(t: Tables) -> DataFrame:
    from formspark.sources.pages import blank_labels

    lines = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("I ____ s/o d/o w/o _____ holder of CNIC ________ as on ____ of "), "o_orderpriority", F.lit(" ______")).alias("line"))
    return blank_labels(lines, ["doc_id"], "line").withColumn("n", F.col("n").cast("long"))


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 6 AS batch FROM orders")
def q_batching(t: Tables) -> DataFrame:
    return layout.batches(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 6).select("o_orderkey", "o_custkey", "batch")


@query()
def q_tolerance_dedupe(t: Tables) -> DataFrame:
    return layout.tolerant_distinct(t.events.select("event_id", "user_id", "value"), ["user_id"], ["value"], ["event_id"], 1.5)


@query()
def q_question_carry(t: Tables) -> DataFrame:
    asks = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.concat(F.lit("q "), "l_returnflag").alias("probe"), F.col("l_linestatus").alias("option"))
    return layout.carried_questions(asks, ["l_suppkey"], ["n"], "probe", "option")


@query()
def q_table_columns(t: Tables) -> DataFrame:
    cell = t.part.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("n"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 40.0).alias("x1"), F.col("p_retailprice").alias("y0"), F.when(F.col("p_partkey") % 9 == 0, F.col("p_name")).otherwise("").alias("label"))
    return layout.column_labels(cell, ["page"], ["y0", "n"])
