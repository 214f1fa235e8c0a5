"""Queries of evidence, options, readings, records, corrections and scores over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.operators import records
from formspark.plans.registry import Tables, query


@query("""SELECT l_orderkey, l_linenumber, s >= 0.03 AND s = best AND s / greatest(total, 1e-9) >= 0.55 OR n = 1 AND s >= 0.03 AS checked FROM (
    SELECT l_orderkey, l_linenumber, s, max(s) OVER w AS best, sum(s) OVER w AS total, count(*) OVER w AS n FROM (
    SELECT *, CASE WHEN max(l_discount / 2) OVER (PARTITION BY l_orderkey) < 0.03 THEN l_tax ELSE l_discount / 2 END AS s FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey))""")
def q_competitive(t: Tables) -> DataFrame:
    options = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") / 2).alias("interior"), F.col("l_tax").alias("halo"))
    return records.resolve_options(options, ["l_orderkey"], "interior", "halo", F.lit(False)).select("l_orderkey", "l_linenumber", "checked")


@query("""SELECT l_orderkey, l_linenumber, checked, CASE WHEN checked THEN CASE WHEN NOT halo AND s / greatest(total, 1e-9) > 0.75 THEN 'high' ELSE 'low' END ELSE CASE WHEN s >= 0.015 THEN 'low' ELSE 'high' END END AS confidence FROM (
    SELECT *, CASE WHEN many OR n = 1 THEN s >= 0.03 ELSE s >= 0.03 AND s = best AND s / greatest(total, 1e-9) >= 0.55 END AS checked FROM (
    SELECT *, max(s) OVER w AS best, sum(s) OVER w AS total, count(*) OVER w AS n, bool_or(l_returnflag = 'R') OVER w AS many FROM (
    SELECT *, CASE WHEN halo THEN l_quantity / 512 ELSE l_quantity / 1024 END AS s FROM (SELECT *, max(l_quantity / 1024) OVER (PARTITION BY l_orderkey) < 0.03 AS halo FROM lineitem)) WINDOW w AS (PARTITION BY l_orderkey)))""")
def q_option_confidence(t: Tables) -> DataFrame:
    options = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") / 1024).alias("interior"), (F.col("l_quantity") / 512).alias("halo"))
    return records.resolve_options(options, ["l_orderkey"], "interior", "halo", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "checked", "confidence")


_INK = "CAST(floor(value * 100) AS BIGINT) - 200"


def _ink(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.floor(F.col("value") * 100) - 200).cast("long").alias("ink"), (F.col("event_id") % 7 * 500).alias("base"))


@query(f"SELECT event_id, ink, ink <> 0 AS needs_model FROM (SELECT event_id, {_INK} AS ink FROM events)")
def q_ink_gate(t: Tables) -> DataFrame:
    return _ink(t).select("event_id", "ink", records.needs_reader(F.col("ink")).alias("needs_model"))


@query(f"""SELECT event_id, CASE WHEN ink < 0 THEN '' WHEN ink <= 500 THEN 'blank' WHEN ink >= 4000 AND ink >= 3 * base THEN 'filled' ELSE '' END AS verdict FROM (SELECT event_id, {_INK} AS ink, event_id % 7 * 500 AS base FROM events)""")
def q_ink_verdict(t: Tables) -> DataFrame:
    return _ink(t).select("event_id", records.ink_verdict(F.col("ink"), F.col("base")).alias("verdict"))


_HINT = "CASE WHEN floor(l_quantity) % 5 = 0 THEN 'empty' WHEN l_quantity * 3 < 60 + 0.06 * l_linenumber * 100 THEN 'faint' ELSE 'strong' END"


def _hints(t: Tables) -> DataFrame:
    raw = F.when(F.floor("l_quantity") % 5 == 0, 0).otherwise(F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", records.ink_hint(raw, F.col("l_quantity") * 3, F.col("l_linenumber") * 100).alias("hint"))


@query(f"SELECT l_orderkey, l_linenumber, {_HINT} AS hint FROM lineitem")
def q_ink_hint(t: Tables) -> DataFrame:
    return _hints(t).select("l_orderkey", "l_linenumber", "hint")


@query(f"SELECT coalesce(l_returnflag, 'ALL') AS page, hint, count(*) AS n FROM (SELECT l_returnflag, {_HINT} AS hint FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, hint), (hint))")
def q_hint_totals(t: Tables) -> DataFrame:
    hints = _hints(t)
    totals = hints.groupingSets([["l_returnflag", "hint"], ["hint"]], "l_returnflag", "hint").agg(F.count(F.lit(1)).alias("n"))
    return totals.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("page"), "hint", "n")


@query("""SELECT l_orderkey, l_linenumber, array_to_string(p, '; ') AS problems, len(p) = 0 AS ok FROM (SELECT *, list_filter([CASE WHEN l_quantity < 25 THEN 'few matches' END, CASE WHEN 1 - l_discount * 4 < 0.8 THEN 'low coverage' END, CASE WHEN l_tax * 100 > 4 THEN 'offset too large' END], lambda x: x IS NOT NULL) AS p FROM lineitem)""")
def q_page_gate(t: Tables) -> DataFrame:
    p = records.page_problems(F.col("l_quantity"), 1 - F.col("l_discount") * 4, F.col("l_tax") * 100)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(p, "; ").alias("problems"), (F.size(p) == 0).alias("ok"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey, CAST(floor(l_quantity) AS BIGINT) AS inliers, min(l_partkey) OVER (PARTITION BY l_orderkey) AS preferred FROM lineitem),
    o AS (SELECT l_orderkey, preferred, max(inliers) FILTER (l_partkey = preferred) AS own FROM p GROUP BY ALL),
    b AS (SELECT l_orderkey, l_partkey, inliers, row_number() OVER (PARTITION BY l_orderkey ORDER BY inliers DESC, CAST(l_partkey = preferred AS INT) DESC, l_partkey) AS n FROM p)
    SELECT b.l_orderkey, CASE WHEN own >= 25 THEN preferred ELSE l_partkey END AS template, CASE WHEN own >= 25 THEN own ELSE inliers END AS inliers, own < 25 AS searched FROM b JOIN o ON o.l_orderkey = b.l_orderkey WHERE n = 1""")
def q_page_match(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    preferred = F.min("l_partkey").over(Window.partitionBy("l_orderkey"))
    probes = t.lineitem.select("l_orderkey", "l_partkey", F.floor(F.col("l_quantity")).alias("inliers"), preferred.alias("preferred"))
    return records.best_template(probes, ["l_orderkey"], "inliers", "l_partkey", "preferred")


@query("SELECT o_orderkey, o_custkey, row_number() OVER w AS claim, first_value(o_orderkey) OVER w AS first_claimer, row_number() OVER w > 1 AS duplicate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def q_duplicate_claim(t: Tables) -> DataFrame:
    return records.claims(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_missing_pages(t: Tables) -> DataFrame:
    return records.unread(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def q_cache_resume(t: Tables) -> DataFrame:
    return records.unread(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("SELECT doc_id, quality FROM labels WHERE NOT (doc_id % 9 + 1 IN (1, 4))")
def q_scoped_force(t: Tables) -> DataFrame:
    cache = t.labels.withColumn("page", F.col("doc_id") % 9 + 1)
    return records.forced(cache, "page", [1, 4]).select("doc_id", "quality")


_DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"
_MENDED = "regexp_replace(translate({c}, 'OoQDIl|iSsBZGbTA', '0000111155826674'), '[^0-9]', '', 'g')"
_FIRST = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'EMPTY' ELSE lpad(CAST(o_custkey % 100000 AS {s}), 5, '1') END"
_SECOND = "CASE o_orderkey % 5 WHEN 0 THEN lpad(CAST(o_custkey % 100000 AS {s}), 5, '1') WHEN 1 THEN '' WHEN 2 THEN 'l' || lpad(CAST(o_custkey % 10000 AS {s}), 4, '2') WHEN 3 THEN '12' ELSE lpad(CAST((o_custkey + 1) % 100000 AS {s}), 5, '1') END"


def _readings(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.expr(_FIRST.format(s="string")).alias("first"), F.expr(_SECOND.format(s="string")).alias("second"), F.lit("postcode").alias("kind"))


_ARBITER = f"""WITH r AS (SELECT o_orderkey, {_FIRST.format(s="VARCHAR")} AS first, {_SECOND.format(s="VARCHAR")} AS second FROM orders),
    d AS (SELECT *, first IN ('', 'EMPTY') AS fe, second = '' AS se, {_DIGITS.format(c="first")} AS fv, CASE WHEN length({_DIGITS.format(c="second")}) = 5 THEN {_DIGITS.format(c="second")} ELSE {_MENDED.format(c="second")} END AS sv FROM r),
    v AS (SELECT *, se OR length(sv) = 5 AS ok FROM d)"""


@query(f"""{_ARBITER} SELECT o_orderkey, CASE WHEN take THEN second ELSE first END AS value, CASE WHEN take THEN 'ocr-sweep' ELSE 'page' END AS source, take AND first <> '' AND NOT fe AS disputed FROM (
    SELECT *, ok AND NOT (se AND NOT fe) AND CASE WHEN se THEN '' ELSE sv END <> CASE WHEN fe THEN '' ELSE fv END AS take FROM v)""")
def q_sweep_arbitrate(t: Tables) -> DataFrame:
    return records.sweep(_readings(t), "first", "second", "kind").select("o_orderkey", "value", "source", "disputed")


@query(f"""{_ARBITER} SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'nothing was returned' WHEN NOT ok THEN 'a postal code has 5 digits (got ' || length({_DIGITS.format(c="second")}) || ')' WHEN ink >= 4000 AND se THEN 'clear ink in this box but nothing was read' WHEN ink <= 500 AND NOT se THEN 'no ink in this box, yet a value was read' END AS reason
    FROM (SELECT *, o_orderkey % 50 * 100 AS ink FROM v) WHERE o_orderkey % 11 = 0 OR NOT ok OR (ink >= 4000 AND se) OR (ink <= 500 AND NOT se)""")
def q_retry_reason(t: Tables) -> DataFrame:
    df = _readings(t).withColumns({"found": records.assess(F.col("second"), "postcode"), "verdict": records.ink_verdict(F.col("o_orderkey") % 50 * 100, F.lit(0))})
    reason = records.retry_reason(F.col("o_orderkey") % 11 != 0, F.lit("page"), F.col("found"), F.col("verdict"))
    return df.select("o_orderkey", reason.alias("reason")).where("reason is not null")


@query(f"""{_ARBITER} SELECT o_orderkey, ok OR o_orderkey % 7 = 0 AS taken, CASE WHEN ok OR o_orderkey % 7 = 0 THEN second ELSE first END AS value FROM v""")
def q_retry_accept(t: Tables) -> DataFrame:
    df = _readings(t).withColumns({"had": F.when(F.col("o_orderkey") % 7 != 0, F.col("first")), "found": records.assess(F.col("second"), "postcode")})
    df = df.withColumn("taken", records.retry_takes(F.col("second"), F.col("had"), F.col("found")))
    return df.select("o_orderkey", "taken", F.when(F.col("taken"), F.col("second")).otherwise(F.col("first")).alias("value"))


_RECORD = """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'N/A' WHEN o_orderkey % 4 = 2 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '1') ELSE '12' END AS reading,
        CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'ink-gate' END ELSE CASE o_orderkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'retry' ELSE 'with-parent' END END AS src,
        o_orderkey % 13 = 2 AS disputed, CASE WHEN o_orderkey % 5 = 2 THEN 'faint' ELSE 'strong' END AS hint, CASE WHEN c_acctbal >= 4000 THEN 'filled' WHEN c_acctbal < 0 THEN '' WHEN c_acctbal <= 500 THEN 'blank' ELSE '' END AS verdict, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT *, reading IS NULL OR reading = 'N/A' AS empty, coalesce(reading = 'N/A', false) AS explicit, reading IS NULL OR reading = 'N/A' OR length(reading) = 5 AS valid,
        CASE src WHEN 'page' THEN 'vlm-page' WHEN 'retry' THEN 'vlm-recheck' WHEN 'with-parent' THEN 'read-with-parent' WHEN 'ink-gate' THEN 'ink-gate' ELSE 'not-read' END AS source FROM r),
    c AS (SELECT *, CASE WHEN source = 'not-read' THEN 'low' WHEN NOT valid THEN 'low' WHEN disputed THEN 'low' WHEN source IN ('ink-gate', 'read-with-parent') THEN 'high' WHEN hint = 'faint' AND NOT empty THEN 'low' WHEN verdict = 'filled' AND empty AND NOT explicit THEN 'low' ELSE 'high' END AS confidence FROM a)"""


def _assembled(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = joined.select(F.lit("d").alias("doc"), key.alias("field"), F.col("n_regionkey").alias("page"), F.lit("s").alias("section"), F.lit("Post/Zip Code").alias("label"), F.lit("text").alias("kind"), F.lit("postcode").alias("type"), key.alias("ordinal"), "c_acctbal", "o_custkey")
    fields = base.drop("c_acctbal", "o_custkey")
    index = base.select("doc", "field", F.when(F.col("field") % 5 == 2, "faint").otherwise("strong").alias("ink_hint"), F.floor("c_acctbal").alias("ink_px"), F.lit(0).alias("baseline_px"))
    kind = F.col("field") % 4
    value = F.when(kind == 1, "N/A").when(kind == 2, F.lpad(F.col("o_custkey").cast("string"), 5, "1")).when(kind == 3, "12")
    source = F.when(kind == 0, "ink-gate").when(F.col("field") % 3 == 0, "page").when(F.col("field") % 3 == 1, "retry").otherwise("with-parent")
    reads = base.where("field % 4 <> 0 or field % 8 = 0").select("doc", "field", value.alias("value"), source.alias("source"), F.lit("m").alias("model"), (F.col("field") % 13 == 2).alias("disputed"))
    pages = t.region.select(F.lit("d").alias("doc"), F.col("r_regionkey").alias("page"), F.when(F.col("r_regionkey") == 3, F.array(F.lit("low coverage"))).otherwise(F.array().cast("array<string>")).alias("problems")).where("page <> 4")
    return records.assemble(fields, index, reads, pages)


@query(f"{_RECORD} SELECT o_orderkey, source, confidence FROM c")
def q_confidence_ladder(t: Tables) -> DataFrame:
    return _assembled(t).select(F.col("field").alias("o_orderkey"), "source", "confidence")


@query(f"{_RECORD} SELECT o_orderkey, n_regionkey AS page, CASE WHEN empty THEN NULL ELSE reading END AS value, source, confidence, valid, confidence = 'low' OR NOT valid OR n_regionkey = 3 AS needs_review FROM c")
def q_assemble(t: Tables) -> DataFrame:
    return _assembled(t).select(F.col("field").alias("o_orderkey"), "page", "value", "source", "confidence", "valid", "needs_review")


@query("""WITH d AS (SELECT o_orderkey, min(o_orderdate) AS issue, max(l_shipdate) AS expiry, min(l_shipdate) AS birth, any_value(c_name) AS title FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey)
    SELECT o_orderkey, unnest(list_filter([CASE WHEN CAST(expiry AS DATE) <= CAST(issue AS DATE) THEN 'Date of Expiry is not after Date of Issue' END, CASE WHEN o_orderkey % 4 > 0 AND CAST(birth AS DATE) >= CAST(issue AS DATE) THEN 'Date of Birth is not before Date of Issue' END,
        CASE WHEN o_orderkey % 4 > 0 AND year(birth) > 2015 THEN 'Date of Birth year ' || year(birth) || ' looks implausible' END,
        CASE WHEN o_orderkey % 3 < 2 AND (o_orderkey % 3 = 0) <> (o_orderkey % 2 = 1) THEN 'CNIC ends in ' || o_orderkey % 10 || ', which means ' || CASE WHEN o_orderkey % 2 = 1 THEN 'male' ELSE 'female' END || ', but Gender is ticked ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Male' ELSE 'Female' END END,
        CASE WHEN o_orderkey % 5 <> 0 THEN 'Title of Account ' || chr(39) || title || chr(39) || ' matches neither First nor Last name' END], lambda x: x IS NOT NULL)) AS issue FROM d""")
def q_cross_check(t: Tables) -> DataFrame:
    """Orders as forms: dates, an identity number, names and two tick boxes; one birth date in four isn't on page one."""
    day = lambda c: F.date_format(c, "ddMMyyyy")
    wide = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    wide = wide.groupBy("o_orderkey").agg(day(F.min("o_orderdate")).alias("issue"), day(F.max("l_shipdate")).alias("expiry"), day(F.min("l_shipdate")).alias("birth"), F.min("c_name").alias("title"))
    key = F.col("o_orderkey")

    def row(n: int, field, value, kind: str = "text", label: str = "", group: str = ""):  # noqa: ANN001, ANN202
        field = F.lit(field) if isinstance(field, str) else field
        return F.struct(F.lit(n).alias("ordinal"), field.alias("field"), value.alias("value"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(group).alias("group"))

    rows = F.array(
        row(1, "p1_date_of_issue", F.col("issue")), row(2, "p1_date_of_expiry", F.col("expiry")), row(3, F.concat(F.when(key % 4 > 0, "p1").otherwise("p2"), F.lit("_date_of_birth")), F.col("birth")), row(4, "p1_id_no", F.lpad(key.cast("string"), 13, "3")),
        row(5, "p1_title_of_account", F.col("title")), row(6, "p1_first_name", F.when(key % 5 == 0, "Cust 77").otherwise("Zed 1")), row(7, "p1_last_name", F.lit("Qu 9")),
        row(8, "p1_gender_male", (key % 3 == 0).cast("string"), "checkbox", "Male", "Gender"), row(9, "p1_gender_female", (key % 3 == 1).cast("string"), "checkbox", "Female", "Gender"),
    )
    return records.cross_check(wide.select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*"), "o_orderkey")


@query("""SELECT user_id AS doc, 'f' || event_id AS field, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS value, 'checkbox-cv' AS source, CASE WHEN event_id % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, event_type AS "group", CASE WHEN event_id % 2 = 0 THEN 'many' ELSE 'one' END AS select_mode,
    event_id % 5 = 0 OR event_id % 3 = 2 AS needs_review FROM events WHERE value > 5""")
def q_assemble_ticks(t: Tables) -> DataFrame:
    key = [F.col("user_id").alias("doc"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("field")]
    page = (F.col("event_id") % 3).alias("page")
    fields = t.events.select(*key, page, F.lit("s").alias("section"), F.col("event_type").alias("label"), F.lit("checkbox").alias("kind"), F.lit("").alias("type"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("group"), F.when(F.col("event_id") % 2 == 0, "many").otherwise("").alias("select_mode"))
    ticks = t.events.where("value > 5").select(*key, (F.col("value") > 50).alias("checked"), F.col("value").alias("score"), F.when(F.col("event_id") % 5 == 0, "low").otherwise("high").alias("confidence"))
    index = t.spark.createDataFrame([], "doc bigint, field string, ink_hint string, ink_px bigint, baseline_px bigint")
    reads = t.spark.createDataFrame([], "doc bigint, field string, value string, source string, model string, disputed boolean")
    pages = t.events.where("event_id % 3 = 2").select(F.col("user_id").alias("doc"), page, F.array(F.lit("few matches")).alias("problems")).distinct()
    return records.assemble(fields, index, reads, pages, ticks).select("doc", "field", "value", "source", "confidence", "group", "select_mode", "needs_review")


@query("""WITH x AS (SELECT conv_id, turn, text FROM conversations WHERE turn <= 1),
    w AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b FROM x GROUP BY conv_id),
    f AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND conv_id % 2 = 0 AND conv_id % 3 = 0 AS fold FROM w)
    SELECT conv_id AS doc, 'a' AS field, CASE WHEN fold THEN array_to_string(list_filter([trim(rtrim(trim(a), ',')), trim(rtrim(trim(b), ','))], lambda s: s <> ''), ', ') ELSE a END AS want FROM f WHERE a IS NOT NULL
    UNION ALL SELECT conv_id, 'b', b FROM f WHERE b IS NOT NULL AND NOT fold""")
def q_folded_truth(t: Tables) -> DataFrame:
    """First turns as wrapped lines; the second was not read in every third conversation, the first in every other."""
    names = F.when(F.col("turn") == 0, "a").otherwise("b")
    lines = t.conversations.where("turn <= 1").groupBy(F.col("conv_id").alias("doc"), names.alias("field")).agg(F.max("text").alias("want")).where("want is not null")
    got = lines.select("doc", "field", F.when(F.col("field") == "a", F.when(F.col("doc") % 2 == 0, "x").otherwise("")).otherwise(F.when(F.col("doc") % 3 == 0, "").otherwise("y")).alias("value"))
    fields = lines.select("doc", "field", F.when(F.col("field") == "b", "a").otherwise("").alias("continuation_of"), F.when(F.col("field") == "b", 2).otherwise(1).alias("ordinal"))
    return records.folded_truth(lines, got, fields)


@query("""SELECT user_id, event_type, string_agg(name || '=' || CAST(CAST(value * 100 AS BIGINT) AS VARCHAR), ';' ORDER BY event_id) AS answers FROM (SELECT *, CASE WHEN n = 1 THEN 'a' ELSE 'a (' || n || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)) GROUP BY user_id, event_type""")
def q_answers_view(t: Tables) -> DataFrame:
    from formspark.operators.layout import numbered_labels

    named = numbered_labels(t.events.withColumn("label", F.lit("a")), ["user_id", "event_type"], "label", ["event_id"])
    view = records.answers_view(named.withColumn("v", F.round(F.col("value") * 100).cast("long")), "user_id", "event_type", "name", "v", "event_id")
    return view.select("user_id", "event_type", F.array_join(F.transform(F.map_entries("answers"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("answers"))


@query("""SELECT user_id, coalesce(string_agg(event_type, ', ' ORDER BY event_id) FILTER (value > 80), '') AS answer, count(*) FILTER (value > 80) AS picked, coalesce(bool_or(value > 80 AND value > 95), false) OR (count(*) FILTER (value > 80) > 1 AND user_id % 2 = 0) AS needs_review FROM events GROUP BY user_id""")
def q_question_rows(t: Tables) -> DataFrame:
    df = t.events.withColumns({"picked": F.col("value") > 80, "needs_review": F.col("value") > 95})
    return records.question_rows(df, ["user_id"], "event_id", "event_type", "picked", F.col("user_id") % 2 != 0)


@query("""SELECT conv_id, string_agg(part, ', ' ORDER BY turn) AS value, count(*) AS parts FROM (SELECT conv_id, turn, trim(rtrim(trim(text), ',')) AS part FROM conversations) GROUP BY conv_id""")
def q_continuation_fold(t: Tables) -> DataFrame:
    return records.folded(t.conversations, ["conv_id"], "turn", "text")


_LOG = """SELECT c_custkey, CAST(k AS BIGINT) AS "at", CASE WHEN (c_custkey + k) % 4 = 0 THEN 'N/A' WHEN k = 2 THEN '12' ELSE lpad(CAST(c_custkey * k AS {s}), 5, '1') END AS value, 'was ' || k AS original, c_custkey % 10 = 3 AND k = 2 AS reverted"""


def _log(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 3 <> 1").crossJoin(F.broadcast(t.spark.range(1, 4).withColumnRenamed("id", "k"))).selectExpr(*[x.strip() for x in ("c_custkey", "k as at", "case when (c_custkey + k) % 4 = 0 then 'N/A' when k = 2 then '12' else lpad(cast(c_custkey * k as string), 5, '1') end as value", "concat('was ', k) as original", "c_custkey % 10 = 3 and k = 2 as reverted")])


_EDITS = f"""WITH l AS ({_LOG.format(s="VARCHAR")} FROM customer CROSS JOIN (SELECT unnest(range(1, 4)) AS k) WHERE c_custkey % 3 <> 1),
    s AS (SELECT *, max(CASE WHEN reverted THEN "at" END) OVER (PARTITION BY c_custkey) AS since FROM l),
    e AS (SELECT c_custkey, arg_max(value, "at") AS edit, arg_min(original, "at") AS original, count(*) AS edits FROM s WHERE since IS NULL OR "at" > since GROUP BY c_custkey)"""


@query(f"{_EDITS} SELECT * FROM e")
def q_edit_latest(t: Tables) -> DataFrame:
    return records.current_edits(_log(t), ["c_custkey"])


@query(f"""{_EDITS} SELECT c.c_custkey, CASE WHEN edit IS NULL THEN c_name WHEN edit = 'N/A' THEN NULL ELSE edit END AS value, CASE WHEN edit IS NULL THEN c_acctbal > 0 ELSE edit = 'N/A' OR length(edit) = 5 END AS valid,
    CASE WHEN edit IS NULL THEN 'vlm-page' ELSE 'reviewer' END AS source, CASE WHEN edit IS NULL THEN false ELSE NOT (edit = 'N/A' OR length(edit) = 5) END AS needs_review, edit IS NOT NULL AS edited, original AS edited_from FROM customer c LEFT JOIN e ON e.c_custkey = c.c_custkey""")
def q_edits_overlay(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", F.col("c_name").alias("value"), F.lit("postcode").alias("type"), F.lit("text").alias("kind"), (F.col("c_acctbal") > 0).alias("valid"), F.lit("").alias("note"), F.lit("vlm-page").alias("source"), F.lit("high").alias("confidence"), F.lit(False).alias("needs_review"))
    out = records.overlay(base, records.current_edits(_log(t), ["c_custkey"]), ["c_custkey"])
    return out.select("c_custkey", "value", "valid", "source", "needs_review", "edited", "edited_from")


_SCORED = """FROM (SELECT l.quality, CASE WHEN l.doc_id % 6 = 0 THEN 'N/A' WHEN l.doc_id % 6 = 1 THEN '' ELSE 'src' || l.doc_id % 20 END AS want, trim(CASE WHEN l.doc_id % 5 = 0 THEN '' WHEN l.doc_id % 5 = 1 THEN upper(source) || '.' ELSE source END) AS have, l.doc_id % 4 = 0 AS low FROM labels l LEFT JOIN documents d USING (doc_id))"""


@query(f"""SELECT quality, count(*) FILTER (e) AS exact, count(*) FILTER (n) AS normal, count(*) FILTER (b = (have = '')) AS empty_right, count(*) FILTER (NOT n AND low) AS caught, count(*) AS total FROM (
    SELECT *, have = want OR (b AND have = '') AS e, regexp_replace(lower(want), '[^a-z0-9]', '', 'g') = regexp_replace(lower(have), '[^a-z0-9]', '', 'g') OR (lower(want) = 'n/a' AND have = '') AS n FROM (SELECT *, lower(want) IN ('', 'n/a') AS b {_SCORED})) GROUP BY quality""")
def q_evaluate_rates(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 6
    truth = t.labels.select("doc_id", "quality", F.when(kind == 0, "N/A").when(kind == 1, "").otherwise(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))).alias("want"))
    read = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.concat(F.upper("source"), F.lit("."))).otherwise(F.col("source"))
    got = t.documents.select("doc_id", read.alias("value"), F.when(F.col("doc_id") % 4 == 0, "low").otherwise("high").alias("confidence"))
    return records.rates(records.score_values(truth, got, ["doc_id"]), ["quality"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_truth_missing(t: Tables) -> DataFrame:
    return records.without(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("SELECT l.doc_id, quality, toxic FROM labels l WHERE toxic = 1 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def q_spurious(t: Tables) -> DataFrame:
    return records.without(t.labels.where("toxic = 1"), t.documents.where("lang = 'en'"), ["doc_id"])


@query("SELECT coalesce(o_orderstatus, 'TOTAL') AS o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS other FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def q_kind_pivot(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("other")
    return records.kind_counts(t.orders.withColumn("kind", kind), ["o_orderstatus"], "kind", ["urgent", "high", "other"], "TOTAL")


@query("""SELECT o_orderstatus, count(*) AS total, count(*) FILTER (o_totalprice > 100000) AS filled, count(*) FILTER (o_totalprice > 100000 AND o_custkey % 7 = 0) AS flagged FROM orders GROUP BY o_orderstatus""")
def q_section_stats(t: Tables) -> DataFrame:
    filled = F.col("o_totalprice") > 100000
    return records.section_summary(t.orders, ["o_orderstatus"], filled, filled & (F.col("o_custkey") % 7 == 0))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_custkey % 7 = 0 ORDER BY o_orderpriority, o_orderkey LIMIT 40")
def q_review_topk(t: Tables) -> DataFrame:
    return records.review_list(t.orders, (F.col("o_totalprice") > 100000) & (F.col("o_custkey") % 7 == 0), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""SELECT o_custkey AS page, o_orderstatus AS section, CAST(NULL AS VARCHAR) AS "group", o_orderpriority AS label, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS confidence,
    o_orderstatus = 'F' AS valid, CAST(NULL AS VARCHAR) AS needs_review, CAST(NULL AS VARCHAR) AS note, o_orderkey AS field FROM orders""")
def q_csv_projection(t: Tables) -> DataFrame:
    return records.answers_csv(t.orders.select(F.col("o_orderkey").alias("field"), F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") == "F").alias("valid")))


@query("SELECT p_brand, p_type, count(*) AS uses FROM part GROUP BY p_brand, p_type HAVING count(*) > 1")
def q_glossary_shared(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


@query("""SELECT p_brand, string_agg(line, chr(10) ORDER BY n) AS prompt FROM (SELECT p_brand, n, n || '. ' || p_name || ' - ' || CASE WHEN uses > 1 THEN '(as above) ' ELSE '' END || p_type || CASE WHEN p_size <= 5 THEN ' [blank]' WHEN p_size >= 40 THEN ' [filled]' ELSE '' END AS line FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_brand, p_type) AS uses FROM part)) GROUP BY p_brand""")
def q_prompt_text(t: Tables) -> DataFrame:
    from formspark.operators.readers import page_prompts

    items = t.part.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("label"), F.col("p_type").alias("spec"), (F.col("p_size") * 100).alias("ink_px"), F.lit(0).alias("baseline_px"))
    return page_prompts(items, ["page"]).select(F.col("page").alias("p_brand"), "prompt")
