"""Queries of typing, validation, repair and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.functions import rules, text, validate
from formspark.plans.registry import Tables, query

LABELS = [
    "IBAN", "Direct Debit A/c No.", "ID No.", "CNIC of Applicant", "First Name (As per CNIC/ID)", "Date of Issuance (CNIC)", "Passport No.", "NTN", "Email Address",
    "Mobile Number", "Telephone Number", "Date of Birth", "Customer Since", "Expected Monthly Income (PKR)", "Other Source of Income (Please specify)", "No. of Transactions",
    "Total previous Work Experience", "Post/Zip Code", "Branch Code", "P.A. No.", "Account No.", "House/Appt. No./Appt. Name", "Father's Name", "Nationality", "Remarks", "",
]
_labels_sql = ", ".join("('" + x.replace("'", "''") + "')" for x in LABELS)


def sql_type(label: str) -> str:
    bare = rf"lower(regexp_replace({label}, '\s*\([^)]*\)', ' ', 'g'))"
    arms = "\n".join(f"WHEN regexp_matches({bare}, '{p}') THEN '{t}'" for p, t in rules.TYPE_RULES)
    return f"CASE WHEN regexp_matches({bare}, '{rules.DESCRIPTIVE}') OR regexp_matches(lower({label}), '{rules.DESCRIPTIVE}') THEN 'text' {arms} ELSE 'text' END"


def verdicts(df: DataFrame, keys: list[str], value: str, kind: str, note: bool = False) -> DataFrame:
    found = df.withColumn("found", validate.CHECKS.get(kind, validate.check_text)(F.col(value)))
    return found.select(*keys, F.col(value).alias("raw"), F.col("found.valid").alias("valid"), F.col("found.value").alias("value"), *([F.col("found.note").alias("note")] if note else []))


@query(f"""SELECT label, {sql_type("label")} AS type FROM (
    SELECT * FROM (VALUES {_labels_sql}) v(label) UNION ALL SELECT DISTINCT p_name FROM part UNION ALL SELECT DISTINCT p_type FROM part UNION ALL SELECT DISTINCT event_type FROM events)""")
def q_infer_type(t: Tables) -> DataFrame:
    every = t.values([(x,) for x in LABELS], "label string")
    for table, column in (("part", "p_name"), ("part", "p_type"), ("events", "event_type")):
        every = every.unionByName(getattr(t, table).select(F.col(column).alias("label")).distinct())
    return every.select("label", validate.infer_type(F.col("label")).alias("type"))


@query("""SELECT o_orderkey, raw, d IS NOT NULL AND year(d) BETWEEN 1900 AND 2100 AS valid,
    CASE WHEN d IS NOT NULL AND year(d) BETWEEN 1900 AND 2100 THEN digits ELSE raw END AS value FROM (
    SELECT *, CASE WHEN length(digits) = 8 THEN try_strptime(digits, '%d%m%Y') END AS d FROM (
    SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM (
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d%m%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN '3002' || strftime(o_orderdate, '%Y')
    WHEN 3 THEN strftime(o_orderdate, '%d%m') || 'O' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS raw FROM orders)))""")
def q_validate_date(t: Tables) -> DataFrame:
    day = lambda f: F.date_format("o_orderdate", f)
    kind = F.col("o_orderkey") % 5
    raw = F.when(kind == 0, day("ddMMyyyy")).when(kind == 1, day("dd/MM/yyyy")).when(kind == 2, F.concat(F.lit("3002"), day("yyyy"))).when(kind == 3, F.concat(day("ddMM"), F.lit("O"))).otherwise(day("dd-MM-yyyy"))
    return verdicts(t.orders.select("o_orderkey", raw.alias("raw")), ["o_orderkey"], "raw", "date")


_ID = "lpad(CAST(c_custkey * 7919 % 10000000000000 AS VARCHAR), 13, CAST(c_custkey % 10 AS VARCHAR))"


@query(f"""SELECT c_custkey, raw, fits AND bare[1] BETWEEN '1' AND '8' AS valid,
    CASE WHEN fits THEN substr(bare, 1, 5) || '-' || substr(bare, 6, 7) || '-' || substr(bare, 13, 1) ELSE raw END AS value,
    CASE WHEN fits AND bare[1] BETWEEN '1' AND '8' THEN '' WHEN fits THEN 'CNIC starts with ' || bare[1] || ', not an issuing region' ELSE 'expected 13 digits as XXXXX-XXXXXXX-X' END AS note
    FROM (SELECT *, regexp_matches(replace(raw, ' ', ''), '^[0-9]{{5}}-?[0-9]{{7}}-?[0-9]$') AS fits, replace(replace(raw, ' ', ''), '-', '') AS bare FROM (
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN id WHEN 1 THEN substr(id, 1, 5) || '-' || substr(id, 6, 7) || '-' || substr(id, 13) WHEN 2 THEN substr(id, 1, 12) || ' ' || substr(id, 13) ELSE substr(id, 2) END AS raw
    FROM (SELECT c_custkey, {_ID} AS id FROM customer)))""")
def q_validate_id(t: Tables) -> DataFrame:
    part = lambda a, n: F.substring("id", a, n)
    digits = F.expr("lpad(cast(c_custkey * 7919 % 10000000000000 as string), 13, cast(c_custkey % 10 as string))")
    kind = F.col("c_custkey") % 4
    raw = F.when(kind == 0, F.col("id")).when(kind == 1, F.concat_ws("-", part(1, 5), part(6, 7), part(13, 1))).when(kind == 2, F.concat_ws(" ", part(1, 12), part(13, 1))).otherwise(part(2, 12))
    return verdicts(t.customer.withColumn("id", digits).select("c_custkey", raw.alias("raw")), ["c_custkey"], "raw", "cnic", note=True)


@query("""SELECT s_suppkey, raw, fits AND substr(bare, 5, 4) = 'HABB' AS valid, CASE WHEN fits THEN bare ELSE raw END AS value FROM (
    SELECT *, regexp_matches(bare, '^PK[0-9]{2}[A-Z]{4}[A-Z0-9]{16}$') AS fits FROM (SELECT *, upper(regexp_replace(raw, '[\\s-]', '', 'g')) AS bare FROM (
    SELECT s_suppkey, 'PK' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || CASE s_suppkey % 3 WHEN 0 THEN 'HABB' WHEN 1 THEN ' habb' ELSE 'ABCD' END || lpad(CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 5 = 0 THEN 14 ELSE 16 END, '0') AS raw FROM supplier)))""")
def q_validate_iban(t: Tables) -> DataFrame:
    bank = F.when(F.col("s_suppkey") % 3 == 0, "HABB").when(F.col("s_suppkey") % 3 == 1, " habb").otherwise("ABCD")
    raw = F.concat(F.lit("PK"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), bank, F.when(F.col("s_suppkey") % 5 == 0, F.lpad(F.col("s_suppkey").cast("string"), 14, "0")).otherwise(F.lpad(F.col("s_suppkey").cast("string"), 16, "0")))
    return verdicts(t.supplier.select("s_suppkey", raw.alias("raw")), ["s_suppkey"], "raw", "iban")


def _simple(name: str, kind: str, sql_raw: str, spark_raw: str, sql_bare: str, sql_ok: str) -> None:
    """A query of one check over part numbers in several writings."""

    def run(t: Tables) -> DataFrame:
        return verdicts(t.part.select("p_partkey", F.expr(spark_raw).alias("raw")), ["p_partkey"], "raw", kind)

    run.__name__ = name
    query(f"""SELECT p_partkey, raw, {sql_ok} AS valid, CASE WHEN {sql_ok} THEN bare ELSE raw END AS value FROM (
        SELECT *, {sql_bare} AS bare FROM (SELECT p_partkey, {sql_raw} AS raw FROM part))""")(run)


_digits = "regexp_replace(raw, '[^0-9]', '', 'g')"
_simple("validate_ntn", "ntn", "lpad(CAST(p_partkey AS VARCHAR), CAST(6 + p_partkey % 3 AS INT), '0') || CASE WHEN p_partkey % 4 = 0 THEN '-8' ELSE '' END", "lpad(cast(p_partkey as string), cast(6 + p_partkey % 3 as int), '0') || case when p_partkey % 4 = 0 then '-8' else '' end", _digits, "length(bare) IN (7, 8, 13)")
_simple("validate_postcode", "postcode", "lpad(CAST(p_partkey AS VARCHAR), CAST(4 + p_partkey % 3 AS INT), '7')", "lpad(cast(p_partkey as string), cast(4 + p_partkey % 3 as int), '7')", _digits, "length(bare) = 5")
_simple("validate_passport", "passport", "CASE WHEN p_partkey % 2 = 0 THEN 'ab' ELSE 'A?' END || lpad(CAST(p_partkey AS VARCHAR), CAST(5 + p_partkey % 4 AS INT), '0')", "case when p_partkey % 2 = 0 then 'ab' else 'A?' end || lpad(cast(p_partkey as string), cast(5 + p_partkey % 4 as int), '0')", "upper(regexp_replace(raw, '[\\s-]', '', 'g'))", "regexp_matches(bare, '^[A-Z0-9]{7,9}$')")
_simple("validate_digits", "digits", "CAST(p_partkey AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN ' 12' WHEN 1 THEN '-3' ELSE 'x' END", "cast(p_partkey as string) || case p_partkey % 3 when 0 then ' 12' when 1 then '-3' else 'x' end", "regexp_replace(raw, '[\\s-]', '', 'g')", "regexp_matches(bare, '^[0-9]+$')")

_MAIL = "[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9.-]+"


@query(f"""SELECT doc_id, n, raw, regexp_matches(bare, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$') AS valid, CASE WHEN regexp_matches(bare, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$') THEN bare ELSE raw END AS value FROM (
    SELECT *, regexp_replace(raw, '\\s', '', 'g') AS bare FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS n, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '{_MAIL}') AS m FROM documents)))""")
def q_validate_email(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_MAIL})"), 1)).alias("n", "raw"))
    return verdicts(found.withColumn("n", (F.col("n") + 1).cast("long")), ["doc_id", "n"], "raw", "email")


_areas_sql = ", ".join(f"('{k}', {8 if k in rules.LONG_AREAS else 7})" for k in rules.AREAS)
_PHONE_RAW = """CASE c_custkey % 7 WHEN 0 THEN '0300-' || lpad(CAST(c_custkey AS {s}), 7, '0') WHEN 1 THEN '+92 21 ' || lpad(CAST(c_custkey AS {s}), 8, '3') WHEN 2 THEN '0992' || lpad(CAST(c_custkey AS {s}), 7, '1')
    WHEN 3 THEN '091 ' || lpad(CAST(c_custkey AS {s}), 8, '2') WHEN 4 THEN '0370' || lpad(CAST(c_custkey AS {s}), 7, '0') WHEN 5 THEN '099' || lpad(CAST(c_custkey AS {s}), 7, '4') ELSE lpad(CAST(c_custkey AS {s}), 9, '5') END"""
_PHONE = f"""WITH a(code, want) AS (VALUES {_areas_sql}),
    r AS (SELECT c_custkey, raw, regexp_replace(regexp_replace(raw, '[^0-9+]', '', 'g'), '^\\+?92', '0') AS n FROM (SELECT c_custkey, {_PHONE_RAW.format(s="VARCHAR")} AS raw FROM customer)),
    j AS (SELECT r.*, coalesce(f.code, h.code) AS code, coalesce(f.want, h.want) AS want FROM r LEFT JOIN a f ON f.code = substr(n, 1, 4) LEFT JOIN a h ON h.code = substr(n, 1, 3)),
    v AS (SELECT *, CASE WHEN n LIKE '03%' THEN regexp_matches(n, '^03[0-5][0-9]{{8}}$') WHEN n NOT LIKE '0%' THEN false WHEN code IS NOT NULL THEN length(n) - length(code) = want ELSE length(n) BETWEEN 10 AND 11 END AS ok,
        CASE WHEN n LIKE '03%' THEN 4 WHEN code IS NOT NULL THEN length(code) ELSE 3 END AS cut FROM j)
    SELECT c_custkey, raw, {{ok}} AS valid, CASE WHEN {{ok}} THEN substr(n, 1, cut) || '-' || substr(n, cut + 1) ELSE raw END AS value FROM v"""


def _phones(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.expr(_PHONE_RAW.format(s="string")).alias("raw"))


@query(_PHONE.replace("{ok}", "ok"))
def q_validate_phone(t: Tables) -> DataFrame:
    return verdicts(_phones(t), ["c_custkey"], "raw", "phone")


@query(_PHONE.replace("{ok}", "(ok AND n LIKE '03%')"))
def q_validate_mobile(t: Tables) -> DataFrame:
    return verdicts(_phones(t), ["c_custkey"], "raw", "mobile")


_AMOUNT = "CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {s}) || '/-' WHEN 1 THEN 'PKR ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {s}) WHEN 2 THEN 'Rs.1,' || CAST(CAST(l_quantity AS INT) AS {s}) ELSE 'about ' || CAST(CAST(l_quantity AS INT) AS {s}) END"


@query(f"""SELECT l_orderkey, l_linenumber, raw, ok AS valid, CASE WHEN ok THEN bare ELSE raw END AS value, CAST(TRY_CAST(CASE WHEN ok THEN bare END AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM (
    SELECT *, regexp_matches(bare, '^[0-9]+(\\.[0-9]{{1,2}})?$') AS ok FROM (SELECT *, rtrim(regexp_replace(raw, '[,\\s/]|pkr|rs\\.?', '', 'gi'), '-') AS bare FROM (
    SELECT l_orderkey, l_linenumber, {_AMOUNT.format(s="VARCHAR")} AS raw FROM lineitem)))""")
def q_validate_amount(t: Tables) -> DataFrame:
    found = verdicts(t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_AMOUNT.format(s="string")).alias("raw")), ["l_orderkey", "l_linenumber"], "raw", "amount")
    return found.withColumn("amount", F.expr("cast(try_cast(case when valid then value end as decimal(18,2)) as double)"))


@query("""SELECT name AS raw, count(*) AS n, regexp_matches(name, '^[A-Za-z][A-Za-z .''’/-]{0,60}$') AS valid, CASE WHEN regexp_matches(name, '^[A-Za-z][A-Za-z .''’/-]{0,60}$') THEN regexp_replace(name, '\\s+', ' ', 'g') ELSE name END AS value
    FROM (SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT replace(p_name, ' ', '  ') FROM part) GROUP BY name""")
def q_validate_name(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_name").alias("raw")).unionAll(t.part.select("p_name")).unionAll(t.part.select(F.replace("p_name", F.lit(" "), F.lit("  "))))
    return verdicts(names.groupBy("raw").agg(F.count(F.lit(1)).alias("n")), ["n"], "raw", "name")


@query("""SELECT conv_id, turn, true AS valid, regexp_replace(text, '\\s+', ' ', 'g') AS value FROM conversations""")
def q_validate_text(t: Tables) -> DataFrame:
    return verdicts(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", "text").drop("raw")


_LETTERED = "translate(CAST(c_custkey * 104729 AS {s}), CASE c_custkey % 3 WHEN 0 THEN '05' WHEN 1 THEN '18' ELSE '9' END, CASE c_custkey % 3 WHEN 0 THEN 'OS' WHEN 1 THEN 'lB' ELSE 'g' END)"


@query(f"""SELECT c_custkey, raw, translate(raw, '{rules.LETTERS}', '{rules.DIGITS}') AS fixed, regexp_matches(raw, '^[0-9]+$') AS valid,
    NOT regexp_matches(raw, '^[0-9]+$') AND regexp_matches(translate(raw, '{rules.LETTERS}', '{rules.DIGITS}'), '^[0-9]+$') AS repaired FROM (SELECT c_custkey, {_LETTERED.format(s="VARCHAR")} AS raw FROM customer)""")
def q_repair_digits(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", F.expr(_LETTERED.format(s="string")).alias("raw"))
    found = df.withColumns({"fixed": validate.repaired(F.col("raw")), "a": validate.assess(F.col("raw"), "digits")})
    return found.select("c_custkey", "raw", "fixed", validate.check_digits(F.col("raw"))["valid"].alias("valid"), F.startswith(F.col("a.note"), F.lit("repaired")).alias("repaired"))


_READ = "CASE c_custkey % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN 'EMPTY' WHEN 3 THEN '_' || CAST(10000 + c_custkey AS {s}) WHEN 4 THEN 'l' || CAST(1000 + c_custkey % 9000 AS {s}) WHEN 5 THEN CAST(c_custkey AS {s}) WHEN 6 THEN 'No.' ELSE CAST(20000 + c_custkey AS {s}) END"


@query(f"""WITH r AS (SELECT c_custkey, trim({_READ.format(s="VARCHAR")}) AS raw FROM customer),
    s AS (SELECT *, lower(trim(raw, ' _*:.–-')) AS token, ltrim(raw, ' _*|=–—-') AS body FROM r),
    e AS (SELECT *, token IN ('none', 'n/a', 'na', '-', '--', 'nil', 'null', 'no') AS explicit_none, token IN ('', 'empty', 'none', 'n/a', 'na', '-', '--', 'nil', 'null', 'no') AS empty,
        regexp_replace(body, '[^0-9]', '', 'g') AS d1, regexp_replace(translate(body, '{rules.LETTERS}', '{rules.DIGITS}'), '[^0-9]', '', 'g') AS d2 FROM s)
    SELECT c_custkey, raw, CASE WHEN empty THEN NULL WHEN length(d1) = 5 THEN d1 WHEN length(d2) = 5 THEN d2 ELSE body END AS value, empty OR length(d1) = 5 OR length(d2) = 5 AS valid, empty, explicit_none FROM e""")
def q_assess(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", F.expr(_READ.format(s="string")).alias("reading"))
    found = df.withColumn("a", validate.assess(F.col("reading"), "postcode"))
    return found.select("c_custkey", "a.raw", "a.value", "a.valid", "a.empty", "a.explicit_none")


_TOKENS = ["None", " n/a ", "-", "--", "nil.", "NULL", "no", "No way", "EMPTY", "", "_*_", "nothing", "*none*"]


@query(f"""SELECT raw, lower(trim(raw, ' _*:.–-')) IN ('none', 'n/a', 'na', '-', '--', 'nil', 'null', 'no') AS none_marker, lower(trim(raw, ' _*:.–-')) IN ('', 'empty') AS sentinel
    FROM (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _TOKENS)}) v(raw) UNION ALL SELECT DISTINCT p_name FROM part)""")
def q_none_markers(t: Tables) -> DataFrame:
    df = t.values([(x,) for x in _TOKENS], "raw string").unionAll(t.part.select("p_name").distinct())
    core = F.lower(F.btrim("raw", F.lit(rules.CORE_TRIM)))
    return df.select("raw", core.isin(rules.NONE_MARKERS).alias("none_marker"), core.isin(rules.SENTINELS).alias("sentinel"))


_PRINTED = ["EmploymentStatus", "CIF Opening Date  CIF", "Nature of Business (Please select and", "Veriﬁed By :", "Education (Select one)", "Father’s Name", "Property (if applicable) Status,", "Amount (PKR)", "No"]


@query(f"""WITH l AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _PRINTED)}) v(raw) UNION ALL SELECT DISTINCT p_name || 'Type ' || p_brand FROM part),
    a AS (SELECT raw, replace(translate(raw, '‘’“”–—', '''''""--'), 'ﬁ', 'fi') AS c FROM l),
    b AS (SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(c, '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'), '\\s*\\((?:Please select[^)]*|Select one|Select all that apply|if applicable)\\)\\s*', ' ', 'gi')) AS c FROM a),
    d AS (SELECT raw, CASE WHEN length(regexp_replace(c, '[^(]', '', 'g')) > length(regexp_replace(c, '[^)]', '', 'g')) THEN trim(regexp_replace(c, '\\([^(]*$', '')) ELSE c END AS c FROM b),
    w AS (SELECT raw, string_split(c, ' ') AS w FROM d)
    SELECT raw, trim(array_to_string(CASE WHEN len(w) > 1 AND list_contains(w[1:len(w) - 1], w[len(w)]) THEN w[1:len(w) - 1] ELSE w END, ' '), ' :,-') AS label FROM w""")
def q_clean_label(t: Tables) -> DataFrame:
    df = t.values([(x,) for x in _PRINTED], "raw string").unionAll(t.part.select(F.concat("p_name", F.lit("Type "), "p_brand")).distinct())
    return df.select("raw", text.clean_label(F.col("raw")).alias("label"))


@query("""SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '_')), ''), 'unlabelled') AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)""")
def q_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("slug"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS squashed FROM part")
def q_squash(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.squash(F.concat_ws(" ", "p_name", "p_brand")).alias("squashed"))


@query("""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(trim(trim(x), '`'))), lambda x: x <> '')[1], '') AS line FROM documents""")
def q_first_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.first_line(F.col("text")).alias("line"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(raw), 'all that apply') THEN 'many' WHEN contains(lower(raw), 'select one') OR contains(lower(raw), 'please select') THEN 'one' ELSE '' END AS mode FROM (
    SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (Select one)' WHEN 1 THEN ' (Select ALL that apply)' WHEN 2 THEN ' (Please select)' ELSE '' END AS raw FROM part)""")
def q_select_mode(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    ask = F.when(kind == 0, " (Select one)").when(kind == 1, " (Select ALL that apply)").when(kind == 2, " (Please select)").otherwise("")
    return t.part.select("p_partkey", text.select_mode(F.concat("p_name", ask)).alias("mode"))


@query("""WITH p AS (SELECT p_partkey, p_type AS current, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN split_part(p_type, ' ', -1) ELSE p_brand END AS q, string_split(p_name, ' ') AS o FROM part),
    s AS (SELECT p_partkey, regexp_replace(lower(q), '[^a-z0-9]', '', 'g') AS nq, regexp_replace(lower(current), '[^a-z0-9]', '', 'g') AS nc, list_transform(range(1, len(o) + 1), lambda i: regexp_replace(lower(array_to_string(o[i:], '')), '[^a-z0-9]', '', 'g')) AS tails, q, current FROM p)
    SELECT p_partkey, q AS question, q = current OR (nq <> '' AND (ends_with(nc, nq) OR list_contains(tails, nq))) AS same FROM s""")
def q_same_question(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 3
    asked = F.when(kind == 0, F.col("p_type")).when(kind == 1, F.element_at(F.split("p_type", " "), -1)).otherwise(F.col("p_brand"))
    df = t.part.select("p_partkey", asked.alias("question"), "p_type", F.split("p_name", " ").alias("o"))
    return df.select("p_partkey", "question", text.same_question(F.col("question"), F.col("p_type"), F.col("o")).alias("same"))


@query("SELECT doc_id, CAST(greatest(4096, least(32768, ((n_chars // 4 + 512) // 1024 + 1) * 1024)) AS BIGINT) AS context FROM documents")
def q_context_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.context_tokens(F.floor(F.col("n_chars") / 4) + 512).alias("context"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM (SELECT * FROM events WHERE event_id % 10 <> 0) UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 10 = 0""")
def q_json_parse(t: Tables) -> DataFrame:
    answer = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    parsed = F.try_parse_json(answer)
    return t.events.select("event_id", F.coalesce(F.try_variant_get(parsed, "$.k", "bigint"), F.lit(-1)).alias("k"))
