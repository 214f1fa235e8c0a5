import calendar

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formspark.functions import rules, text, validate

# value, label, printed letters, type, valid, result
CASES = [
    ("23062026", "CIF Opening Date", "DDMMYYYY", "date", True, "23062026"),
    ("2306202G", "CIF Opening Date", "DDMMYYYY", "date", True, "23062026"),
    ("32132026", "CIF Opening Date", "DDMMYYYY", "date", False, "32132026"),
    ("35810-0234568-5", "ID No.", "", "cnic", True, "35810-0234568-5"),
    ("358100234568 5", "ID No.", "", "cnic", True, "35810-0234568-5"),
    ("PK24HABB0033256018874102", "IBAN", "", "iban", True, "PK24HABB0033256018874102"),
    ("PK24HABB00332560188741", "IBAN", "", "iban", False, "PK24HABB00332560188741"),
    ("0316-3264890", "Telephone Number", "", "phone", True, "0316-3264890"),
    ("ashraf24@gmail.com", "Email Address", "", "email", True, "ashraf24@gmail.com"),
    ("300,000/-", "Expected Monthly Income (PKR)", "", "amount", True, "300000"),
    ("Chaudry Waqar", "Father's Name", "", "name", True, "Chaudry Waqar"),
    ("N/A", "Husband's Name", "", "name", True, None),
    ("EMPTY", "Nationality", "", "text", True, None),
    ("l2345", "Post/Zip Code", "", "postcode", True, "12345"),
    ("00000-0000000-1", "CNIC", "", "cnic", False, "00000-0000000-1"),
    ("_Karachi", "City", "", "text", True, "Karachi"),
    ("+92 21 36102837", "Landline", "", "phone", True, "021-36102837"),
    ("0221234567", "Mobile Number", "", "mobile", False, "0221234567"),
    ("0992123456", "Phone", "", "phone", False, "0992123456"),
    ("30022024", "Date of Birth", "", "date", False, "30022024"),
    ("AB123456", "Passport No.", "", "passport", True, "AB123456"),
    ("12a", "Branch Code", "", "digits", False, "12a"),
    (None, "Remarks", "", "text", True, None),
]


def assessed(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, value string, label string, hint string")
    kind = validate.infer_type(F.col("label"), F.col("hint"))
    return [r["a"] for r in df.withColumn("kind", kind).select("i", validate.assess(F.col("value"), F.col("kind")).alias("a")).orderBy("i").collect()]


def test_cases(spark):
    for case, found in zip(CASES, assessed(spark, [c[:3] for c in CASES]), strict=True):
        assert (found["type"], found["valid"], found["value"]) == case[3:], case


def test_four_kinds_of_nothing(spark):
    found = assessed(spark, [(v, "Remarks", "") for v in (None, "", " EMPTY ", "--", "N/A", "no", "None.", "Nothing")])  # marks at the ends go first, so dashes alone are nothing
    assert [(r["empty"], r["explicit_none"]) for r in found] == [(True, False)] * 4 + [(True, True)] * 3 + [(False, False)]


@given(st.lists(st.text(alphabet="0123456789OolIS-/ ", min_size=1, max_size=10), min_size=20, max_size=60))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_repair_never_changes_a_valid_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for kind in ("date", "digits", "amount"):
        rows = df.select(validate.checked(F.col("v"), kind).alias("c"), validate.assess(F.col("v"), kind).alias("a")).collect()
        for r in rows:
            if r["c"]["valid"] and not r["a"]["empty"]:
                assert r["a"]["value"] == r["c"]["value"] and not r["a"]["note"].startswith("repaired")
    again = df.select(validate.assess(F.col("v"), "date").alias("a")).where("a.valid and a.value is not null").select("a.value").select("value", validate.assess(F.col("value"), "date").alias("b"))
    assert all(r["b"]["valid"] and r["b"]["value"] == r["value"] for r in again.collect())


def test_dates_match_the_calendar(spark):
    values = [f"{d:02}{m:02}{y}" for y in (1899, 1900, 2023, 2024, 2100, 2101) for m in (0, 1, 2, 4, 12, 13) for d in (0, 1, 28, 29, 30, 31, 32)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", validate.check_date(F.col("v"))["valid"].alias("ok")).collect()
    for r in got:
        d, m, y = int(r["v"][:2]), int(r["v"][2:4]), int(r["v"][4:])
        assert r["ok"] == (1 <= m <= 12 and 1900 <= y <= 2100 and 1 <= d <= calendar.monthrange(y, m)[1])


@pytest.mark.parametrize(("raw", "label"), [("EmploymentStatus", "Employment Status"), ("CIF Opening Date CIF", "CIF Opening Date"), ("Nature of Business (Please select and", "Nature of Business"), ("Veriﬁed By :", "Verified By"), ("Education (Select one)", "Education"), ("", "")])
def test_labels(spark, raw, label):
    assert spark.createDataFrame([(raw,)], "v string").select(text.clean_label(F.col("v"))).first()[0] == label


def test_tables_of_fixed_values():
    assert len(rules.LETTERS) == len(rules.DIGITS) == 16 and len(rules.AREAS) == 37
