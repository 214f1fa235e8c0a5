"""The flagship query: identifiers in documents, typed, assessed and summed up by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.functions.validate import assess
from formspark.operators.records import needs_review
from formspark.plans.registry import Tables, query

_FINDS = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "phone": r"\+?[0-9]*[ ]?\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "account": "[0-9]{16}", "iban": "[A-Z]{2}[0-9]{2}[A-Z0-9]{12,20}"}


def identifiers(documents: DataFrame) -> DataFrame:
    """(doc_id, source, type, n, raw) of what looks like an identifier."""
    found = F.array(*[F.struct(F.lit(t).alias("type"), F.regexp_extract_all("text", F.lit(f"({p})"), 1).alias("raws")) for t, p in _FINDS.items()])
    rows = documents.select("doc_id", "source", F.explode(found).alias("f")).select("doc_id", "source", "f.type", F.posexplode("f.raws").alias("n", "raw"))
    return rows.withColumn("n", F.col("n").cast("long"))


_UNION = " UNION ALL ".join(f"SELECT source, '{t}' AS type, unnest(regexp_extract_all(text, '{p}')) AS raw FROM documents" for t, p in _FINDS.items())
_PHONE_OK = "CASE WHEN n LIKE '03%' THEN regexp_matches(n, '^03[0-5][0-9]{8}$') WHEN n NOT LIKE '0%' THEN false ELSE length(n) BETWEEN 10 AND 11 END"


@query(f"""SELECT source, type, count(*) AS found, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS review FROM (
    SELECT source, type, CASE type WHEN 'email' THEN regexp_matches(raw, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$') WHEN 'account' THEN true WHEN 'iban' THEN regexp_matches(raw, '^PK[0-9]{{2}}HABB[A-Z0-9]{{16}}$') ELSE {_PHONE_OK} END AS ok
    FROM (SELECT *, regexp_replace(regexp_replace(raw, '[^0-9+]', '', 'g'), '^\\+?92', '0') AS n FROM ({_UNION}))) GROUP BY source, type""")
def q_identifier_review(t: Tables) -> DataFrame:
    return review(t.documents)


def review(documents: DataFrame) -> DataFrame:
    found = identifiers(documents).withColumn("found", assess(F.col("raw"), F.col("type")))
    level = F.when(F.col("found.valid"), "high").otherwise("low")
    flagged = found.withColumn("review", needs_review(level, F.col("found.valid"), F.array()))
    return flagged.groupBy("source", "type").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("found.valid")).alias("valid"), F.count_if("review").alias("review"))
