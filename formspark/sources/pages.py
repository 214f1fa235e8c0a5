"""Page selections, printed blanks, and the tables that a run reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formspark.functions import rules
from formspark.functions.text import clean_label

# Schemas of the tables of a run, as Spark DDL.
SCHEMAS = {
    "template_fields": "id string, page int, kind string, label string, rect array<double>, section string, cells array<array<double>>, grid_hint string, `group` string, `table` string, mirror boolean, select_mode string, row_y double, continuation_of string, ordinal int",
    "alignment": "scan_page int, template_page int, inliers int, coverage double, offset_px double, searched boolean, ok boolean, problems array<string>",
    "field_index": "field string, page int, kind string, label string, section string, `table` string, grid_hint string, cells int, continuation_of string, row_y double, rect array<double>, crop_rect array<double>, ink_px bigint, core_px bigint, baseline_px bigint, gate bigint, ink_hint string, needs_model boolean",
    "reads": "doc string, field string, value string, source string, model string, seconds double, was string, disputed boolean",
    "edits": "doc string, field string, value string, original string, at double, reverted boolean",
}


def selected_pages(specs: DataFrame, keys: list[str], spec: str, total: int) -> DataFrame:
    """(keys, page) of selections such as "2", "1,3", "2-4", "all": distinct pages from 1 to total.

    A range may be reversed; what is neither a number nor a range raises an error.
    """
    text = F.regexp_replace(F.coalesce(F.col(spec), F.lit("")), r"\s", "")
    text = F.when((text == "") | (F.lower(text) == "all"), f"1-{total}").otherwise(text)
    parts = specs.select(*keys, F.explode(F.split(text, ",")).alias("part")).where("part <> ''")
    shape = r"^([0-9]+)(?:-([0-9]+))?$"
    first = F.when(F.col("part").rlike(shape), F.regexp_extract("part", shape, 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a page or page range: "), "part")).cast("int"))
    second = F.coalesce(F.nullif(F.regexp_extract("part", shape, 2), F.lit("")).cast("int"), first)
    bounds = parts.select(*keys, first.alias("a"), second.alias("b"))
    low, high = F.greatest(F.least("a", "b"), F.lit(1)), F.least(F.greatest("a", "b"), F.lit(total))
    return bounds.where(low <= high).select(*keys, F.explode(F.sequence(low, high)).alias("page")).distinct()


def blank_labels(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, n, label) of each run of four underscores or more: named by the printed text that leads to it."""
    parts = lines.select(*keys, F.posexplode(F.split(line, "_{4,}")).alias("n", "lead"), F.size(F.split(line, "_{4,}")).alias("__parts"))
    parts = parts.where("n < __parts - 1").drop("__parts").withColumns({"n": F.col("n") + 1, "lead": F.lower(F.btrim("lead"))})
    label = F.coalesce(F.nullif(clean_label(F.right(F.col("lead"), F.lit(40))), F.lit("")), F.lit("Undertaking"))
    for pattern, name in reversed(rules.BLANK_LABELS):
        label = F.when(F.col("lead").rlike(pattern), name).otherwise(label)
    return parts.select(*keys, "n", label.alias("label"))


def read_json(spark: SparkSession, path: str, name: str, required: bool = True) -> DataFrame:
    """A JSON table of a run by its fixed schema; empty if it may be missing and is."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Page images as bytes, for an image operator to decode."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def admitted(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Files that a run takes, and why others are refused."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(~ending.isin("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"), "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > most_bytes, "too large")
    return files.withColumn("refused", reason)


def write_csv(records: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Records as CSV in (page, field) order; the first file starts with a byte-order mark, as some readers want.

    Without ``columns`` those of a result, empty where records lack one.
    """
    have = records.orderBy("page", "field")
    missing = {c: F.lit(None).cast("string") for c in columns or rules.CSV_COLUMNS if c not in records.columns}
    have = have.withColumns(missing) if missing else have
    mark = [F.col(c).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(columns or rules.CSV_COLUMNS)]
    have.select(*mark).write.mode("overwrite").csv(path, header=True)


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_pages(df: DataFrame, path: str, keys: list[str]) -> None:
    """A table by its keys; only partitions that ``df`` has are replaced, each by Spark's commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
