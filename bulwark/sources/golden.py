"""Golden datasets: one JSON object per line, with blank and ``#`` lines ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default model of a record.
DEFAULT_MODEL = "llama3.2"
LIVE_SCHEMA = (
    "input string, model string, context_documents array<string>, expected_output string, "
    "expected_blocked boolean"
)
OFFLINE_SCHEMA = LIVE_SCHEMA + (
    ", output string, tags array<string>, prompt_version string, record_id string"
)
# monotonically_increasing_id counts rows of a task in its low 33 bits.
_LOW_BITS = (1 << 33) - 1


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Kept lines with the file and file block they come from."""
    text = F.regexp_replace("value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    lines = spark.read.text(path).select(
        text.alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def with_index(kept: DataFrame, keep: Column) -> DataFrame:
    """Add ``record_index``: 0, 1, 2, ... over the rows where ``keep`` holds, in file order.

    Rows are numbered inside their file block by a task-local counter. Offsets come in two levels:
    a block's inside its file, and a file's among the files, one short row each. No row is moved to
    number it.
    """
    # The counter must count only rows that get an index, so it is taken after the filter.
    chosen = kept.where(keep).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))
    )
    blocks = chosen.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(*before)
    of_files = Window.orderBy("_file").rowsBetween(*before)
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(of_files), F.lit(0)).alias("_start")
    )
    inside = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    offsets = inside.join(files, "_file").select("_file", "_block", "_first", (F.col("_start") + F.col("_offset")).alias("_offset"))
    indexed = chosen.join(offsets, ["_file", "_block"])
    return indexed.withColumn("record_index", F.col("_offset") + F.col("_row") - F.col("_first"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Malformed lines and lines without ``input`` fail the read."""
    with_json = lines.withColumn("r", F.from_json("line", schema, {"mode": "FAILFAST"})).withColumn(
        "_keys", F.json_object_keys("line")
    )
    has_input = F.array_contains("_keys", "input")
    checked = F.when(has_input, F.col("r.input")).otherwise(
        F.raise_error(F.concat(F.lit("record without input: "), "line")).cast("string")
    )
    return with_json.withColumn("_input", checked)


def _default(field: str, value: Column) -> Column:
    """The field as written (also null), or the default when its key is absent."""
    return F.when(F.array_contains("_keys", field), F.col(f"r.{field}")).otherwise(value)


def _common() -> list[Column]:
    return [
        F.col("record_index"),
        F.col("_input").alias("input"),
        _default("model", F.lit(DEFAULT_MODEL)).alias("model"),
        _default("context_documents", F.array().cast("array<string>")).alias("context_documents"),
        F.col("r.expected_output").alias("expected_output"),
        _default("expected_blocked", F.lit(False)).alias("expected_blocked"),
    ]


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Live form: every kept line is a record."""
    lines = with_index(read_lines(spark, path), F.lit(True))
    return _parsed(lines, LIVE_SCHEMA).select(*_common())


def read_offline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Offline form: (records, rejected lines). A record needs the key ``output``; its value may
    be null."""
    lines = read_lines(spark, path)
    has_output = F.coalesce(F.array_contains(F.json_object_keys("line"), "output"), F.lit(True))
    records = _parsed(with_index(lines, has_output), OFFLINE_SCHEMA).select(
        *_common(),
        F.col("r.output").alias("output"),
        _default("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("r.prompt_version").alias("prompt_version"),
        F.col("r.record_id").alias("record_id"),
    )
    rejected = lines.where(~has_output).select("line", F.col("_file").alias("file"))
    return records, rejected
