"""JSON-lines and CSV sources and sinks."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Rows of JSON objects; a line that is none fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings; a byte order mark before the first name is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema) if schema else spark.read.option("mode", "FAILFAST").json(path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError(f"neither .jsonl nor .csv: {path}")


def expanded(paths: list[str]) -> list[str]:
    """The files of paths, folders and patterns in order, each once."""
    out: dict[str, None] = {}
    for path in paths:
        found = [os.path.join(path, x) for x in sorted(os.listdir(path))] if os.path.isdir(path) else sorted(glob.glob(path)) if glob.has_magic(path) else [path]
        out |= dict.fromkeys(x for x in found if not os.path.basename(x).startswith((".", "_")))
    return list(out)


def read_many(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """JSON lines of all files, with file (its name) and lang (what the name tells)."""
    from clauseloom.functions import text as T

    rows = read_jsonl(spark, expanded(paths), schema).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.withColumn("lang", T.language_of_file(F.col("file")))


def read_optional(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """The table at a path; where there is none an empty one, or an error if strict."""
    if os.path.exists(path):
        return read_jsonl(spark, path, schema)
    if strict:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def read_first(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """The first of the paths that exists; none is an error."""
    for path in paths:
        if os.path.exists(path):
            return read_jsonl(spark, path, schema)
    raise FileNotFoundError(", ".join(paths))


def limited(rows: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows in an order; all of them for none or no positive number."""
    return rows.orderBy(*order).limit(n) if n and n > 0 else rows


def settings(defaults: dict, prefix: str) -> dict:
    """The defaults, each replaced by the environment's value of its name in its own type."""
    out = {}
    for name, value in defaults.items():
        given = os.environ.get(f"{prefix}_{name}".upper())
        if given is None or given == "":
            out[name] = value
        elif isinstance(value, bool):
            out[name] = given.strip().lower() in ("1", "true", "yes", "on")
        else:
            out[name] = type(value)(given) if value is not None else given
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, text of the page files (<name>.pages.json: a list of page and text) beside scanned or printed documents."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.pages\.json$", 1).alias("doc"), F.from_json("value", "array<struct<page:int,text:string>>").alias("p"))
    return raw.select("doc", F.explode("p").alias("x")).select("doc", "x.*")


def checked_lines(spark: SparkSession, path: str, schema: str, required: list[str], text: str) -> DataFrame:
    """Every line with its fields and the first reason to reject it (null: none): empty_line, invalid_json,
    missing_required_fields, empty_text_field, duplicate_sample_id."""
    raw = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    parsed = raw.withColumn("row", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    lacks = F.lit(False)
    for name in required:
        lacks = lacks | (F.coalesce(F.col(f"row.{name}").cast("string"), F.lit("")) == "")
    reason = (
        F.when(F.trim("value") == "", "empty_line").when(F.col("row._corrupt_record").isNotNull() | F.col("row").isNull(), "invalid_json")
        .when(lacks, "missing_required_fields").when(F.trim(F.coalesce(F.col(f"row.{text}"), F.lit(""))) == "", "empty_text_field")
    )
    judged = parsed.withColumn("reason", reason)
    firsts = judged.where("reason is null").groupBy(F.col("row.sample_id").alias("key")).agg(F.min("id").alias("first"))
    named = judged.join(firsts, (judged["row.sample_id"] == firsts["key"]) & judged["reason"].isNull(), "left")
    repeated = F.col("reason").isNull() & (F.col("id") != F.col("first"))
    return named.select("row.*", F.when(repeated, "duplicate_sample_id").otherwise(F.col("reason")).alias("reason"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def guarded(path: str, protected: list[str]) -> str:
    """The path, unless it is one of the protected folders or lies in one."""
    for folder in protected:
        if os.path.commonpath([os.path.abspath(path), os.path.abspath(folder)]) == os.path.abspath(folder):
            raise ValueError(f"protected: {path}")
    return path


def written_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """file, rows, broken, without_key of the JSON lines of a folder as they were written."""
    raw = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.get_json_object("value", f"$.{key}").alias("key"), F.try_parse_json("value").isNull().alias("broken"))
    return raw.groupBy("file").agg(F.count("*").alias("rows"), F.count_if("broken").alias("broken"), F.count_if(F.coalesce("key", F.lit("")) == "").alias("without_key"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change (added, removed or changed) between two manifests; no rows where they are equal."""
    a, b = before.select("file", F.col("sha256").alias("x")), after.select("file", F.col("sha256").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, "file", "full").select("file", change.alias("change")).where("change is not null")


def summary_table(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, as a summary isn't the place for them."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many rows for a summary")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]]) + "\n"


def write_jsonl(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """All parts under the union of their columns, in order of first appearance."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole.write.mode("overwrite").option("header", True).csv(path)
