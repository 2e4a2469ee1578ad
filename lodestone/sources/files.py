"""Readers and writers of the file formats the data comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QA_SCHEMA = "ID STRING, question STRING, answer ARRAY<STRING>, sexpr STRING, function_list ARRAY<STRING>, sparql STRING, level STRING"
DUMP_SCHEMA = "input STRING, output STRING, gts STRUCT<sexpr: STRING, target: ARRAY<STRING>, function_list: ARRAY<STRING>>, score DOUBLE, step INT, mid_f1 DOUBLE, structure_reward DOUBLE, timeout_penalty DOUBLE"


def read_json_array(spark: SparkSession, path: str, schema: str = QA_SCHEMA) -> DataFrame:
    """Rows of files that hold one JSON array, or one object. The schema is given, so nothing is read twice."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_dumps(spark: SparkSession, path: str, schema: str = DUMP_SCHEMA) -> DataFrame:
    """Rows of a folder of <stem>.jsonl files with their file_stem (a string, and so ordered); malformed and blank lines and lines
    of other JSON are left out."""
    parsed = T.StructType.fromDDL(schema + ", _bad STRING")
    rows = spark.read.text(path).select("*", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("_stem"))
    body = F.trim(F.translate("value", "\t\r", "  "))
    rows = rows.where(body.startswith("{") & body.endswith("}")).withColumn("_r", F.from_json("value", parsed, {"columnNameOfCorruptRecord": "_bad"})).where("_r._bad IS NULL")
    stem = F.col("file_stem") if "file_stem" in rows.columns else F.col("_stem")
    return rows.select(stem.cast("string").alias("file_stem"), *[F.col(f"_r.{f.name}").alias(f.name) for f in parsed.fields if f.name != "_bad"])


def write_dumps(df: DataFrame, path: str) -> None:
    """JSON lines, one folder for each step, which is also kept as a partition column."""
    df.write.mode("overwrite").partitionBy("step").json(path)


def tolerant(text: Column, schema: str) -> Column:
    """struct(value, raw): text parsed as JSON, or kept raw where it isn't that JSON."""
    v = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    bad = v.isNull() | (F.to_json(v) == "{}")
    return F.struct(F.when(~bad, v).alias("value"), F.when(bad, text).alias("raw"))


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """(role, domain, range) of white-space separated ontology lines; shorter lines have nulls."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(f, F.lit(1)).alias("role"), F.get(f, F.lit(0)).alias("domain"), F.get(f, F.lit(2)).alias("range"))


def from_previous(rows: DataFrame, previous: DataFrame, key: Column, value: str) -> DataFrame:
    """rows with the value an earlier output holds for their key; of several, the least. No match gives null."""
    known = previous.groupBy(F.col("key").alias("_k")).agg(F.min(value).alias(value))
    return rows.withColumn("_k", key).join(known, "_k", "left").drop("_k")
