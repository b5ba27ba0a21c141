"""Sources and sinks: files, state tables, backups, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUFFIXES = ("pdf", "txt", "md", "docx")


def scan_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, mtime, length, hash of all files below a folder with one of the suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length", F.sha2("content", 256).alias("hash"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A state table, or an empty one where none was written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def write_state(df: DataFrame, path: str, version: int) -> None:
    """A new version beside the others; readers choose by ``version``."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def backup(df: DataFrame, path: str, key: str, max_rows: int = 1_000_000) -> DataFrame:
    """Gzip JSON in parts of ``max_rows``, and its manifest: rows and an order-free checksum."""
    df.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", max_rows).json(path)
    return manifest(df, key)


def manifest(df: DataFrame, key: str) -> DataFrame:
    row = F.md5(F.to_json(F.struct(*sorted(df.columns))))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.bit_xor(number).alias("checksum"), F.count_distinct(key).alias("keys"))


def restore(spark: SparkSession, path: str, schema: StructType, key: str, expected: DataFrame) -> DataFrame:
    """The rows of a backup; raises if the manifest differs."""
    df = spark.read.schema(schema).json(path)
    if manifest(df, key).first() != expected.first():
        raise ValueError(f"the backup at {path} does not match its manifest")
    return df


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str, valid: Column, at: str = "ts") -> DataFrame:
    """Appends valid rows as JSON lines by month and gives back the others."""
    ok = df.filter(F.coalesce(valid, F.lit(False))).withColumn("event_month", F.date_format(at, "yyyy-MM"))
    ok.write.mode("append").partitionBy("event_month").json(path)
    return df.filter(~F.coalesce(valid, F.lit(False)))


def annotation_tasks(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*columns)).alias("data"))


def parse_annotations(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, annotator, name, choice of nested annotation JSON."""
    kind = "array<struct<completed_by:bigint,result:array<struct<from_name:string,value:struct<choices:array<string>>>>>>"
    a = df.select(key, F.explode(F.from_json(payload, kind)).alias("a")).select(key, F.col("a.completed_by").alias("annotator"), F.explode("a.result").alias("r"))
    return a.select(key, "annotator", F.col("r.from_name").alias("name"), F.explode("r.value.choices").alias("choice"))
