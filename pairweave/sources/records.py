"""Readers and writers of records: declared schemas, strict modes, no overwriting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scans import RANGE_ROWS, scanned


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = False,
) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. ``strict``: a bad line or an empty source is an error."""
    out = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    if strict and out.isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def read_object(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_shards(
    spark: SparkSession, pattern: str, schema: str | T.StructType, leave_out: list[str] | None = None, depth: int = 0,
) -> DataFrame:
    """All files of a glob, with ``shard``, the file's name without its endings; names that hold a ``leave_out`` part are left out.

    ``depth``: how many folders above the files the name is taken (1 for folders of part files).
    """
    name = F.regexp_extract(F.input_file_name(), "([^/]+)" + "/[^/]+" * depth + "$", 1)
    out = read_jsonl(spark, pattern, schema).withColumn("shard", name)
    for part in leave_out or []:
        out = out.where(~F.contains("shard", F.lit(part)))
    return out.withColumn("shard", F.substring_index("shard", ".", 1))


def append_shards(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in a folder for each value of ``by``, whichever values there are; files that are there stay."""
    df.write.mode("append").partitionBy(by).option("ignoreNullFields", False).json(path)


def read_shard_folders(
    spark: SparkSession, path: str, schema: str, by: str, leave_out: list[str] | None = None,
) -> DataFrame:
    """What ``append_shards`` wrote, with ``by``; folders whose value holds a ``leave_out`` part are not read at all."""
    out = spark.read.schema(f"{schema}, `{by}` string").json(path)
    for part in leave_out or []:
        out = out.where(F.col(by).isNull() | ~F.contains(by, F.lit(part)))
    return out


def read_assigned_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a ``name = [...];`` script."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)=\s*(\[.*\])\s*;?\s*$", 1)
    return text.select(F.inline(F.from_json(body, f"array<struct<{schema}>>")))


def read_report(spark: SparkSession, path: str, header: str, line: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Lines of reports that match ``line``, each with the last header above it in its file (the text of the header's group 1).

    Large files are read in splits. Only headers and wanted lines go on; a split's last header is carried to the splits after
    it by a scan over the splits, so that neither a file nor a section is in one task.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"),
    )
    title = F.when(F.rlike("line", F.lit(header)), F.regexp_extract("line", header, 1))
    wanted = text.withColumns({"title": title, "wanted": F.rlike("line", F.lit(line))}).where("wanted OR title IS NOT NULL")
    # Within a split, n rises line by line.
    titled = scanned(wanted, ["file"], ["split", "n"], {"section": ("last", F.col("title"))}, range_rows)
    return titled.where("wanted").select("file", "line", "section")


def canonical_json(df: DataFrame) -> Column:
    """Each row as JSON with sorted keys, at every depth (those of maps too), and no spaces."""

    def ordered(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(
                *[ordered(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
            )
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: ordered(x, kind.elementType))
        if isinstance(kind, T.MapType):
            entries = F.array_sort(F.map_entries(column))
            return F.map_from_entries(
                F.transform(entries, lambda e: F.struct(e["key"], ordered(e["value"], kind.valueType)))
            )
        return column

    parts = [ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def flat_metrics(df: DataFrame) -> DataFrame:
    """Nested numbers and booleans (as 0 and 1) as columns named a/b/c; other fields go."""
    out: list[Column] = []

    def walk(column: Column, kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f.dataType, f"{path}/{f.name}" if path else f.name)
        elif isinstance(kind, T.BooleanType):
            out.append(column.cast("int").alias(path))
        elif isinstance(kind, T.NumericType):
            out.append(column.alias(path))

    for f in df.schema.fields:
        walk(F.col(f.name), f.dataType, f.name)
    return df.select(*out)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; by default an existing path is an error. ``append`` never rewrites what is there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


#: Files up to this size are hashed as one value, larger ones block by block.
WHOLE_BYTES, BLOCK = 64 << 20, 8 << 20


def file_digests(spark: SparkSession, paths: list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """file (its last two names), n_bytes and sha256 of each file under the paths.

    A task holds ``whole_bytes`` or a block of a file, whatever its size. Large files are streamed through the file system that
    their path's scheme names (local, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    name = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    small = files.where(F.col("length") <= whole_bytes).select(
        name.alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"),
    )
    large = files.where(F.col("length") > whole_bytes).select(name.alias("file"), F.col("length").alias("n_bytes"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(row["path"].replace("file:///", "/") if row["path"].startswith("file:") else row["path"])
                digest = hashlib.sha256()
                with store.open_input_stream(place) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "n_bytes": row["n_bytes"], "sha256": digest.hexdigest()}])

    spread = large.repartition("path")  # a file is one piece of work
    return small.union(spread.mapInArrow(run, "file string, n_bytes long, sha256 string"))
