"""Reading and writing flow files (SRC-01 to SRC-07, SNK-01, SNK-06 to SNK-09)."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.operators.cleaning import strip_names
from flowguard.operators.profiling import duplicate_names


def _files(spark: SparkSession, path: str, recursive: bool) -> list[str]:
    """CSV files under a path on any file system Spark can read; the listing holds names only."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(recursive).lower())
    return sorted(r[0] for r in reader.load(path).select("path").collect())


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whatever the scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scan_directory(spark: SparkSession, folder: str) -> list[str]:
    """SRC-01: the CSV files directly in a folder; an error when there are none."""
    found = _files(spark, folder, False)
    if not found:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return found


def find_csv_files(spark: SparkSession, path: str) -> list[str]:
    """SRC-02: one CSV file, or all below a folder of any name; a file with another suffix is an error."""
    place, files = _hadoop(spark, path)
    if not files.exists(place):
        raise FileNotFoundError(path)
    if files.getFileStatus(place).isDirectory():
        found = _files(spark, path, True)
        if not found:
            raise FileNotFoundError(f"no CSV files below {path}")
        return found
    if PurePosixPath(path).suffix.lower() != ".csv":
        raise ValueError(f"{path} is not a CSV file")
    return [path]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """SRC-05: a partitioned read with a header. Without a schema every column is text, never inferred."""
    reader = spark.read.option("header", True).option("enforceSchema", False if schema else True)
    return (reader.schema(schema) if schema else reader).csv(path)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names as the file's first line gives them, repeated ones included. One line is read and no job runs."""
    place, files = _hadoop(spark, path)
    java = spark._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(files.open(place), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return next(csv.reader([line.removeprefix("\ufeff")])) if line else []


def _first_lines(enough: int):
    """The first line of every file that begins in a task. A block of at least `enough` bytes is alone in its task, which
    stops after its first lines."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            files, starts, lengths, lines = (batch.column(i) for i in range(4))
            names = files.to_numpy(zero_copy_only=False)
            for at in np.flatnonzero(np.append(True, names[1:] != names[:-1])):
                if names[at] != seen and starts[at].as_py() == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([names[at]]), lines.slice(at, 1)], names=["file", "line"])
                seen = names[at]
            if lengths[0].as_py() >= enough:
                return
    return first


def headers_of(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, by one job over all files, in the order given.

    Tasks read the small files they hold and the first lines of each block of a large one. A file whose first line was not
    met (an empty one, or a large block that shared its task) is opened from here.
    """
    block = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_block_length")]
    lines = spark.read.text(files).select(*meta, "value").mapInArrow(_first_lines(block // 2), "file string, line string")
    known = {_name(unquote(f)): r["line"] for r in lines.groupBy("line").agg(F.collect_list("file").alias("files")).collect() for f in r["files"]}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        place, system = (None, None) if ":" in f else _hadoop(spark, f)
        line = known.get(_name(f if place is None else system.makeQualified(place).toString()))
        names = header_of(spark, f) if line is None else next(csv.reader([line.removeprefix("\ufeff")]))
        by_header.setdefault(tuple(names), []).append(f)
    return by_header


def _name(path: str) -> str:
    """A path without the slashes behind its scheme, whose number differs between listings and scans."""
    return re.sub(r"^([a-zA-Z0-9+.-]+:)/+", r"\1/", path)


def check_headers(headers: list[list[str]]) -> None:
    """SET-02 and the strict rule of SRC-03: as many columns, and the same names in any order."""
    first = [h.strip() for h in headers[0]]
    for other in headers[1:]:
        names = [h.strip() for h in other]
        odd = sorted(set(first) ^ set(names))
        if len(names) != len(first) or odd:
            raise ValueError(f"files disagree on columns: {odd or 'different counts'}")


def strict_union(parts: list[DataFrame]) -> DataFrame:
    """SRC-03 and SET-01."""
    check_headers([p.columns for p in parts])
    return reduce(lambda a, b: a.unionByName(b), [strip_names(p) for p in parts])


def loose_union(parts: list[DataFrame]) -> DataFrame:
    """SRC-04: a column missing from one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [strip_names(p) for p in parts])


def load_merged(spark: SparkSession, files: list[str], strict: bool = True) -> DataFrame:
    """SRC-03 or SRC-04 over files. Files that share one header are read by a single scan.

    A name that one header repeats is an error (DQ-05), since its columns could not be told apart.
    """
    by_header = headers_of(spark, files)
    for header, names in by_header.items():
        if repeated := duplicate_names(list(header)):
            raise ValueError(f"{names[0]} repeats the columns {repeated}")
    if strict:
        check_headers([list(h) for h in by_header])
    parts = [read_csv(spark, names) for names in by_header.values()]
    return strict_union(parts) if strict else loose_union(parts)


def first_rows(df: DataFrame, rows: int = 0) -> DataFrame:
    """SRC-06: the first rows of a file, 0 for all."""
    return df.limit(rows) if rows else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """SNK-01 and SNK-09."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-07: train and test rows of one table; `split` is its partition column, so each side is pruned."""
    table = spark.read.parquet(path)
    return table.where("split = 'train'").drop("split"), table.where("split = 'test'").drop("split")


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-06: results as CSV with the probability map as JSON text."""
    flat = df.withColumn("Class_Probabilities", F.to_json("Class_Probabilities"))
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-07: a summary frame as JSON lines."""
    df.write.mode(mode).json(path)


def write_summaries(tables: dict[str, DataFrame], folder: str) -> None:
    """SNK-08: one CSV per profile table."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")
