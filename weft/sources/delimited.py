"""Delimited text: every column is text, every cell trimmed, every record's width checked.

``scan`` is the one to use: all files of a job in one reader, split like any text, each
record with its file and number.  A first pass over the text counts the lines of every
block, so that numbers need no order across tasks, and finds headers and files whose
quoted cells span lines; those few files go to ``numbered``.

``native`` is Spark's own reader (no numbers).  ``numbered`` is a Python data source that
parses records which span lines: one partition a file, read as a stream.
"""

from __future__ import annotations

import csv
import fnmatch
import io
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions import exprs

BAD = "_bad"
FILE, LINE = "_file", "_line"


def files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files at any depth under ``folder`` whose *name* matches; none is an error."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(root, True)
    while it.hasNext():
        path = it.next().getPath()
        if fnmatch.fnmatchcase(path.getName(), pattern):
            found.append(path.toString())
    if not found:
        raise FileNotFoundError(f"no file under {folder} matches {pattern}")
    return sorted(found)


def header(spark: SparkSession, path: str, separator: str) -> list[str]:
    """The names in the first record of a file."""
    first = spark.read.text(path, wholetext=False).limit(1).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return _names(first.value, path, separator)


def _names(line: str, path: str, separator: str) -> list[str]:
    names = [c.strip() for c in next(csv.reader(io.StringIO(line.lstrip("\ufeff")), delimiter=separator), [])]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"{path}: columns {twice} twice")
    return names


def require(columns: Sequence[str], wanted: Sequence[str], where: str) -> None:
    missing = [c for c in dict.fromkeys(wanted) if c not in columns]
    if missing:
        raise ValueError(f"{where}: no column {missing}")


def _trimmed(df: DataFrame, names: Sequence[str], *more: str) -> DataFrame:
    return df.select(*[exprs.cell(F.col(f"`{n}`")).alias(n) for n in names], *more)


def native(spark: SparkSession, path: str | list[str], names: Sequence[str], separator: str = "\t") -> DataFrame:
    """All columns as text, and ``_bad``: the record's text where its width is wrong."""
    schema = ", ".join(f"`{n}` string" for n in names) + f", {BAD} string"
    raw = spark.read.schema(schema).csv(path, sep=separator, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True, columnNameOfCorruptRecord=BAD, mode="PERMISSIVE")
    return _trimmed(raw, names, BAD)


def _blocks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``value, file, block, n`` of every line; ``n`` goes up by one from line to line of a block."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def scan(spark: SparkSession, paths: Sequence[str], separator: str, wanted: Sequence[str] = ()) -> DataFrame:
    """Records of files as text columns, with ``_bad``, ``_file`` and ``_line``; columns that a file lacks are null.

    ``wanted`` columns must be in every file.  The driver holds one row a block of text.
    """
    lines = _blocks(spark, paths)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("lines"), F.min("n").alias("first"), F.min_by("value", "n").alias("head"), F.max(quotes % 2).alias("open")
    ).orderBy("file", "block").collect()
    files: dict[str, list] = {}
    for b in blocks:
        files.setdefault(b.file, []).append(b)
    empty = [p for p in paths if not any(f == p or f.endswith(p.removeprefix("file:").lstrip("/")) for f in files)]
    if empty:
        raise ValueError(f"{empty[0]} is empty")
    layouts: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file, own in files.items():
        names = _names(own[0].head, file, separator)
        require(names, wanted, file)
        layouts.setdefault((tuple(names), any(b.open for b in own)), []).append(file)
    out = []
    for (names, spanning), own in layouts.items():
        if spanning:
            out.append(numbered(spark, own, names, separator))
            continue
        offsets = []
        for file in own:
            before = 0
            for b in files[file]:
                offsets.append((b.file, b.block, before - b.first))
                before += b.lines
        # what joins is one row a block: Catalyst knows its size and broadcasts it while it is small
        starts = spark.createDataFrame(offsets, "file string, block long, shift long")
        out.append(_parsed(lines.join(starts, ["file", "block"]).withColumn("number", F.col("n") + F.col("shift") + 1).where("number > 1"), names, separator))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def _parsed(lines: DataFrame, names: Sequence[str], separator: str) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names) + f", {BAD} string"
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    cells = F.from_csv("value", schema, options)
    blank = F.trim("value") == ""
    parsed = lines.withColumn("_cells", cells)
    bad = F.when(blank & F.lit(len(names) > 1), F.col("value")).otherwise(F.col(f"_cells.{BAD}"))
    picked = [F.when(bad.isNull(), exprs.cell(F.col(f"_cells.`{n}`"))).alias(n) for n in names]
    return parsed.select(*picked, bad.alias(BAD), F.col("file").alias(FILE), F.col("number").cast("long").alias(LINE))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class NumberedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.separator = options.get("separator", "\t")
        self.paths = [options[f"path{i}"] for i in range(int(options["paths"]))]

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(partition.path) if "://" in partition.path or partition.path.startswith("file:") else (pafs.LocalFileSystem(), partition.path)
        with fs.open_input_stream(path) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as text:
            for number, cells in enumerate(csv.reader(text, delimiter=self.separator), 1):
                if number > 1:
                    yield partition.path, number, [c.strip() for c in cells]


class Numbered(DataSource):
    """``(_file, _line, cells)`` of delimited files; the header is record 1."""

    @classmethod
    def name(cls) -> str:
        return "weft_numbered"

    def schema(self) -> str:
        return f"{FILE} string, {LINE} bigint, cells array<string>"

    def reader(self, schema) -> NumberedReader:  # noqa: ANN001
        return NumberedReader(self.options)


def numbered(spark: SparkSession, paths: Sequence[str], names: Sequence[str], separator: str = "\t") -> DataFrame:
    """As ``native``, with ``_file`` and ``_line``; a blank line is a record of the wrong width."""
    spark.dataSource.register(Numbered)
    reader = spark.read.format("weft_numbered").option("separator", separator).option("paths", str(len(paths)))
    for i, path in enumerate(paths):
        reader = reader.option(f"path{i}", path)
    raw = reader.load()
    wrong = F.size("cells") != len(names)
    picked = [F.when(~wrong, F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)]
    return raw.select(*picked, F.when(wrong, F.array_join("cells", separator)).alias(BAD), FILE, LINE)
