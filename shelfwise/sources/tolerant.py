"""Readers for files as people leave them: CSV of several encodings, journals with broken lines, subtitles, TSV logs."""

from __future__ import annotations

import contextlib
import csv
import io
import itertools
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "ts timestamp, run_id string, title_id bigint, stage string, op string, from_ string, to string, size bigint, result string, reason string"


csv.field_size_limit(min(sys.maxsize, 2**31 - 1))  # a cell may be long


def files(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, size_bytes, mtime) of all files below a folder, without those under a folder named in `skip`; contents are
    not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return found.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*skip))) if skip else found


def decoded(content: bytes) -> str:
    """A file's text: UTF-16 by a byte order mark, else UTF-8 if all bytes decode, else Windows-1252 if they do, else Latin-1."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    for encoding in ("utf-8-sig", "cp1252"):
        with contextlib.suppress(UnicodeDecodeError):
            return content.decode(encoding)
    return content.decode("latin-1")


def _records(content: bytes, sep: str) -> tuple[list[str], Iterator[list[str]]]:
    """(names of the header, rows) of a CSV file; zero characters are dropped."""
    rows = csv.reader(io.StringIO(decoded(content).replace("\0", ""), newline=""), delimiter=sep)
    return next(rows, []), rows


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings, quoted line ends kept, zero characters dropped, blank cells null, of a file or a folder of files in
    any mixture of encodings. Each file is decoded where it is read, by its whole content; only the names of columns come to
    the driver. Files may differ in their columns: the result has those of all, in the order of the first file that has
    them. Cells beyond a file's header are left out; a name that occurs twice in a header counts where it comes last.
    A file is a row of the scan, so one of more than 2 GB raises an error."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files.path, files.content, strict=True):
                header, _ = _records(content, sep)
                yield pd.DataFrame({"name": header, "path": name, "place": range(len(header))})

    named = found.mapInPandas(headers, "name string, path string, place int")
    names = [r.name for r in named.groupBy("name").agg(F.min(F.struct("path", "place")).alias("first")).orderBy("first").collect()]  # the columns
    if not names:
        return spark.createDataFrame([], "value string").limit(0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files.content:
                header, records = _records(content, sep)
                at = [{n: k for k, n in enumerate(header)}.get(n) for n in names]
                records = (r for r in records if r)
                while some := list(itertools.islice(records, 10_000)):
                    yield pd.DataFrame([[(r[k].strip() or None) if k is not None and k < len(r) else None for k in at] for r in some], columns=range(len(names)), dtype=object)

    numbered = found.select("path", "content").mapInPandas(rows, ", ".join(f"`{k}` string" for k in range(len(names))))
    return numbered.toDF(*names)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines; blank and malformed ones are dropped, keys that a line lacks are null."""
    rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("op").isNotNull())


def append_journal(rows: DataFrame, path: str, dry_run: bool = True) -> None:
    """Appends lines; in a dry run every result but "skipped" reads "dry-run"."""
    result = F.when(F.col("result").isin("dry-run", "skipped"), F.col("result")).otherwise("dry-run") if dry_run else F.col("result")
    rows.withColumn("result", result).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(new_path, orig_path, reason) of a headerless TSV log; lines with fewer parts are dropped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    return parts.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("new_path", "orig_path", "reason"))])


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): dialogue of SRT files without counters, time codes, tags, notes and labels."""
    from shelfwise.operators.retrieval import dialogue

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("t"))
    bare = F.regexp_replace(F.regexp_replace("t", r"(?m)^\d+\s*$", ""), r"(?m)^\d\d:\d\d:\d\d[,.]\d+ --> .*$", "")
    return whole.select("path", dialogue(bare).alias("text"))


def read_show_list(spark: SparkSession, path: str) -> DataFrame:
    """(show) of a text list; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("show")).where("show <> '' and not startswith(show, '#')")


def read_nfo(spark: SparkSession, path: str) -> DataFrame:
    """(path, imdb_id, tmdb_id, title, year) of metadata files, broken markup included."""
    from shelfwise.functions.paths import nfo_ids

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), nfo_ids(F.col("value")).alias("n"))
    return whole.select("path", "n.*")


def cached(cache: DataFrame, wanted: DataFrame, key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Lookups by a response cache (key, response): (wanted with the parsed response, keys still to fetch). A stored 404
    counts as an answer without content."""
    parsed = cache.select(F.col("key").alias(key), F.from_json("response", schema).alias("found"), F.lit(True).alias("known"))
    joined = wanted.join(parsed, key, "left")
    return joined.drop("known"), joined.where("known is null").select(key).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays as "; " lists, nulls as blanks; the commit protocol replaces the table as a whole."""
    flat = [F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, nullValue="")
