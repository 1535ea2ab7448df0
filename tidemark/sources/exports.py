"""Text exports with a preamble, and exports that are committed (SRC1-3, SNK1-2).

**Preambles by position.**  ``numbered_lines`` scans text files once.  Every line
has its file, the place where its block begins in the file
(``_metadata.file_block_start``) and its number in the block; in the block that
begins at 0 that is the number in the file.  The lines before the data are told by
it, with no second scan and no join, whatever they contain.  A preamble must end within
a file's first block (``spark.sql.files.maxPartitionBytes``).

**Damaged rows** are kept: ``read_export`` parses every line with its raw text
beside it; ``sound_rows`` and ``quarantine`` divide the result.  A line is damaged if it has too
few or too many fields, one that is not of its type, or an odd number of quotes.  So a
quoted field with a line break is damaged in its first and its last line: a block of a
file can be read without what is before it only if lines are rows.  (A line between
these two that is a whole row by itself is taken for one.)

**Committed exports.**  ``commit`` stages the data in a folder of its own, counts and
checks what was written by reading it again, and writes the manifest last.
Readers follow manifests only, so a write that broke off, or has not ended, is
invisible, and so is an overwrite until it is complete.  A version is written once:
of two writers that commit the same version, the second fails and can commit again.
"""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.files import snake_case

RAW, FILE, BLOCK, LINE = "_raw", "_file", "_block", "_line"
MARKS = (RAW, FILE, BLOCK, LINE)


# --- lines by position ---------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str | list[str], skip: int = 0,
                   header: Sequence[str] | None = None) -> DataFrame:
    """(_raw, _file, _block, _line) of the lines after the first ``skip`` of
    every file; with ``header`` the next line must have these names, after
    ``snake_case``, and is left out too (another header ends the job: its rows would
    get into wrong columns).  Blank lines are left out, and counted."""
    names = None if header is None else list(header)
    drop = skip + (names is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = None, 0
        for batch in batches:
            raw, files, blocks = (c.to_pylist() for c in batch.columns)
            lines = []
            for text, file, block in zip(raw, files, blocks):
                if (file, block) != here:
                    here, n = (file, block), 0
                n += 1
                if names is not None and block == 0 and n == skip + 1:
                    found = [snake_case(x) for x in next(csv.reader([text]), [])]
                    if found != names:
                        raise ValueError(f"{file}: its header is {found}, not {names}")
                lines.append(n)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], names=list(MARKS))
            keep = [t.strip() != "" and (b > 0 or n > drop) for t, b, n in zip(raw, blocks, lines)]
            yield out.filter(pa.array(keep, pa.bool_()))

    lines = spark.read.text(path).select(
        F.col("value").alias(RAW), F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK))
    return lines.mapInArrow(run, f"{RAW} string, {FILE} string, {BLOCK} long, {LINE} long")


def read_export(spark: SparkSession, path: str | list[str], schema: str | StructType,
                skip: int = 0, check_header: bool = True, sep: str = ",") -> DataFrame:
    """All lines after the preamble and the header, parsed: the schema's columns
    (snake case) and the marks _raw, _file, _block, _line.  ``_raw`` is null for sound rows;
    the columns of damaged rows hold what could be parsed."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    schema = StructType([f.__class__(snake_case(f.name), f.dataType) for f in schema.fields])
    lines = numbered_lines(spark, path, skip if check_header else skip + 1,
                           schema.fieldNames() if check_header else None)
    bad = "_tidemark_bad"
    parsed = F.from_csv(F.col(RAW), f"{schema.toDDL()}, {bad} string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "sep": sep,
        "escape": '"'})
    rows = lines.select(parsed.alias("r"), *MARKS)
    odd = (F.length(RAW) - F.length(F.translate(RAW, '"', ""))) % 2
    return rows.select("r.*", *MARKS).withColumn(RAW, F.when(
        F.col(bad).isNotNull() | (odd == 1), F.col(RAW))).drop(bad)


def sound_rows(export: DataFrame) -> DataFrame:
    return export.filter(F.col(RAW).isNull()).drop(*MARKS)


def quarantine(export: DataFrame) -> DataFrame:
    """(raw, file, block, line) of the damaged lines: what to look at, and where."""
    return export.filter(F.col(RAW).isNotNull()).select(
        F.col(RAW).alias("raw"), F.col(FILE).alias("file"), F.col(BLOCK).alias("block"),
        F.col(LINE).alias("line"))


def csv_lines(df: DataFrame, sep: str = ",") -> DataFrame:
    """The rows as CSV text, in a column ``value``; a quote in a field is doubled."""
    return df.select(F.to_csv(F.struct(*[F.col(c) for c in df.columns]),
                               {"sep": sep, "escape": '"'}).alias("value"))


def write_with_preamble(lines: DataFrame, header: Sequence[str], path: str,
                        preamble: Sequence[str] = (), sep: str = ",") -> None:
    """Text lines to a folder; every file begins with the preamble and the header."""
    head = [*preamble, sep.join(header)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
                first = False
            yield batch

    lines.select("value").mapInArrow(run, "value string").write.text(path)


# --- committed exports -----------------------------------------------------------

def _checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and a checksum that does not depend on their order: the sum of the
    rows' hashes, so that equal rows do not cancel out."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(
        F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return row["n"], row["s"]


MANIFEST = "version long, data string, format string, schema string, n_rows long, checksum string"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The committed versions of an export, one row each."""
    # a manifest's file gets its name when its write is committed; Spark does not list _temporary
    reader = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true")
    try:
        return reader.json(f"{folder.rstrip('/')}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _data(spark: SparkSession, manifest: dict) -> DataFrame:
    reader = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"])))
    if manifest["format"] == "csv":
        reader = reader.option("header", "true")
    return reader.format(manifest["format"]).load(manifest["data"])


def commit(df: DataFrame, folder: str, format: str = "parquet", version: int | None = None) -> int:
    """Write ``df`` as the next version (or ``version``) of the export and
    return its number.  Fails, and leaves the earlier versions as they are, if the version
    is there already or if what was written does not read back as it was."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    if version is None:
        version = (manifests(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    data = f"{folder}/data/{uuid.uuid4().hex}"
    writer = df.write.option("header", "true") if format == "csv" else df.write
    writer.format(format).save(data)
    manifest = {"version": version, "data": data, "format": format, "schema": df.schema.json()}
    n_rows, checksum = _checksum(_data(spark, manifest))
    manifest |= {"n_rows": n_rows, "checksum": checksum}
    # the last step: a folder that exists already makes the write fail
    spark.createDataFrame([tuple(manifest[c.split()[0]] for c in MANIFEST.split(", "))], MANIFEST).coalesce(
        1).write.mode("errorifexists").json(f"{folder}/manifests/v={version:08d}")
    # two writers can pass that check together: both manifests are there, one counts
    if _newest(spark, folder, version)["data"] != data:
        raise FileExistsError(f"{folder}: another writer has committed version {version}")
    return version


def _newest(spark: SparkSession, folder: str, version: int | None) -> dict:
    found = manifests(spark, folder)
    if version is not None:
        found = found.filter(F.col("version") == version)
    row = found.orderBy(F.col("version").desc(), "data").limit(1).collect()
    if not row:
        raise FileNotFoundError(f"{folder}: no committed version" + (f" {version}" if version else ""))
    return row[0].asDict()


def read_committed(spark: SparkSession, folder: str, version: int | None = None,
                   verify: bool = True) -> DataFrame:
    """The newest (or the named) committed version.  ``verify`` reads the data
    once and compares rows and checksum with the manifest."""
    manifest = _newest(spark, folder, version)
    df = _data(spark, manifest)
    if verify and _checksum(df) != (manifest["n_rows"], manifest["checksum"]):
        raise ValueError(f"{folder}: version {manifest['version']} is not what its manifest says")
    return df
