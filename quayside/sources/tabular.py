"""Tabular input files: CSV, zipped CSV and Parquet.

Every reader returns the data columns (text for CSV, native for Parquet) plus where each row came
from: ``_file`` (name), ``_file_seq`` (place of the file in the list) and ``_row_no`` (1-based row
in its file, header not counted).

CSV is parsed exactly once. The rows, the header line included, are staged as Parquet with the split
they were read in; header checks, row numbers, inference, conversion and reports then read the
columnar copy.
"""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.errors import InputError
from quayside.functions.parsing import BLANKS
from quayside.functions.render import render_value
from quayside.operators.headers import check_headers_positional, check_headers_unique, trim_headers
from quayside.session import ship_package
from quayside.sources.footers import many_at_once, parquet_schemas
from quayside.storage import materialise

FILE = "_file"
FILE_SEQ = "_file_seq"
ROW_NO = "_row_no"
LOCATION = (FILE, FILE_SEQ, ROW_NO)

# Accepted endings, the longest one first, and their labels.
FORMATS = ((".csv.zip", "CSV.zip"), (".csv", "CSV"), (".parquet", "Parquet"))

_ZIP_BATCH_ROWS = 5_000
_FIRST_LINES = 64
# Entries a ZIP directory without the 64-bit extension can hold.
_MAX_ENTRIES = 65_536
_BYTE_ORDER_MARK = "\ufeff"


def detect_format(paths: Sequence[str]) -> str:
    """Common ending of all paths."""
    if not paths:
        raise InputError("no input files were given")
    endings = set()
    for path in paths:
        lowered = path.rstrip("/").lower()
        ending = next((e for e, _ in FORMATS if lowered.endswith(e)), None)
        if ending is None:
            raise InputError("only CSV, Parquet or CSV.zip files are supported")
        endings.add(ending)
    if len(endings) > 1:
        raise InputError("all imported files must be of the same type")
    return endings.pop()


def read_tabular(spark: SparkSession, paths: Sequence[str], multiline: bool | None = None) -> DataFrame:
    """Read files of one type into one DataFrame; headers must agree by position."""
    paths = list(paths)
    ending = detect_format(paths)
    if ending == ".csv":
        return read_csv(spark, paths, multiline)
    if ending == ".csv.zip":
        return read_zipped_csv(spark, paths)
    return read_parquet(spark, paths)


def head_rows(spark: SparkSession, paths: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows over all files, as text, for a preview or for inference from a sample.

    Reads only as far as needed, whatever the size of the files: the rows (at most ``n``) are fetched
    file by file from the first tasks, and nothing is staged. Header and length checks cover what is
    read.
    """
    paths = list(paths)
    ending = detect_format(paths)
    header: list[str] | None = None
    found: list[tuple] = []
    for path in paths:
        if ending == ".parquet":
            rows = read_parquet(spark, [path]).drop(*LOCATION)
            names, rows = rows.columns, as_text(rows, rows.columns).head(n - len(found))
        elif ending == ".csv":
            names = trim_headers(_csv_header(spark, path))
            cells = [f"c{i}" for i in range(len(names))]
            raw = _csv_rows(spark, path, cells, True).head(n - len(found) + 1)[1:]
            if any(r["_bad"] is not None for r in raw):
                raise InputError("a row in the CSV file does not match the number of header columns")
            rows = [r[:-1] for r in raw]
        else:
            lines = _archive_lines(spark, [path])
            first = lines.filter("line_no = 0").head()
            names = trim_headers(first["fields"] if first else [])
            rows = [r["fields"] for r in lines.filter("line_no > 0").select("fields").head(n - len(found))]
            if any(len(r) != len(names) for r in rows):
                raise InputError("a row in the CSV file does not match the number of header columns")
        if header is None:
            check_headers_unique(names)
            header = names
        check_headers_positional(header, names, dict(FORMATS)[ending])
        found += [tuple(r) for r in rows]
        if len(found) >= n:
            break
    return spark.createDataFrame(found, T.StructType([T.StructField(h, T.StringType()) for h in header]))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LOCATION]


def _base_name(path: str) -> str:
    return os.path.basename(unquote(path.rstrip("/")))


def _blank(cell: Column) -> Column:
    return cell.isNull() | (F.btrim(cell, F.lit(BLANKS)) == "")


def _normal_header(cell: Column) -> Column:
    text = F.ltrim(F.coalesce(cell, F.lit("")), F.lit(_BYTE_ORDER_MARK))
    return F.lower(F.btrim(text, F.lit(BLANKS)))


# ---------------------------------------------------------------------------------------------- CSV

def _csv_header(spark: SparkSession, path: str) -> list[str]:
    """First non-blank row of a file. A cell may hold any number of lines, empty ones too: more lines are fetched
    until the row is closed."""
    # Only the line feed ends a line here, so that the row keeps its own line ends.
    lines = spark.read.option("lineSep", "\n").text(path)
    wanted = _FIRST_LINES
    while True:
        got = [r["value"] for r in lines.head(wanted)]
        text = "\n".join(got).lstrip(_BYTE_ORDER_MARK)
        try:
            for row in csv.reader(io.StringIO(text, newline=""), strict=len(got) == wanted):
                if any(cell.strip(BLANKS) for cell in row):
                    return row
        except csv.Error:
            pass   # the row goes on after the lines at hand
        if len(got) < wanted:
            raise InputError(f"{_base_name(path)} is empty")
        wanted *= 8


def _breaks_lines(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether a quoted field holds a line break: then some line has an odd number of quotes."""
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(list(paths)).where(odd).isEmpty()


def _rounds(paths: Sequence[str]) -> list[list[tuple[int, str]]]:
    """Numbered paths, each at most once in a round: a path that is listed again is read again."""
    rounds: list[list[tuple[int, str]]] = []
    seen: dict[str, int] = {}
    for seq, path in enumerate(paths):
        place = seen[path] = seen.get(path, -1) + 1
        if place == len(rounds):
            rounds.append([])
        rounds[place].append((seq, path))
    return rounds


def _places(spark: SparkSession, numbered: Sequence[tuple[int, str]]) -> DataFrame:
    """``(_place, _file_seq)``: the URI of each given file or folder and its number in the list."""
    as_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def uris(path: str) -> list[str]:
        target = as_path(path)
        found = target.getFileSystem(conf).globStatus(target)
        if not found:
            raise InputError(f"{_base_name(path)} does not exist")
        return [x.getPath().toUri().toString() for x in found]

    rows = [(uri, seq) for (seq, _), found in zip(numbered, many_at_once(uris, [p for _, p in numbered])) for uri in found]
    return spark.createDataFrame(rows, f"_place string, {FILE_SEQ} int").select(_plain_uri("_place").alias("_place"), FILE_SEQ)


def _plain_uri(column: str) -> Column:
    """``file:/x`` and ``file:///x`` are one place."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def _with_seq(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Number of the listed file, or of the listed folder, that each row's ``_path`` belongs to."""
    spots = rows.select("_path").distinct()
    uri = _plain_uri("_path")
    either = F.explode(F.array(uri, F.regexp_replace(uri, "/[^/]*$", "")))
    numbered = spots.select("_path", either.alias("_place")).join(places, "_place").groupBy("_path").agg(F.min(FILE_SEQ).alias(FILE_SEQ))
    return rows.join(numbered, "_path", "left")


def _csv_rows(spark: SparkSession, path: str | Sequence[str], cells: list[str], multiline: bool) -> DataFrame:
    """All rows of a file, header included, as text; ``_bad`` is set for a row of another length."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_bad"]])
    rows = spark.read.options(
        sep=",", quote='"', escape='"', multiLine=multiline, header=False, mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="",
        maxCharsPerColumn=-1, columnNameOfCorruptRecord="_bad").schema(schema).csv(path)
    # A line of blanks only is no row; for several columns it arrives as a short row.
    if len(cells) > 1:
        return rows.filter(F.col("_bad").isNull() | ~_blank(F.col("_bad")))
    return rows.filter(~_blank(F.col("c0")))


def read_csv(spark: SparkSession, paths: Sequence[str], multiline: bool | None = None) -> DataFrame:
    """Comma-separated text with quoted fields; every value stays text and is not trimmed.

    All files are one read, and Spark splits large ones between tasks. Only files in which a quoted field holds a
    line break cannot be split; ``multiline=None`` looks for such a field first (one pass over the text).
    """
    paths = list(paths)
    header = trim_headers(_csv_header(spark, paths[0]))
    check_headers_unique(header)
    cells = [f"c{i}" for i in range(len(header))]
    if multiline is None:
        multiline = _breaks_lines(spark, paths)
    rounds = _rounds(paths)
    raw = reduce(DataFrame.unionByName, [
        _csv_rows(spark, [x for _, x in own], cells, multiline).select(
            *cells, "_bad", F.lit(i).alias("_round"), F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block")) for i, own in enumerate(rounds)])
    staged = materialise(raw.withColumn("_mono", F.monotonically_increasing_id()), "csv-rows")

    split = ["_round", "_path", "_block"]
    splits = staged.groupBy(*split).agg(
        F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("n"),
        F.count("_bad").alias("ragged"),
        F.min_by(F.array(*[_normal_header(F.col(c)) for c in cells]), F.col("_mono")).alias("head"))
    in_order = Window.partitionBy("_round", "_path").orderBy("_block")
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = splits.withColumn("_before", before).withColumn("_nth", F.row_number().over(in_order))
    # One small row per input split, written once: Spark knows its size and joins it accordingly.
    located = materialise(reduce(DataFrame.unionByName, [
        _with_seq(located.where(F.col("_round") == i), _places(spark, own)) for i, own in enumerate(rounds)]), "csv-splits")

    wanted = F.array(*[F.lit(h.lower()) for h in header])
    verdict = located.agg(
        F.sum("ragged").alias("ragged"), F.count(F.when(F.col(FILE_SEQ).isNull(), 1)).alias("unlisted"),
        F.sum(F.when((F.col("_nth") == 1) & (F.col("head") != wanted), 1).otherwise(0)).alias("other")).head()
    if verdict["other"]:
        raise InputError("the CSV files must share the same columns")
    if verdict["ragged"]:
        raise InputError("a row in the CSV file does not match the number of header columns")
    if verdict["unlisted"]:
        raise InputError("files below sub-folders of a listed folder cannot be numbered")

    bounds = located.select(*split, "_first", "_before", FILE_SEQ)
    row_no = F.col("_mono") - F.col("_first") + F.col("_before")
    return staged.join(bounds, split).withColumn(ROW_NO, row_no).filter(F.col(ROW_NO) > 0).select(
        *[F.col(c).alias(h) for c, h in zip(cells, header)], _file_name("_path").alias(FILE), FILE_SEQ, ROW_NO)


def _file_name(path: str) -> Column:
    """Last part of a file URI, decoded."""
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


# ------------------------------------------------------------------------------------------- CSV.zip

def _archive_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unpack archives: one output row per CSV line, headers included (line number 0)."""
    for batch in batches:
        for seq, path, content in zip(batch[FILE_SEQ], batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist()
                         if not n.endswith("/") and n.lower().endswith(".csv")]
                if not names:
                    raise InputError("every CSV.zip file must contain at least one CSV file")
                for entry_no, name in enumerate(names):
                    with archive.open(name) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
                        yield from _entry_batches((seq, path, name, entry_no), csv.reader(text))


def _entry_batches(place: tuple, rows) -> Iterator[pd.DataFrame]:
    names = [FILE_SEQ, "path", "entry", "entry_no", "line_no", "fields"]
    pending, line_no = [], 0
    for fields in rows:
        if not fields or (len(fields) == 1 and not fields[0].strip()):
            continue
        pending.append((*place, line_no, fields))
        line_no += 1
        if len(pending) == _ZIP_BATCH_ROWS:
            yield pd.DataFrame(pending, columns=names)
            pending = []
    if pending:
        yield pd.DataFrame(pending, columns=names)


def _archive_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    content = reduce(DataFrame.unionByName, [
        _with_seq(spark.read.format("binaryFile").load([x for _, x in own]).select("path", "content", F.col("path").alias("_path")),
                  _places(spark, own)).select(FILE_SEQ, "path", "content") for own in _rounds(paths)])
    ship_package(spark)
    return content.mapInPandas(
        _archive_rows, f"{FILE_SEQ} int, path string, entry string, entry_no int, line_no long, fields array<string>")


def read_zipped_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every CSV entry of every archive, in parallel over the archives.

    The ZIP format has no Spark reader, so a small Python helper turns each archive into rows.
    """
    paths = list(paths)
    staged = materialise(_archive_lines(spark, paths), "zip-rows")
    first = staged.filter("line_no = 0").orderBy(FILE_SEQ, "path", "entry_no").select("fields").head()
    if first is None:
        raise InputError("the CSV.zip files are empty")
    header = trim_headers(first["fields"])
    check_headers_unique(header)
    names = F.transform("fields", _normal_header)
    wanted = F.array(*[F.lit(h.lower()) for h in header])
    verdict = staged.agg(
        F.count(F.when((F.col("line_no") == 0) & (names != wanted), 1)).alias("other"),
        F.count(F.when((F.col("line_no") > 0) & (F.size("fields") != len(header)), 1)).alias("ragged")).head()
    if verdict["other"]:
        raise InputError("the CSV.zip files must share the same columns")
    if verdict["ragged"]:
        raise InputError("a row in the CSV file does not match the number of header columns")
    return staged.filter("line_no > 0").select(
        *[F.col("fields")[i].alias(h) for i, h in enumerate(header)],
        F.concat_ws("/", _file_name("path"), "entry").alias(FILE),
        # Entries follow each other as they do in their archive, whatever their names.
        (F.col(FILE_SEQ) * _MAX_ENTRIES + F.col("entry_no")).alias(FILE_SEQ), F.col("line_no").alias(ROW_NO))


# ------------------------------------------------------------------------------------------- Parquet

def leaf_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """``(path, name)`` of every leaf field; lists and maps have no single cell and are refused."""
    leaves: list[tuple[str, str]] = []
    for field in schema.fields:
        path = f"{prefix}`{field.name}`"
        if isinstance(field.dataType, T.StructType):
            leaves += leaf_columns(field.dataType, path + ".")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            raise InputError(f"column {field.name} holds lists or maps")
        else:
            leaves.append((path, field.name.strip()))
    return leaves


def read_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Leaf fields with trimmed names. Row numbers come from the Parquet reader, without a shuffle."""
    paths = list(paths)
    schemas = parquet_schemas(spark, paths)
    header = [name for _, name in leaf_columns(schemas[0])]
    check_headers_unique(header)
    distinct = list({id(x): x for x in schemas}.values())
    for schema in distinct[1:]:
        check_headers_positional(header, [name for _, name in leaf_columns(schema)], "Parquet")
    types = [[f.dataType for f in schema.fields] for schema in distinct]
    mixed = any(other != types[0] for other in types)
    # Files of one schema are one read, however many they are.
    alike: dict[tuple[str, int], list[int]] = {}
    texts: dict[int, str] = {}   # of each distinct schema object, once
    for i, own in enumerate(_rounds(paths)):
        for seq, _ in own:
            own_text = texts.get(id(schemas[seq])) or texts.setdefault(id(schemas[seq]), schemas[seq].json())
            alike.setdefault((own_text, i), []).append(seq)
    parts = []
    for seqs in alike.values():
        schema = schemas[seqs[0]]
        cells = [F.col(leaf).alias(name) for (leaf, _), name in zip(leaf_columns(schema), header)]
        rows = spark.read.schema(schema).parquet(*[paths[i] for i in seqs])
        place = [_file_name("_metadata.file_path").alias(FILE), (F.col("_metadata.row_index") + 1).alias(ROW_NO)]
        if len(seqs) == 1:
            part = rows.select(*cells, *place, F.lit(seqs[0]).alias(FILE_SEQ))
        else:
            part = _with_seq(rows.select(*cells, *place, F.col("_metadata.file_path").alias("_path")),
                             _places(spark, [(i, paths[i]) for i in seqs]))
        part = part.select(*[f"`{c}`" for c in header], FILE, FILE_SEQ, ROW_NO)
        parts.append(as_text(part, header) if mixed else part)
    return reduce(DataFrame.unionByName, parts)


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Native columns as the text a file would hold; text columns stay as they are."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        F.col(f"`{c}`") if c not in columns or isinstance(kinds[c], T.StringType)
        else F.nullif(render_value(F.col(f"`{c}`"), kinds[c]), F.lit("")).alias(c)
        for c in df.columns
    ])
