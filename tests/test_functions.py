"""Scalar functions, parsing grammar, literals and cursors."""

from __future__ import annotations

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside import types as L
from quayside.errors import InputError, RequestError
from quayside.functions import literals, parsing, sizes, text
from quayside.functions.render import render_all
from quayside.operators.headers import check_headers_positional, check_headers_unique
from quayside.operators.infer import apply_overrides, index_column_candidates


def column(spark, values, expression, kind="string"):
    """Values of an expression over ``x``, in input order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]


def trimmed():
    return parsing.trimmed(F.col("x"))


@pytest.mark.parametrize("cell, wanted", [
    ("true", True), ("FALSE", False), (" 1 ", True), ("0", False), ("Yes", True), ("nO", False),
    ("t", None), ("y", None), ("2", None), ("", None), ("  ", None), (" true ", True)])
def test_bool(spark, cell, wanted):
    assert column(spark, [cell], parsing.parse_bool(trimmed())) == [wanted]


def test_chunk_bool_refuses_words(spark):
    assert column(spark, ["yes", "no", "True", "0"], parsing.parse_bool(trimmed(), parsing.CHUNK)) == [None, None, True, False]


def test_integers(spark):
    cells = ["12", "+5", "-7", "1.0", "1e3", "2147483648", "1_0", "0x1", "--1", "9223372036854775808"]
    assert column(spark, cells, parsing.parse_integer(trimmed(), "int")) == [12, 5, -7] + [None] * 7
    assert column(spark, cells, parsing.parse_integer(trimmed(), "bigint")) == [12, 5, -7, None, None, 2147483648] + [None] * 4


def test_numbers(spark):
    cells = ["12", "1,234.5", "(5)", "1e3", " 7 ", "5-", "¤5", "-¤5", "(1,000.5)", ".5", "5.", "(-5)", "$5", "--5", "1d",
             "1,2.3,4"]
    wanted = [12, 1234.5, -5, 1000, 7, -5, 5, -5, -1000.5, .5, 5, None, None, None, None, None]
    assert column(spark, cells, parsing.parse_float(trimmed())) == wanted
    exact = column(spark, cells, parsing.parse_decimal(trimmed()))
    assert [None if v is None else float(v) for v in exact] == wanted


def test_number_special_values(spark):
    found = column(spark, ["NaN", "-Infinity", "1e400", "1e40"], parsing.parse_float(trimmed()))
    assert found[0] != found[0] and found[1:] == [float("-inf"), float("inf"), 1e40]
    assert column(spark, ["1e40", "99999999999999999999999999"], parsing.parse_decimal(trimmed())) == [
        None, decimal.Decimal("99999999999999999999999999.000000000000")]


def test_times(spark):
    cells = {
        "2024-01-05": dt.datetime(2024, 1, 5), "2024/1/5 3:04": dt.datetime(2024, 1, 5, 3, 4),
        "2024-01-05T03:04:05.1234567+02:00": dt.datetime(2024, 1, 5, 1, 4, 5, 123456),
        "1/31/2024": dt.datetime(2024, 1, 31), "1/31/2024 1:05 pm": dt.datetime(2024, 1, 31, 13, 5),
        "January 5, 2024 10:11:12": dt.datetime(2024, 1, 5, 10, 11, 12), "5 Jan 2024": dt.datetime(2024, 1, 5),
        "2024-01-05 03:04:05Z": dt.datetime(2024, 1, 5, 3, 4, 5),
        "2024": None, "2024-13-01": None, "2024-02-30": None, "12:30": None, "1.5": None, "abc": None}
    assert column(spark, list(cells), parsing.parse_datetime(trimmed())) == list(cells.values())


def test_slug(spark):
    labels = ["  Wind  farm  (A) ", "--x--", "é", None, "a-b"]
    assert column(spark, labels, text.slug(F.col("x"), F.lit("2024010101"))) == [
        "Wind-farm-A-2024010101", "x-2024010101", "dataset-2024010101", "dataset-2024010101", "a-b-2024010101"]


def test_suffix_number(spark):
    assert column(spark, ["2024010107", "A12-B", "1", None, "12a34b", "123"], text.suffix_number(F.col("x"))) == [
        7, 12, 0, 0, 34, 23]


def test_sizes(spark):
    texts = ["12.5 GB", " 10  mb ", "1 B", "x MB", "5", "5 PB", None, "1 2 MB", "1e2 KB"]
    assert column(spark, texts, sizes.parse_size_mb(F.col("x"))) == [
        12800.0, 10.0, 1 / 1048576, None, None, None, None, None, 100 / 1024]
    assert column(spark, texts, sizes.parse_size_bytes(F.col("x")))[:3] == [13421772800, 10485760, 1]
    assert column(spark, [0, 1023, 1280, 1048576, 5 * 1024 ** 3, 3 * 1024 ** 4], sizes.format_size(F.col("x")), "bigint") == [
        "0 B", "1023 B", "1.3 KB", "1.0 MB", "5.0 GB", "3072.0 GB"]


def test_names(spark):
    assert column(spark, ["a<b>:c", " ", "x" * 200], text.safe_file_name(F.col("x"))) == ["a_b__c", "dataset-export", "x" * 120]
    assert column(spark, ["Event-Logs", "donnees ", "other"], text.normalise_section(F.col("x"))) == [
        "donnees_event_logs", "donnees", None]
    assert column(spark, ["a-b_1", "a b", ""], text.valid_identifier(F.col("x"))) == [True, False, False]
    assert column(spark, ["a@b@c.org"], text.email_domain(F.col("x"))) == ["c.org"]
    assert text.staged_name("t" * 200, "old", "f" * 32) == "t" * (128 - 39) + "__old__" + "f" * 32
    assert column(spark, ['a"b', "a,b", "plain", "a\rb"], text.csv_escape(F.col("x"))) == ['"a""b"', '"a,b"', "plain", '"a\rb"']


def test_render(spark):
    rows = spark.createDataFrame([(
        1.0, 1e16, 1.5e-7, 12345678.25, 0.00012, float("nan"), True, decimal.Decimal("1.5"), bytearray(b"ab"), None,
        dt.date(2024, 1, 2))],
        "a double, b double, c double, d double, e double, f double, g boolean, h decimal(10,4), i binary, j string, k date")
    found = render_all(rows.withColumn("l", F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"))).head()
    assert list(found) == ["1", "1E+16", "1.5E-07", "12345678.25", "0.00012", "NaN", "true", "1.5000", "YWI=", "",
                           "2024-01-02", "2024-01-02T03:04:05.5000000Z"]


@pytest.mark.parametrize("raw, kind, wanted", [
    ("12", T.IntegerType(), 12), ("9" * 12, T.LongType(), 999999999999), ("TRUE", T.BooleanType(), True), ("0", T.BooleanType(), False),
    ("1,234.5", T.DecimalType(38, 12), decimal.Decimal("1234.5")), ("1e3", T.DoubleType(), 1000.0),
    ("2024-01-05T00:00:00Z", T.TimestampNTZType(), dt.datetime(2024, 1, 5)),
    ("1/5/2024", T.DateType(), dt.date(2024, 1, 5)), ("text", T.StringType(), "text")])
def test_literals(raw, kind, wanted):
    assert literals.parse_literal(raw, kind) == wanted


@pytest.mark.parametrize("raw, kind", [
    ("x", T.IntegerType()), ("2147483648", T.IntegerType()), ("40000", T.ShortType()), ("yes", T.BooleanType()), ("1e3", T.DecimalType(38, 12)),
    ("abc", T.DoubleType()), ("2024", T.TimestampNTZType())])
def test_bad_literals(raw, kind):
    with pytest.raises(RequestError):
        literals.parse_literal(raw, kind)


def test_cursor_round_trip():
    fields = [T.StructField("a", T.LongType(), False), T.StructField("b", T.TimestampNTZType()), T.StructField("c", T.StringType()),
              T.StructField("d", T.DecimalType(10, 2)), T.StructField("e", T.DoubleType())]
    values = [1 << 60, dt.datetime(2024, 1, 2, 3, 4, 5, 6), None, decimal.Decimal("1.50"), 0.1]
    assert literals.cursor_decode(literals.cursor_encode(values), fields) == values
    with pytest.raises(RequestError):
        literals.cursor_decode(literals.cursor_encode([None, None, None, None, None]), fields)
    with pytest.raises(RequestError):
        literals.cursor_decode(literals.cursor_encode([1]), fields)
    with pytest.raises(RequestError):
        literals.cursor_decode("!!", fields)


def test_type_names():
    assert [L.map_sql_type(n) for n in ("money", "real", "date", "tinyint", "xml", None)] == [
        L.DECIMAL, L.FLOAT, L.DATE_TIME, L.TEXT, L.TEXT, L.TEXT]
    assert [L.type_category(n) for n in ("BIT ", "smallmoney", "time", "ntext", "binary")] == [
        "Boolean", "Number", "Date", "Text", "Other"]
    assert len(L.SQL_TO_SPARK) == 26
    assert [L.ColumnDef("a", L.TEXT, n).sql_type for n in (None, 300, 4001)] == ["NVARCHAR(255)", "NVARCHAR(300)", "NVARCHAR(MAX)"]


def test_headers():
    check_headers_positional(["A", "b"], ["a", "B"])
    with pytest.raises(InputError):
        check_headers_positional(["a", "b"], ["b", "a"])
    with pytest.raises(InputError):
        check_headers_unique(["A", "a"])


def test_overrides_and_candidates():
    inferred = [L.ColumnDef("a", L.INT), L.ColumnDef("b", L.TEXT, 300), L.ColumnDef("t", L.DATE_TIME)]
    chosen = apply_overrides(inferred, {"a": "nonsense", "t": L.DATE_TIME}, {"b": 900})
    assert [(c.logical, c.length) for c in chosen] == [(L.TEXT, 255), (L.TEXT, 900), (L.DATE_TIME, None)]
    assert index_column_candidates(inferred) == {"time": ["t"], "id": ["a"], "include": ["a", "t"]}


def test_fit_mask_agrees_with_every_parser(spark):
    cells = ["0", "1", "12", "+5", "2147483648", "9223372036854775808", "9" * 26, "9" * 27, "1.5", ".5", "5.", "1e3", "1e40", "-1e-3", "1d",
             "true", "No", "yes", "y", "1,234.5", "(5)", "5-", "¤5", "--5", "NaN", "-Infinity", "inf", "2024", "2024-01-05", "2024/1/5",
             "2024-13-01", "1/31/2024", "31/1/2024", "1/31/2024 1:05 pm", "5 Jan 2024", "January 5, 2024 10:11", "Mayor 5", "12 days",
             "2024-01-05T03:04:05+02:00", "12:30", "abc", "", " ", None, " 7 ", "1-2-3", "1/2"]
    x = trimmed()
    parsers = {L.BIT: parsing.parse_bool(x), L.DATE_TIME: parsing.parse_datetime(x), L.INT: parsing.parse_integer(x, "int"),
               L.BIG_INT: parsing.parse_integer(x, "bigint"), L.DECIMAL: parsing.parse_decimal(x), L.FLOAT: parsing.parse_float(x)}
    tried = {name: column(spark, cells, parser.isNotNull()) for name, parser in parsers.items()}
    for i, mask in enumerate(column(spark, cells, parsing.fit_mask(x))):
        fits = {name for name in parsers if tried[name][i]}
        assert fits == {n for n, b in parsing.FIT_BITS.items() if (mask or 0) & b}, cells[i]
