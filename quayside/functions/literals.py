"""Driver-side values: page cursors and filter literals typed by their column."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import decimal
import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.errors import RequestError

# Sizes of the integer types, and the message per type.
_INTEGERS = {
    T.ByteType: (8, "Value must be an 8-bit integer."),
    T.ShortType: (16, "Value must be a 16-bit integer."),
    T.IntegerType: (32, "Value must be an integer."),
    T.LongType: (64, "Value must be a 64-bit integer."),
}
_NOT_BOOLEAN = "Value must be a boolean."
_NOT_DECIMAL = "Value must be a decimal number."
_NOT_FLOAT = "Value must be a floating-point number."
_NOT_TIME = "Value must be a valid date/time."
_NOT_GUID = "Value must be a valid GUID."


def _parse_time(text: str) -> dt.datetime:
    cleaned = text.strip()
    # Whole seconds with more than six fraction digits lose the digits below a microsecond.
    cleaned = re.sub(r"(\.\d{6})\d+", r"\1", cleaned)
    us = re.match(r"^(\d{1,2})/(\d{1,2})/(\d{4})(.*)$", cleaned)
    if us:
        cleaned = f"{us[3]}-{int(us[1]):02d}-{int(us[2]):02d}{us[4]}"
    iso = re.match(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(.*)$", cleaned)
    if not iso:
        raise ValueError(text)
    value = dt.datetime.fromisoformat(f"{iso[1]}-{int(iso[2]):02d}-{int(iso[3]):02d}{iso[4]}".strip())
    if value.tzinfo:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def parse_literal(text: str, data_type: T.DataType):
    """Python value of a filter text for a column of this type, or ``RequestError``."""
    raw = text.strip()
    for integer, (bits, message) in _INTEGERS.items():
        if isinstance(data_type, integer):
            if not re.fullmatch(r"[+-]?[0-9]+", raw) or not -(2 ** (bits - 1)) <= int(raw) < 2 ** (bits - 1):
                raise RequestError(message)
            return int(raw)
    if isinstance(data_type, T.BooleanType):
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        if text in ("0", "1"):
            return text == "1"
        raise RequestError(_NOT_BOOLEAN)
    if isinstance(data_type, T.DecimalType):
        match = re.fullmatch(r"([+-]?)([0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)([+-]?)", raw)
        if not match or (match[1] and match[3]):
            raise RequestError(_NOT_DECIMAL)
        return decimal.Decimal((match[1] or match[3]) + match[2].replace(",", ""))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        if not re.fullmatch(r"[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:nan|infinity)", raw):
            raise RequestError(_NOT_FLOAT)
        return float(raw.replace(",", ""))
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        try:
            value = _parse_time(raw)
        except ValueError:
            raise RequestError(_NOT_TIME) from None
        if isinstance(data_type, T.TimestampType):
            return value.replace(tzinfo=dt.timezone.utc)
        return value.date() if isinstance(data_type, T.DateType) else value
    return text


def parse_guid(text: str) -> str:
    try:
        return str(uuid.UUID(text.strip()))
    except ValueError:
        raise RequestError(_NOT_GUID) from None


def as_literal(value, data_type: T.DataType) -> Column:
    """A typed literal column; keeps the column's type so that comparisons reach the scan."""
    if isinstance(value, dt.datetime) and isinstance(data_type, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(data_type)
    if isinstance(value, dt.datetime) and isinstance(data_type, T.TimestampType):
        return F.lit(value.isoformat(sep=" ")).cast(data_type)
    return F.lit(value).cast(data_type)


def typed_literal(text: str, data_type: T.DataType) -> Column:
    return as_literal(parse_literal(text, data_type), data_type)


def cursor_encode(values: Sequence) -> str:
    """URL-safe text of the key values a page ended with."""
    def plain(value):
        if isinstance(value, dt.datetime):
            return (value if value.tzinfo is None else value.astimezone(dt.timezone.utc)).isoformat()
        if isinstance(value, dt.date):
            return value.isoformat()
        if isinstance(value, decimal.Decimal):
            return str(value)
        if isinstance(value, (bytes, bytearray)):
            return base64.b64encode(bytes(value)).decode()
        return value

    payload = json.dumps([plain(v) for v in values], separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=")


def cursor_decode(cursor: str, fields: Sequence[T.StructField]) -> list:
    """Typed key values of a cursor; NULL is accepted only for a nullable key."""
    try:
        padded = cursor + "=" * (-len(cursor) % 4)
        values = json.loads(base64.urlsafe_b64decode(padded).decode())
    except (binascii.Error, ValueError):
        raise RequestError("the cursor cannot be read") from None
    if not isinstance(values, list):
        raise RequestError("the cursor holds no list")
    if len(values) != len(fields):
        raise RequestError("the cursor does not have one value per key column")
    return [_cursor_value(value, field) for value, field in zip(values, fields)]


def _cursor_value(value, field: T.StructField):
    kind = field.dataType
    if value is None:
        if field.nullable:
            return None
        raise RequestError("the cursor holds NULL for a key that has none")
    if isinstance(kind, tuple(_INTEGERS)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise RequestError("a cursor value does not fit its column")
        return parse_literal(str(value), kind)
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise RequestError("a cursor value does not fit its column")
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RequestError("a cursor value does not fit its column")
        return float(value)
    if isinstance(kind, T.DecimalType):
        try:
            return decimal.Decimal(str(value))
        except decimal.InvalidOperation:
            raise RequestError("a cursor value does not fit its column") from None
    if isinstance(kind, T.BinaryType):
        try:
            return base64.b64decode(str(value), validate=True)
        except binascii.Error:
            raise RequestError("a cursor value does not fit its column") from None
    if not isinstance(value, str):
        raise RequestError("a cursor value does not fit its column")
    return parse_literal(value, kind)
