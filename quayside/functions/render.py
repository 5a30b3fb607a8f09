"""Values as export text: one rule per type, independent of locale and session zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.times import utc_zoneless


def _without_point_zero(text: Column) -> Column:
    return F.when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)


def _float_text(value: Column, single: bool) -> Column:
    """Shortest text without a trailing ``.0``; exponent form outside 1e-5 .. 1e15 (1e7 if single)."""
    text = value.cast("string")
    size = F.abs(value)
    upper = F.lit(1e7 if single else 1e15)
    inside = (size < upper) & (size >= F.lit(1e-5))
    plain = _without_point_zero(text)
    # The engine switches to an exponent earlier; expand it exactly through a wide decimal.
    expanded = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    mantissa = _without_point_zero(F.substring_index(text, "E", 1))
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    signed = F.concat(
        mantissa, F.lit("E"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")),
    )
    return F.when(~text.contains("E"), plain).when(inside, expanded).otherwise(signed)


def render_value(value: Column, data_type: T.DataType) -> Column:
    """Export text of a value; NULL becomes the empty text."""
    if isinstance(data_type, T.BooleanType):
        text = F.when(value, F.lit("true")).when(~value, F.lit("false"))
    elif isinstance(data_type, T.TimestampNTZType):
        text = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    elif isinstance(data_type, T.TimestampType):
        text = F.concat(F.date_format(utc_zoneless(value), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    elif isinstance(data_type, T.DateType):
        text = F.date_format(value, "yyyy-MM-dd")
    elif isinstance(data_type, T.BinaryType):
        text = F.base64(value)
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        text = _float_text(value, isinstance(data_type, T.FloatType))
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def render_all(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as export text, except the ones to keep as they are."""
    return df.select(*[
        F.col(f"`{f.name}`") if f.name in keep
        else render_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
        for f in df.schema.fields
    ])
