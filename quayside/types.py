"""Logical column types, their Spark and SQL forms, and column definitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names of the logical types, in the order used for display.
BIT = "Bit"
INT = "Int"
BIG_INT = "BigInt"
DECIMAL = "Decimal"
FLOAT = "Float"
DATE_TIME = "DateTime2"
TEXT = "NVarChar"
LOGICAL_TYPES = (BIT, INT, BIG_INT, DECIMAL, FLOAT, DATE_TIME, TEXT)

# Text length limits.
DEFAULT_TEXT_LENGTH = 255
MAX_INLINE_TEXT_LENGTH = 4000

SPARK_TYPES: dict[str, T.DataType] = {
    BIT: T.BooleanType(),
    INT: T.IntegerType(),
    BIG_INT: T.LongType(),
    DECIMAL: T.DecimalType(38, 12),
    FLOAT: T.DoubleType(),
    DATE_TIME: T.TimestampNTZType(),
    TEXT: T.StringType(),
}

# SQL type names served, with the Spark type each one is read as.
SQL_TO_SPARK: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "smallint": T.ShortType(),
    "tinyint": T.ShortType(),
    "bit": T.BooleanType(),
    "decimal": T.DecimalType(38, 12),
    "numeric": T.DecimalType(38, 12),
    "money": T.DecimalType(19, 4),
    "smallmoney": T.DecimalType(10, 4),
    "float": T.DoubleType(),
    "real": T.FloatType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "datetime2": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(),
    "smalldatetime": T.TimestampNTZType(),
    "time": T.StringType(),
    "uniqueidentifier": T.StringType(),
    "char": T.StringType(),
    "nchar": T.StringType(),
    "varchar": T.StringType(),
    "nvarchar": T.StringType(),
    "text": T.StringType(),
    "ntext": T.StringType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
}

# SQL names per logical type; every other name is text.
_LOGICAL_SQL_NAMES = {
    BIT: ("bit",),
    INT: ("int",),
    BIG_INT: ("bigint",),
    DECIMAL: ("decimal", "numeric", "money", "smallmoney"),
    FLOAT: ("float", "real"),
    DATE_TIME: ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset"),
}

# Profile categories and the SQL names in each.
CATEGORY_BOOLEAN = "Boolean"
CATEGORY_NUMBER = "Number"
CATEGORY_DATE = "Date"
CATEGORY_TEXT = "Text"
CATEGORY_OTHER = "Other"
_CATEGORY_SQL_NAMES = {
    CATEGORY_BOOLEAN: ("bit",),
    CATEGORY_NUMBER: ("int", "bigint", "smallint", "tinyint", "decimal", "numeric", "float", "real",
                      "money", "smallmoney"),
    CATEGORY_DATE: ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "time"),
    CATEGORY_TEXT: ("char", "nchar", "varchar", "nvarchar", "text", "ntext"),
}


def _lookup(table: dict[str, tuple[str, ...]], name: str | None, default: str) -> str:
    wanted = (name or "").strip().lower()
    return next((key for key, names in table.items() if wanted in names), default)


def map_sql_type(name: str | None) -> str:
    """Logical type of a SQL type name."""
    return _lookup(_LOGICAL_SQL_NAMES, name, TEXT)


def type_category(name: str | None) -> str:
    """Profile category of a SQL type name."""
    return _lookup(_CATEGORY_SQL_NAMES, name, CATEGORY_OTHER)


def sql_name(data_type: T.DataType) -> str:
    """SQL type name a Spark type is published under."""
    if isinstance(data_type, T.BooleanType):
        return "bit"
    if isinstance(data_type, T.ByteType):
        return "tinyint"
    if isinstance(data_type, T.ShortType):
        return "smallint"
    if isinstance(data_type, T.IntegerType):
        return "int"
    if isinstance(data_type, T.LongType):
        return "bigint"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.FloatType):
        return "real"
    if isinstance(data_type, T.DoubleType):
        return "float"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.TimestampNTZType):
        return "datetime2"
    if isinstance(data_type, T.TimestampType):
        return "datetimeoffset"
    if isinstance(data_type, T.StringType):
        return "nvarchar"
    if isinstance(data_type, T.BinaryType):
        return "varbinary"
    return data_type.simpleString()


def logical_of(data_type: T.DataType) -> str:
    """Logical type of a Spark type, through its SQL name."""
    return map_sql_type(sql_name(data_type))


@dataclass(frozen=True)
class ColumnDef:
    """Name, logical type and (for text) maximum length of one imported column."""

    name: str
    logical: str
    length: int | None = None

    @property
    def sql_type(self) -> str:
        """SQL declaration: text is sized, and unbounded beyond the inline limit."""
        if self.logical == TEXT:
            length = self.length if self.length and self.length > 0 else DEFAULT_TEXT_LENGTH
            return f"NVARCHAR({'MAX' if length > MAX_INLINE_TEXT_LENGTH else length})"
        if self.logical == DECIMAL:
            return "DECIMAL(38, 12)"
        return self.logical.upper()

    def field(self) -> T.StructField:
        metadata = {"logical_type": self.logical}
        if self.logical == TEXT:
            metadata["max_length"] = self.length or DEFAULT_TEXT_LENGTH
        return T.StructField(self.name, SPARK_TYPES[self.logical], True, metadata)


def struct_of(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([column.field() for column in columns])


def columns_of(schema: T.StructType) -> list[ColumnDef]:
    """Column definitions of an existing table."""
    return [
        ColumnDef(f.name, logical_of(f.dataType),
                  f.metadata.get("max_length", DEFAULT_TEXT_LENGTH)
                  if logical_of(f.dataType) == TEXT else None)
        for f in schema.fields
    ]
