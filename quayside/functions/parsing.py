"""Text cells to typed values, as built-in column expressions.

The accepted grammar is fixed and does not depend on the host locale:

* booleans   ``true/false`` (any case), ``1/0`` and, for file imports, ``yes/no``;
* integers   optional sign and digits;
* numbers    sign, ``1,234.5``, ``.5``, ``5.``; file imports also take exponents, a trailing sign,
             accounting parentheses and the currency sign; chunk imports take a trailing sign only
             for decimals and an exponent only for floats;
* times      ``yyyy-M-d`` or ``yyyy/M/d`` or ``M/d/yyyy`` with an optional time of day, fraction and
             zone (``Z`` or an offset; converted to UTC), AM/PM after slashes, and month names.

A bare number is never a time, a value with a fraction is never an integer. Everything uses
``try_cast`` behind a shape test, so a bad cell costs no exception and never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside import types as L
from quayside.functions.times import utc_zoneless

# Characters removed around a cell.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0                　"

IMPORT = "import"
CHUNK = "chunk"

_DIGITS = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)"
_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
_PLAIN_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"

_INTEGER = r"^[+-]?[0-9]+$"
# Beyond this a number has no room in DECIMAL(38, 12).
_DECIMAL_LIMIT = 1e26

_CLOCK = r"(?:[T ]\s*[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:\.[0-9]{1,9})?)?)?"
_ZONE = r"(?:Z|[+-][0-9]{1,2}(?::?[0-9]{2})?)"
_YEAR_FIRST = rf"^[0-9]{{4}}(?:-[0-9]{{1,2}}-|/[0-9]{{1,2}}/)[0-9]{{1,2}}{_CLOCK}\s*{_ZONE}?$"
_YEAR_LAST = rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_CLOCK}\s*{_ZONE}?$"
_HALF_DAY = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})? ?[AaPp][Mm]$"
_MONTH = r"(?:[Jj]an|[Ff]eb|[Mm]ar|[Aa]pr|[Mm]ay|[Jj]un|[Jj]ul|[Aa]ug|[Ss]ep|[Oo]ct|[Nn]ov|[Dd]ec)[a-z]*"
_DAY_MONTH = rf"^[0-9]{{1,2}} {_MONTH},? [0-9]{{4}}{_CLOCK}$"
_MONTH_DAY = rf"^{_MONTH} [0-9]{{1,2}},? [0-9]{{4}}{_CLOCK}$"
# Every accepted time starts like one of these; no number or boolean does.
_TIME_SHAPE = rf"^(?:[0-9]{{4}}[-/][0-9]|[0-9]{{1,2}}/[0-9]|[0-9]{{1,2}} [A-Za-z]{{3}}|{_MONTH} [0-9])"
_ENDS_WITH_ZONE = r":[0-9.]+\s*[Z+-]|[0-9]\s*Z$"


def trimmed(cell: Column) -> Column:
    """Cell text without surrounding blanks; NULL when nothing is left."""
    return F.nullif(F.btrim(cell, F.lit(BLANKS)), F.lit(""))


def parse_bool(text: Column, grammar: str = IMPORT) -> Column:
    word = F.lower(text)
    yes = ["true", "1"] + (["yes"] if grammar == IMPORT else [])
    no = ["false", "0"] + (["no"] if grammar == IMPORT else [])
    return F.when(word.isin(*yes), F.lit(True)).when(word.isin(*no), F.lit(False))


def parse_integer(text: Column, spark_type: str = "int") -> Column:
    # The cast sees digits only: an exception per bad cell would cost far more than the test.
    value = F.when(text.rlike(_INTEGER), text.try_cast("bigint"))
    if spark_type == "bigint":
        return value
    return F.when(value.between(-(1 << 31), (1 << 31) - 1), value.cast("int"))


def number_text(text: Column, logical: str, grammar: str = IMPORT, currency: str = "¤") -> Column:
    """Rewrite an accepted number to plain ``[-]digits[.digits][e..]`` text, else NULL."""
    loose = grammar == IMPORT
    exponent = _EXPONENT if loose or logical == L.FLOAT else ""
    money = rf"(?:[{currency}]\s*)?" if loose else ""
    money_after = rf"(?:\s*[{currency}])?" if loose else ""
    signed = rf"^{money}([+-]?)\s*{money}({_DIGITS})({exponent}){money_after}$"
    rewritten = F.when(text.rlike(_PLAIN_NUMBER + exponent + "$"), text).when(
        text.rlike(signed), F.regexp_replace(text, signed, "$1$2$3"))
    if loose or logical == L.DECIMAL:
        trailing = rf"^{money}({_DIGITS})({exponent}){money_after}\s*([+-])$"
        rewritten = rewritten.when(text.rlike(trailing), F.regexp_replace(text, trailing, "$3$1$2"))
    if loose:
        bracketed = rf"^\(\s*{money}({_DIGITS})({exponent}){money_after}\s*\)$"
        rewritten = rewritten.when(text.rlike(bracketed), F.regexp_replace(text, bracketed, "-$1$2"))
    return F.replace(rewritten, F.lit(","), F.lit(""))


def decimal_of(number: Column) -> Column:
    """Decimal of the plain text ``number_text`` made; NULL beyond 26 integer digits."""
    return F.when(F.abs(number.try_cast("double")) <= F.lit(_DECIMAL_LIMIT), number.try_cast("decimal(38,12)"))


def float_of(number: Column, text: Column) -> Column:
    """Double of plain number text, or one of the special words of the cell."""
    word = F.lower(text)
    special = (
        F.when(word == "nan", F.lit(float("nan")))
        .when(word.isin("infinity", "+infinity"), F.lit(float("inf")))
        .when(word == "-infinity", F.lit(float("-inf")))
    )
    return F.coalesce(number.try_cast("double"), special)


def parse_decimal(text: Column, grammar: str = IMPORT, currency: str = "¤") -> Column:
    return decimal_of(number_text(text, L.DECIMAL, grammar, currency))


def parse_float(text: Column, grammar: str = IMPORT, currency: str = "¤") -> Column:
    return float_of(number_text(text, L.FLOAT, grammar, currency), text)


def _utc_clock(text: Column) -> Column:
    """ISO-like text to a zoneless UTC time, whatever the session zone is."""
    shifted = utc_zoneless(text.try_cast("timestamp"))
    return F.when(text.rlike(_ENDS_WITH_ZONE), shifted).otherwise(text.try_cast("timestamp_ntz"))


def parse_datetime(text: Column) -> Column:
    year_first = _utc_clock(F.regexp_replace(text, r"^([0-9]{4})/([0-9]{1,2})/", "$1-$2-"))
    year_last = _utc_clock(
        F.regexp_replace(text, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "$3-$1-$2"))
    half_day = F.try_to_timestamp(
        F.regexp_replace(F.upper(text), r" ?([AP]M)$", " $1"), F.lit("M/d/yyyy h:mm[:ss] a"))
    # Only the first three letters of a month name count; the day moves in front of it.
    spelled = F.initcap(F.regexp_replace(
        F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"([A-Za-z]{3})[a-z]*", "$1"),
        r"^([A-Za-z]{3}) ([0-9]{1,2})", "$2 $1"))
    named = F.try_to_timestamp(
        F.regexp_replace(spelled, r"[Tt]\s*(?=[0-9]{1,2}:)", " "), F.lit("d MMM yyyy[ H:m[:s]]"))
    return (
        F.when(text.rlike(_YEAR_FIRST), year_first)
        .when(text.rlike(_YEAR_LAST), year_last)
        .when(text.rlike(_HALF_DAY), half_day.cast("timestamp_ntz"))
        .when(text.rlike(_DAY_MONTH) | text.rlike(_MONTH_DAY), named.cast("timestamp_ntz"))
    )


def parse_text(text: Column, logical: str, grammar: str = IMPORT, currency: str = "¤") -> Column:
    """Typed value of trimmed text: NULL when the text is NULL or does not fit."""
    if logical == L.BIT:
        return parse_bool(text, grammar)
    if logical == L.INT:
        return parse_integer(text, "int")
    if logical == L.BIG_INT:
        return parse_integer(text, "bigint")
    if logical == L.DECIMAL:
        return parse_decimal(text, grammar, currency)
    if logical == L.FLOAT:
        return parse_float(text, grammar, currency)
    if logical == L.DATE_TIME:
        return parse_datetime(text)
    return text


# Bits of ``fit_mask``, one per inferred type.
FIT_BITS = {L.BIT: 1, L.DATE_TIME: 2, L.INT: 4, L.BIG_INT: 8, L.DECIMAL: 16, L.FLOAT: 32}


def fit_mask(text: Column, currency: str = "¤") -> Column:
    """All types a trimmed cell fits, as bits; NULL for a NULL cell.

    Same outcome as trying every parser, but a cell is sorted by its shape first: the shapes exclude
    each other, so a whole number costs one test and a time is never tried as a number.
    """
    def bit(value: Column, *logical: str) -> Column:
        return F.when(value, F.lit(sum(FIT_BITS[name] for name in logical))).otherwise(F.lit(0))

    whole = parse_integer(text, "bigint")
    number = text.try_cast("double")
    small = decimal_of(text).isNotNull()
    loose = number_text(text, L.DECIMAL, IMPORT, currency)
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(text.rlike(_INTEGER), bit(text.isin("0", "1"), L.BIT)
              .bitwiseOR(bit(F.coalesce(whole.between(-(1 << 31), (1 << 31) - 1), F.lit(False)), L.INT))
              .bitwiseOR(bit(whole.isNotNull(), L.BIG_INT)).bitwiseOR(bit(small, L.DECIMAL))
              .bitwiseOR(F.lit(FIT_BITS[L.FLOAT])))
        .when(text.rlike(_PLAIN_NUMBER + _EXPONENT + "$"), bit(small, L.DECIMAL).bitwiseOR(F.lit(FIT_BITS[L.FLOAT])))
        .when(text.rlike(_TIME_SHAPE), bit(parse_datetime(text).isNotNull(), L.DATE_TIME))
        .when(parse_bool(text).isNotNull(), F.lit(FIT_BITS[L.BIT]))
        .when(loose.isNotNull(), bit(decimal_of(loose).isNotNull(), L.DECIMAL).bitwiseOR(F.lit(FIT_BITS[L.FLOAT])))
        .otherwise(bit(float_of(loose, text).isNotNull(), L.FLOAT))
    )
