"""Scalar text functions of the portal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Icon names and the words that select them, first match wins.
ENERGY_ICONS = (
    ("wind_power", ("wind", "éolien", "eolien")),
    ("solar_power", ("solar", "solaire", "photovolta")),
    ("water_ec", ("hydro", "water", "hydroé", "hydroe")),
)
DEFAULT_ENERGY_ICON = "energy_savings_leaf"

# Section aliases (letters and digits, lower case) and the section each one means.
SECTION_ALIASES = {
    "donnees": "donnees",
    "eventlogs": "donnees_event_logs",
    "donneeseventlogs": "donnees_event_logs",
    "contexteenv": "donnees_contexte_environnemental",
    "contexteenvironmental": "donnees_contexte_environnemental",
    "donneescontexteenv": "donnees_contexte_environnemental",
    "donneescontexteenvironmental": "donnees_contexte_environnemental",
}
SECTIONS = ("donnees", "donnees_event_logs", "donnees_contexte_environnemental")

# Lengths and defaults.
MAX_FILE_NAME = 120
DEFAULT_FILE_NAME = "dataset-export"
EMPTY_LABEL = "dataset"
MAX_TABLE_NAME = 128
MAX_WARNING_TEXT = 200
MAX_INDEX_ERROR_TEXT = 1000
IDENTIFIER_PATTERN = r"^[A-Za-z0-9_-]+$"
INVALID_FILE_CHARS = r'[\x00-\x1f"<>|:*?\\/]'


def slug(label: Column, code: Column | None = None) -> Column:
    """Table label: blanks to dashes, other signs dropped; ``label-code`` when a code is given."""
    dashed = F.regexp_replace(F.btrim(F.coalesce(label, F.lit("")), F.lit(" \t\r\n\f\x0b")), r"\s+", "-")
    kept = F.regexp_replace(dashed, r"[^A-Za-z0-9-]", "")
    name = F.btrim(F.regexp_replace(kept, r"-{2,}", "-"), F.lit("-"))
    if code is None:
        return name
    return F.concat_ws("-", F.coalesce(F.nullif(name, F.lit("")), F.lit(EMPTY_LABEL)), code)


def suffix_number(code: Column) -> Column:
    """Value of the last two-digit group that no digit follows, else 0."""
    digits = F.regexp_extract(F.coalesce(code, F.lit("")), r"(\d{2})(?!.*\d)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))


def display_name(first: Column, last: Column) -> Column:
    return F.btrim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def energy_icon(text: Column) -> Column:
    lowered = F.lower(text)
    icon = F.lit(DEFAULT_ENERGY_ICON)
    for name, words in reversed(ENERGY_ICONS):
        hit = reduce(lambda a, b: a | b, [lowered.contains(word) for word in words])
        icon = F.when(hit, F.lit(name)).otherwise(icon)
    return icon


def csv_escape(text: Column) -> Column:
    """Quote a field that holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def safe_file_name(name: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), INVALID_FILE_CHARS, "_"))
    return F.coalesce(F.nullif(F.substring(cleaned, 1, MAX_FILE_NAME), F.lit("")), F.lit(DEFAULT_FILE_NAME))


def normalise_section(text: Column) -> Column:
    """Section schema an alias means; NULL for an unknown alias."""
    key = F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    table = F.create_map(*[F.lit(v) for pair in SECTION_ALIASES.items() for v in pair])
    return F.try_element_at(table, key)


def valid_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER_PATTERN), F.lit(False))


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def valid_domain(domain: Column) -> Column:
    """Has a dot, and neither starts nor ends with one (after trimming)."""
    cleaned = F.lower(F.btrim(domain))
    return cleaned.contains(".") & ~cleaned.startswith(".") & ~cleaned.endswith(".")


def truncate(text: Column, length: int = MAX_WARNING_TEXT) -> Column:
    return F.substring(text, 1, length)


def staged_name(base: str, label: str, job: str) -> str:
    """``base__label__job`` with the base cut so that the whole fits a table name."""
    suffix = f"__{label}__{job}"
    room = MAX_TABLE_NAME - len(suffix)
    if room <= 0:
        raise ValueError("the table name is too long")
    return base[:room] + suffix


def staged_name_column(base: Column, label: str, job: Column) -> Column:
    """The same over columns. No name if label and job leave no room."""
    room = F.lit(MAX_TABLE_NAME - len(label) - 4) - F.length(job)
    return F.when(room > 0, F.concat(F.substring(base, F.lit(1), room), F.lit(f"__{label}__"), job))
