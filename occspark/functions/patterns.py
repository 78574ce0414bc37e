"""Predicates on text values (O-3.1 to O-3.12). ASCII digits only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, col, normalize_text, once, trimmed

# Words that mark a description instead of a time.
DESCRIPTIVE_WORDS = ("madrugada", "manha", "tarde", "noite", "durante", "periodo", "descr", "hora_incerta", "policia", "militar", "registrado", "nao_informado", "informado")
# The state's bounding box in degrees.
BOX = {"lat": (-25, -19), "lon": (-54, -44)}
#: A number after separators are cleaned (O-4.14).
PLAIN_NUMBER = "^-?[0-9]+([.][0-9]+)?$"


def is_null_pattern(c: ColumnLike) -> Column:
    """O-3.1: ``null`` once or more, in any case."""
    return col(c).rlike("(?i)^(null)+$")


def is_not_informed(c: ColumnLike) -> Column:
    """O-3.2: ``não informado``."""
    return F.lower(col(c)).rlike(r"^n[ãa]o\s+informado$")


def is_excel_overflow(c: ColumnLike) -> Column:
    """O-3.3: hashes alone."""
    return col(c).rlike("^#+$")


def is_zip_code(c: ColumnLike) -> Column:
    """O-3.4: ``12345-678``."""
    return col(c).rlike("^[0-9]{5}-[0-9]{3}$")


def is_dash_identifier(c: ColumnLike) -> Column:
    """O-3.5: digit groups joined by dashes."""
    return col(c).rlike("^[0-9]+(-[0-9]+)+$")


def is_valid_integer(c: ColumnLike) -> Column:
    """O-3.6: an optional minus and digits."""
    return col(c).rlike("^-?[0-9]+$")


def is_valid_numeric(c: ColumnLike) -> Column:
    """O-3.6: digits with at most one point, but not '', '-' or '.'."""
    return col(c).rlike(r"^-?[0-9]*\.?[0-9]*$") & ~col(c).isin("", "-", ".")


def matches_time_pattern(c: ColumnLike) -> Column:
    """O-3.7: ``H:MM``, ``H:MM:SS`` or ``H:MM:SS.f``; the parts aren't checked."""
    return col(c).rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$")


def is_descriptive_text(c: ColumnLike) -> Column:
    """O-3.10: holds one of the words, or has no ``:`` and letters and blanks make over half of its bytes."""
    letters = F.length(F.regexp_replace(col(c), r"[^\p{L}\s]", ""))
    return once(normalize_text(F.trim(col(c))), lambda text: text.rlike("|".join(DESCRIPTIVE_WORDS)) | (~F.contains(text, F.lit(":")) & (letters > F.floor(F.octet_length(col(c)) / 2))))


def is_in_state_bbox(lat: ColumnLike, lon: ColumnLike) -> Column:
    """O-3.11: both known and inside the box, edges included."""
    return F.coalesce(col(lat).between(*BOX["lat"]) & col(lon).between(*BOX["lon"]), F.lit(False))


def is_processable_row(num: str, year: str, lat: str, lon: str) -> Column:
    """O-3.12: a report number, and a year and coordinates that read as numbers."""
    from .values import parse_source_number

    return F.coalesce(F.trim(col(num)) != "", F.lit(False)) & parse_source_number(year).isNotNull() & parse_source_number(lat).isNotNull() & parse_source_number(lon).isNotNull()


def is_blank(c: ColumnLike) -> Column:
    """White space alone."""
    return trimmed(c) == ""
