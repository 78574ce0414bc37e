"""Text normalisation (O-2.1, O-2.2, O-4.18, O-4.19, O-4.24, O-4.25)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

#: What counts as white space at the ends of a value: that of ASCII, no-break and typographic spaces, line separators, the byte order mark.
WHITE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Texts that begin and end with visible ASCII or a Latin letter, for SQL.
_PLAIN_ENDS = r"(?s)^[!-~\u00c0-\u00ff](.*[!-~\u00c0-\u00ff])?\\z"

# Latin letters with marks and the plain letters they stand for.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
# The letters that period names are folded by.
PERIOD_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüç"
PERIOD_PLAIN = "aaaaaeeeeiiiiooooouuuuc"


def col(c: ColumnLike) -> Column:
    """A column by name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once a row: Spark copies an expression to each place that reads it, and the JVM doesn't compile methods that grow so long."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once_sql(x: str, name: str, use: str) -> str:
    """The same as SQL; ``use`` reads the value by ``name``."""
    return f"get(transform(array({x}), {name} -> {use}), 0)"


def trimmed(c: ColumnLike) -> Column:
    """Without white space at both ends."""
    return F.btrim(col(c), F.lit(WHITE))


def source_text(c: ColumnLike) -> Column:
    """O-4.18: trimmed; blank becomes NULL."""
    return F.nullif(trimmed(c), F.lit(""))


def text_sql(x: str) -> str:
    """O-4.18 of an SQL expression, as SQL: rows of wide tables are read by SQL text, which is parsed at once.

    Trimming by a set of characters is slow, so it is left to values without a plain character at each end.
    """
    return f"CASE WHEN {x} RLIKE '{_PLAIN_ENDS}' THEN {x} ELSE nullif(btrim({x}, '{WHITE}'), '') END"


def strip_accents(c: ColumnLike) -> Column:
    """Latin letters without their marks."""
    return F.translate(col(c), ACCENTED, PLAIN)


def normalize_period(c: ColumnLike) -> Column:
    """O-4.19: trimmed, blanks collapsed, lower case, 23 marked letters folded; blank becomes NULL."""
    return F.translate(F.lower(F.regexp_replace(source_text(c), r"\s+", " ")), PERIOD_ACCENTED, PERIOD_PLAIN)


def normalize_lookup_key(c: ColumnLike) -> Column:
    """O-4.24: no marks, upper case, every run of other characters one blank, trimmed."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z0-9]+", " "))


def normalize_text(c: ColumnLike) -> Column:
    """O-4.25: no marks, lower case, blanks as underscores."""
    return F.translate(F.lower(strip_accents(c)), " ", "_")


def normalize_name_column(c: ColumnLike) -> Column:
    """O-2.1 on values: other characters are dropped."""
    kept = F.regexp_replace(F.regexp_replace(F.upper(strip_accents(trimmed(c))), r"\s+", "_"), "[^A-Z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")


def _plain(name: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", name) if not unicodedata.combining(x))


def normalize_column_name(name: str) -> str:
    """O-2.1 on a header: ``coluna@#$%especial`` gives ``COLUNAESPECIAL``."""
    kept = re.sub(r"[^A-Z0-9_]", "", re.sub(r"\s+", "_", _plain(name).upper().strip()))
    return re.sub(r"_+", "_", kept).strip("_")


def normalize_column_name_api(name: str) -> str:
    """O-2.2: like O-2.1, but other characters become underscores: ``COLUNA_ESPECIAL``."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Z0-9]+", "_", _plain(name).upper().strip())).strip("_")
