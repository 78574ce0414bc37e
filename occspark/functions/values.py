"""Dates, times, numbers and labels (O-3.8, O-3.9, O-4.*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import WHITE, ColumnLike, col, once, once_sql, trimmed

#: Dates before this year are taken for errors.
FIRST_YEAR = 2013
#: Spreadsheet serials of 2013-01-01 to 2099-12-31.
SERIALS = (41275, 73050)
NOT_INFORMED = "Não informado"
# What texts of all date forms look like, so that others need one test.
_LIKE_DATE = "^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$"
_DATE_FORMS = (("^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$", "y-M-d"), ("^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", "d/M/y"), ("^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$", "d-M-y"), ("^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", "M/d/y"), ("^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$", "M-d-y"))
# Period names, their labels and their order.
PERIODS = (("de madrugada", "De madrugada"), ("pela manha", "Pela manhã"), ("a tarde", "À tarde"), ("a noite", "À noite"), ("em hora incerta", "Em hora incerta"))
# Labels of record types and weekdays.
RECORD_LABELS = {"celular": "Celulares", "veiculo": "Veículos", "objeto": "Objetos", "dados_criminais": "Dados criminais", "produtividade_armas": "Armas", "produtividade_entorpecentes": "Entorpecentes", "produtividade_veiculos": "Veículos recuperados", "produtividade_pessoa": "Pessoas"}
WEEKDAYS = ("Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo")


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern finds, else NULL: casts of blanks that fail are slow."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _date(c: Column, pattern: str, form: str) -> Column:
    return F.try_to_date(_found(c, pattern, 1), form)


def parse_date_flexible(c: ColumnLike) -> Column:
    """O-4.1: the first of five forms that gives a real date; the day comes first where both can."""
    return once(trimmed(c), lambda t: F.when(t.rlike(_LIKE_DATE), F.coalesce(*[_date(t, p, f) for p, f in _DATE_FORMS])))


def is_date_format(c: ColumnLike) -> Column:
    """O-3.8."""
    return F.coalesce(parse_date_flexible(c).isNotNull(), F.lit(False))


def is_time_format(c: ColumnLike) -> Column:
    """O-3.9: a real ``H:M:S`` or ``H:M``."""
    return col(c).rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9])?$")


def is_timestamp_format(c: ColumnLike) -> Column:
    """O-3.9: an ISO date, a blank or T, and a time with seconds."""
    return F.coalesce(col(c).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T]([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$") & F.try_to_date(_found(col(c), "^([0-9-]+)", 1), "y-M-d").isNotNull(), F.lit(False))


def iso(d: Column) -> Column:
    """``yyyy-MM-dd``; years past 9999 have more digits, without the sign that Spark puts before them."""
    return F.ltrim(F.date_format(d, "yyyy-MM-dd"), F.lit("+"))


def normalize_date_iso(c: ColumnLike) -> Column:
    """O-4.2: ISO text of a date from 2013 on, else NULL."""
    return once(parse_date_flexible(c), lambda d: F.when(F.year(d) >= FIRST_YEAR, iso(d)))


def excel_serial_to_date(n: ColumnLike) -> Column:
    """O-4.3: serials count from 1900-01-01 and hold a 29 February 1900 that never was; under 1 is NULL."""
    return F.when(col(n) >= 1, F.date_add(F.lit("1899-12-31").cast("date"), F.when(col(n) > 59, col(n) - 1).otherwise(col(n)).cast("int")))


def _serial_date(c: ColumnLike) -> Column:
    """The date of a whole or broken serial in range; all of them are past 1900-02-29."""
    number = _found(trimmed(c), r"^[0-9]{1,9}(\.[0-9]+)?$").try_cast("double")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int"))
    first, last = (F.date_add(F.lit("1899-12-30").cast("date"), F.lit(n)) for n in SERIALS)
    return F.when(day.between(first, last), day)


def convert_excel_serial_if_needed(c: ColumnLike) -> Column:
    """O-4.4: ISO text of a date or of a serial in range; anything else unchanged."""
    return F.coalesce(normalize_date_iso(c), iso(_serial_date(c)), col(c))


def excel_serial_legacy(c: ColumnLike) -> Column:
    """O-4.5: the older rule: leading digits in 30000..73050 count from 1899-12-30; dates pass unchanged."""
    days = lambda t: _found(t, "^([0-9]{1,9})", 1).try_cast("int")
    serial = lambda n: F.when((n >= 30000) & (n <= 73050), iso(F.date_add(F.lit("1899-12-30").cast("date"), n)))
    return once(trimmed(c), lambda t: F.when(is_date_format(t), t).otherwise(F.coalesce(once(days(t), serial), col(c))))


def _clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), (seconds % 60).cast("int"))


def excel_datetime_cell(serial: ColumnLike, header: str) -> Column:
    """O-4.6: by the header, the date of a cell's whole part, the time of its fraction, or the cell as text."""
    if "data" in header.lower():
        return iso(excel_serial_to_date(F.floor(col(serial)).cast("int")))
    if "hora" in header.lower():
        return _clock(F.round((col(serial) - F.floor(col(serial))) * 86400).cast("int"))
    return col(serial).cast("string")


def parse_time_flexible(c: ColumnLike) -> Column:
    """O-4.7: ``H:M:S``, ``H:M``, ``23h30``, a day's fraction, ``23.30``, ``hmm``, in this order; else NULL."""
    return once(trimmed(c), _parse_time)


def _parse_time(t: Column) -> Column:
    part = lambda p, k: _found(t, p, k).try_cast("int")
    real = lambda p, seconds: F.when(t.rlike(p), (part(p, 1) <= 23) & (part(p, 2) <= 59) & ((part(p, 3) <= 59) if seconds else F.lit(True)))
    full, short, h, dot = "^([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$", "^([0-9]{1,2}):([0-9]{1,2})$", "^([0-9]{1,2})[hH]([0-9]{1,2})$", r"^([0-9]{1,2})\.([0-9]{1,2})$"
    hm = lambda p: F.when(real(p, False), F.format_string("%02d:%02d", part(p, 1), part(p, 2)))
    fraction = _found(t, r"^[0-9]*\.?[0-9]+$").try_cast("double")
    seconds = F.when((fraction >= 0) & (fraction < 1), F.round(fraction * 86400).cast("int"))
    n = _found(t, "^[0-9]{1,4}$").try_cast("int")
    hmm = F.when((n <= 2359) & (n % 100 <= 59), F.format_string("%02d:%02d", F.floor(n / 100).cast("int"), (n % 100).cast("int")))
    return F.coalesce(F.when(real(full, True), F.format_string("%02d:%02d:%02d", part(full, 1), part(full, 2), part(full, 3))), hm(short), hm(h), F.when(seconds < 86400, _clock(seconds)), F.when(seconds.isNull(), hm(dot)), F.when(seconds.isNull(), hmm))


def _void(t: Column) -> Column:
    """Of a trimmed text: nothing, or a placeholder."""
    return t.isNull() | (t == "") | P.is_not_informed(t) | P.is_excel_overflow(t)


def clean_date(c: ColumnLike) -> Column:
    """O-4.8: ISO text or ''. A timestamp gives its date part, whatever the year."""
    stamp = lambda t: F.when(is_timestamp_format(t), iso(_date(t, "^([0-9-]+)", "y-M-d")))
    return once(trimmed(c), lambda t: F.when(_void(t) | P.is_null_pattern(t), "").otherwise(F.coalesce(normalize_date_iso(t), stamp(t), iso(_serial_date(t)), F.lit(""))))


def clean_time(c: ColumnLike) -> Column:
    """O-4.9: a time as it is written, or in the form of O-4.7, or ''."""
    return once(trimmed(c), lambda t: F.when(_void(t) | P.is_null_pattern(t), "").when(P.matches_time_pattern(t), t).otherwise(F.coalesce(_parse_time(t), F.lit(""))))


def clean_numeric(c: ColumnLike) -> Column:
    """O-4.10: seven rewrites of separators, then the value or its first number, or ''. ``1.234,56`` gives ``1.234``."""
    return once(trimmed(c), lambda t: F.when(_void(t), "").otherwise(once(_separated(t), _first_number)))


def _separated(t: Column) -> Column:
    # The rewrites, in order.
    for pattern, by in ((r"(-?[0-9]+),([0-9]+)", "$1.$2"), (r"(-?[0-9]+)\.([0-9]*),([0-9]+)", "$1.$2$3"), (r"\.{2,}", "."), (",{2,}", "."), ("[,.][,.]", "."), ("[,.]$", ""), ("^(-)[,.]", "$1")):
        t = F.regexp_replace(t, pattern, by)
    return t


def _first_number(t: Column) -> Column:
    number = r"(-?[0-9]+)([,.][0-9]+)?"
    first = F.concat(F.regexp_extract(t, number, 1), F.translate(F.regexp_extract(t, number, 2), ",", "."))
    return F.when(P.is_valid_numeric(t), t).otherwise(first)


def clean_integer(c: ColumnLike) -> Column:
    """O-4.11: digits and a leading minus, or ''. Postal codes and dashed ids are kept. ``12.5`` gives ``125``."""
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "")
    mended = lambda kept: F.when(kept.rlike("^-[0-9]*$"), kept).when(F.startswith(col(c), F.lit("-")) & F.contains(kept, F.lit("-")), F.concat(F.lit("-"), digits(kept))).otherwise(digits(kept))
    number = lambda t: once(once(F.regexp_replace(t, "[^0-9-]", ""), mended), lambda m: F.when(m == "-", "").otherwise(m))
    return once(trimmed(c), lambda t: F.when(_void(t), "").when(P.is_zip_code(t) | P.is_dash_identifier(t), col(c)).otherwise(number(t)))


def clean_general(c: ColumnLike) -> Column:
    """O-4.12: trimmed; placeholders become ''."""
    return once(trimmed(c), lambda t: F.when(t.isNull() | P.is_not_informed(t) | P.is_null_pattern(t), "").otherwise(t))


def clean_by_type(c: ColumnLike, kind: str, header: str) -> Column:
    """O-4.13: the cleaner that fits a type's name; integer columns that are postal codes stay text."""
    kind, header = kind.lower(), header.lower()
    if "numeric" in kind:
        return clean_numeric(c)
    if "int" in kind:
        return clean_general(c) if any(x in header for x in ("cep", "postal", "zip")) else clean_integer(c)
    if "date" in kind or "timestamp" in kind:
        return clean_date(c)
    return clean_time(c) if "time" in kind else clean_general(c)


#: Numbers of record fields, in the grammar of the source's runtime, but for its hexadecimal ones.
RECORD_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


# Texts as most cells have them, for SQL; \z is the very end ($ would pass a line break).
_PLAIN, _ISO_DAY, _LOCAL_DAY, _SERIAL_DAY = r"^-?[0-9]+([.,][0-9]+)?\\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T]|\\z)", r"^([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}\\z)", r"^[0-9]{5}([.][0-9]{1,6})?\\z"


def separators_sql(x: str) -> str:
    """A number's text with a point for its decimals: of two kinds of separators the last one, else a comma."""
    no_points = "regexp_replace(_bare, '[.](?=[^,]*,[^.]*$)', '')"  # points before a last comma
    both = f"CASE WHEN contains(_bare, ',') AND contains(_bare, '.') THEN regexp_replace({no_points}, ',(?=[^.]*[.][^,]*$)', '') ELSE _bare END"
    return f"translate({once_sql(f"translate({x}, '{WHITE}', '')", '_bare', both)}, ',', '.')"


def number_sql(x: str, grammar: str = P.PLAIN_NUMBER) -> str:
    """O-4.14 as SQL. The grammar of plain numbers is for coordinates and years, RECORD_NUMBER for fields of records.

    Digits with one separator at most are cast at once: higher-order functions aren't compiled, so only other texts are left to them.
    """
    rest = once_sql(f"regexp_extract({separators_sql(x)}, '{grammar}', 0)", "_digits", "CASE WHEN _digits <> '' THEN try_cast(_digits AS double) END")
    return f"CASE WHEN {x} RLIKE '{_PLAIN}' THEN try_cast(replace({x}, ',', '.') AS double) WHEN {x} <> '' THEN {rest} END"


def flag_sql(x: str) -> str:
    """O-4.16 as SQL."""
    rest = once_sql(f"upper(btrim({x}, '{WHITE}'))", "_flag", "CASE WHEN _flag IN ('S', 'SIM', 'TRUE', '1') THEN true WHEN _flag IN ('N', 'NAO', 'NÃO', 'FALSE', '0') THEN false END")
    return f"CASE WHEN {x} = 'S' THEN true WHEN {x} = 'N' THEN false WHEN {x} <> '' THEN {rest} END"


def date_sql(x: str) -> str:
    """O-4.17 as SQL. Whole days in the three usual forms are read at once, other texts form by form."""
    found = lambda pattern, form: once_sql(f"regexp_extract(_when, '{pattern}', 1)", "_part", f"CASE WHEN _part <> '' THEN try_to_date(_part, '{form}') END")
    days = once_sql("regexp_extract(_when, '^[0-9]{1,9}([.][0-9]+)?$', 0)", "_part", "CASE WHEN _part <> '' THEN cast(floor(try_cast(_part AS double)) AS int) END")
    serial = once_sql(days, "_days", f"CASE WHEN _days >= {SERIALS[0]} AND _days <= {SERIALS[1]} THEN date_add(DATE'1899-12-30', _days) END")
    forms = f"coalesce({found('^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:$|[ T])', 'y-M-d')}, {found('^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 'd/M/y')}, {found('^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$', 'd-M-y')}, {serial})"
    rest = once_sql(f"btrim({x}, '{WHITE}')", "_when", forms)
    local = f"try_cast(concat(substring({x}, 7, 4), '-', substring({x}, 4, 2), '-', substring({x}, 1, 2)) AS date)"
    day = f"cast(substring({x}, 1, 5) AS int)"
    whole = f"CASE WHEN {day} >= {SERIALS[0]} AND {day} <= {SERIALS[1]} THEN date_add(DATE'1899-12-30', {day}) END"
    return f"CASE WHEN {x} RLIKE '{_ISO_DAY}' THEN try_cast(substring({x}, 1, 10) AS date) WHEN {x} RLIKE '{_LOCAL_DAY}' THEN {local} WHEN {x} RLIKE '{_SERIAL_DAY}' THEN {whole} WHEN {x} <> '' THEN {rest} END"


def parse_source_number(c: str) -> Column:
    """O-4.14 of a column: ``1.234,56`` gives 1234.56; what is no number gives NULL."""
    return F.expr(number_sql(c))


def parse_record_number(c: str) -> Column:
    """O-4.14 for fields of records: signs, exponents and bare points are read too."""
    return F.expr(number_sql(c, RECORD_NUMBER))


def parse_source_integer(c: str) -> Column:
    """O-4.15: the number cut toward zero."""
    return parse_source_number(c).cast("bigint")


def parse_source_flag(c: str) -> Column:
    """O-4.16."""
    return F.expr(flag_sql(c))


def parse_source_date(c: str) -> Column:
    """O-4.17: ISO date or datetime, ``d/m/Y`` with anything behind, ``d-m-Y``, or a serial. Impossible dates are NULL."""
    return F.expr(date_sql(c))


def period_label(p: ColumnLike) -> Column:
    """O-4.20: a fixed label, or the name with its first letter in upper case."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in PERIODS:
        chain = chain.when(col(p) == name, label)
    return chain.otherwise(F.concat(F.upper(F.substring(col(p), 1, 1)), F.substring(col(p), 2, 1_000_000)))


def period_sort(p: ColumnLike) -> Column:
    """O-4.20: 1 to 5, or 99."""
    chain = F.when(F.lit(False), 0)
    for k, (name, _) in enumerate(PERIODS, 1):
        chain = chain.when(col(p) == name, k)
    return chain.otherwise(99)


def occurrence_hour(c: ColumnLike) -> Column:
    """O-4.21: the hour that a text starts with, 0 to 23."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*(2[0-3]|[01]?[0-9])(?:$|[^0-9])", 1), F.lit("")).cast("int")


def hash_sql(lat: str, lon: str) -> str:
    """O-4.22 as SQL."""
    part = lambda x: f"format_string('%.4f', floor({x} * 10000 + 0.5) / 10000 + 0.0D)"
    return f"substring(md5(concat({part(lat)}, '|', {part(lon)})), 1, 16)"


def bucket_sql(x: str) -> str:
    """O-4.23 as SQL."""
    return f"cast(round(cast({x} AS decimal(20,10)), 4) AS decimal(12,4))"


def location_hash(lat: str, lon: str) -> Column:
    """O-4.22: 16 hex digits for the cell of about 11 m; halves go up. -0.0 reads as 0."""
    return F.expr(hash_sql(lat, lon))


def location_bucket(x: str) -> Column:
    """O-4.23: four decimals, halves away from zero."""
    return F.expr(bucket_sql(x))


def record_quantity(q: ColumnLike) -> Column:
    """O-4.26: digits as a number, else 1."""
    return F.when(col(q).cast("string").rlike("^[0-9]{1,9}$"), col(q).cast("string").cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def drug_grams(q: ColumnLike) -> Column:
    """O-4.26: an unsigned number, else 0."""
    t = col(q).cast("string")
    return F.when(t.rlike("^[0-9]+([.,][0-9]+)?$"), F.translate(t, ",", ".").cast("double")).otherwise(F.lit(0.0))


def record_type_label(t: ColumnLike) -> Column:
    """O-4.27: one of eight labels, or the type's own name."""
    chain = F.when(F.coalesce(col(t), F.lit("")) == "", NOT_INFORMED)
    for name, label in RECORD_LABELS.items():
        chain = chain.when(col(t) == name, label)
    return chain.otherwise(col(t))


def weekday_label(d: ColumnLike) -> Column:
    """O-4.27: Monday first; NULL is not informed."""
    return F.coalesce(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(col(d)) + 1), F.lit(NOT_INFORMED))


def weekday_sort(d: ColumnLike) -> Column:
    """Monday 1 to Sunday 7; NULL is 8."""
    return F.coalesce(F.weekday(col(d)) + 1, F.lit(8))


def value_type_of(c: ColumnLike) -> Column:
    """O-4.28: the type that one value looks like; quotes around it don't count."""
    return once(F.regexp_replace(trimmed(c), "^[\"']|[\"']$", ""), _value_type)


def _value_type(t: Column) -> Column:
    n = F.when(t.rlike("^-?[0-9]{1,18}$"), t.cast("bigint"))
    integer = F.when(n.between(0, 9999), "SMALLINT").when(n.between(-(2**31), 2**31 - 1), "INT").when(n.isNotNull(), "BIGINT")
    return F.when(is_date_format(t), "DATE").when(is_time_format(t), "TIME").when(is_timestamp_format(t), "TIMESTAMP").when(integer.isNotNull(), integer).when(t.rlike(r"^-?[0-9]+[.,][0-9]+$"), "FLOAT").otherwise("TEXT")
