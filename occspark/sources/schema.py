"""Columns of source tables (O-2.3 to O-2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_column_name


def drop_identical_duplicate_columns(df: DataFrame) -> DataFrame:
    """O-2.3: columns of one normalized name: one if all rows agree (trimmed, NULL as blank), else ``N``, ``N_2``, ...

    One aggregation compares all of them, however many there are.
    """
    groups: dict[str, list[int]] = {}
    for k, name in enumerate(df.columns):
        groups.setdefault(normalize_column_name(name), []).append(k)
    at = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    text = lambda k: F.trim(F.coalesce(F.col(f"_{k}").cast("string"), F.lit("")))
    tests = {name: F.bool_and(F.lit(True)) for name, own in groups.items() if len(own) > 1}
    for name in tests:
        first, *rest = groups[name]
        same = F.lit(True)
        for k in rest:
            same = same & (text(first) == text(k))
        tests[name] = F.coalesce(F.bool_and(same), F.lit(True))
    equal = at.agg(*[t.alias(f"t{k}") for k, t in enumerate(tests.values())]).first() if tests else ()
    same_by_name = dict(zip(tests, equal, strict=True))
    out = []
    for name, own in groups.items():
        kept = own[:1] if same_by_name.get(name, True) else own
        out += [(k, name if j == 0 else f"{name}_{j + 1}") for j, k in enumerate(kept)]
    return at.select(*[F.col(f"_{k}").alias(name) for k, name in sorted(out)])


def fix_blank_and_duplicate_names(names: list[str]) -> list[str]:
    """O-2.4: blank names become ``column_<i>``; repeats, without case, get the next free suffix."""
    taken: set[str] = set()
    out = []
    for k, name in enumerate(names, 1):
        base = name.strip() or f"column_{k}"
        fixed, n = base, 1
        while fixed.lower() in taken:
            n += 1
            fixed = f"{base}_{n}"
        taken.add(fixed.lower())
        out.append(fixed)
    return out


def map_columns(source: list[str], target: list[str]) -> dict[str, str]:
    """O-2.5: source to target columns: exactly, normalized, both normalized, without case; none at all is an error."""
    rules = (lambda s, t: s == t, lambda s, t: normalize_column_name(s) == t, lambda s, t: normalize_column_name(s) == normalize_column_name(t), lambda s, t: s.lower() == t.lower())
    found: dict[str, str] = {}
    for name in source:
        hit = next((t for rule in rules for t in target if rule(name, t)), None)
        if hit is not None and hit not in found.values():
            found[name] = hit
    if not found:
        raise ValueError("no column matches the table")
    return found


def select_mapped(df: DataFrame, target: list[str]) -> DataFrame:
    """``df`` with the target's names; other columns are dropped."""
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in map_columns(df.columns, target).items()])


def apply_type_overrides(types: dict[str, str], overrides: dict[str, str]) -> dict[str, str]:
    """O-2.6: overrides by normalized name, for columns that there are."""
    by_name = {normalize_column_name(k): v for k, v in overrides.items()}
    return {c: by_name.get(normalize_column_name(c), t) for c, t in types.items()}
