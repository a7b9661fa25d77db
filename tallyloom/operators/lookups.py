"""Field lookups, such as ``text__iregex`` or ``date__lte``, compiled to Column predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOOKUPS = {
    "exact": lambda c, v: c.isNull() if v is None else c == v,
    "iexact": lambda c, v: F.lower(c) == F.lower(F.lit(v)),
    "contains": lambda c, v: c.contains(v),
    "icontains": lambda c, v: F.lower(c).contains(F.lower(F.lit(v))),
    "startswith": lambda c, v: c.startswith(v),
    "istartswith": lambda c, v: F.lower(c).startswith(F.lower(F.lit(v))),
    "endswith": lambda c, v: c.endswith(v),
    "iendswith": lambda c, v: F.lower(c).endswith(F.lower(F.lit(v))),
    "regex": lambda c, v: c.rlike(v),
    "iregex": lambda c, v: c.rlike("(?i)" + v),
    "in": lambda c, v: c.isin(list(v)),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "range": lambda c, v: c.between(*v),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def lookup(key: str, value) -> Column:
    """``field__op`` against ``value``; the operation is ``exact`` if none is named."""
    field, _, op = key.rpartition("__")
    if not field or op not in _LOOKUPS:
        field, op = key, "exact"
    return _LOOKUPS[op](F.col(field), value)


def all_of(lookups: dict) -> Column:
    return reduce(Column.__and__, (lookup(k, v) for k, v in lookups.items()), F.lit(True))


def follow(df: DataFrame, paths: Iterable[str], relations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``df`` with a column for each path, such as ``label__question__name``, which lookups then take as a field.

    ``relations`` gives each step its table and key, a column of the table and
    of whatever leads to it.  A table is joined once for each way that leads to
    it, with only the columns asked for; rows that lead nowhere keep nulls.
    """
    steps: dict[str, list[str]] = {}
    for path in paths:
        step, _, rest = path.partition("__")
        if not rest:
            if step not in df.columns:
                raise KeyError(f"no field named {step!r}; there are {sorted(df.columns)}")
        elif step not in relations:
            raise KeyError(f"no relation named {step!r}; there are {sorted(relations)}")
        elif rest not in steps.setdefault(step, []):
            steps[step].append(rest)
    for step, rests in steps.items():
        table, key = relations[step]
        far = follow(table, rests, relations).select(F.col(key).alias("__key"), *(F.col(r).alias(f"{step}__{r}") for r in rests))
        df = df.join(far, F.col(key) == F.col("__key"), "left").drop("__key")
    return df


def holds(predicate: Column) -> Column:
    """A predicate with unknown taken as false, so that its negation keeps nulls."""
    return F.coalesce(predicate, F.lit(False))


def frame_predicate(
    df: DataFrame,
    filter_dict: dict | None = None,
    exclude_dict: dict | None = None,
    complex_filters: Iterable[Column] = (),
    complex_excludes: Iterable[Column] = (),
) -> DataFrame:
    """Rows that meet all of ``filter_dict`` and ``complex_filters`` and none of the excludes; a dictionary excludes where all of it holds."""
    if filter_dict:
        df = df.where(all_of(filter_dict))
    if exclude_dict:
        df = df.where(~holds(all_of(exclude_dict)))
    for p in complex_filters:
        df = df.where(p)
    for p in complex_excludes:
        df = df.where(~holds(p))
    return df


def lookup_filter(df: DataFrame, search_filter, search_value, exclude: bool = False, operator: str = "and") -> DataFrame:
    """One lookup or several with the same value, joined by ``and`` or ``or``; without a lookup or value all rows stay."""
    if not search_filter or not search_value:
        return df
    keys = [search_filter] if isinstance(search_filter, str) else list(search_filter)
    join = Column.__or__ if operator == "or" else Column.__and__
    predicate = holds(reduce(join, (lookup(k, search_value) for k in keys)))
    return df.where(~predicate if exclude else predicate)
