"""Conditions of patent search, as Boolean columns.

They are combined with ``&``, ``|`` and ``~``; a condition on a null column is null, so its row is
dropped under ``~`` too, as in SQL. Conditions on child tables mark parents by a join (``has_child``).
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConditionError(ValueError):
    """A value that no condition can be made of."""


def like_pattern(value: str, prefix: bool = False) -> str:
    """LIKE pattern for a value with the wildcards ``*`` and ``?``; all other characters stand for themselves."""
    if not value.strip():
        raise ConditionError("a search value is empty")
    for c in "\\%_":
        value = value.replace(c, "\\" + c)
    value = value.replace("*", "%").replace("?", "_").replace("？", "_")
    return f"{value}%" if prefix else f"%{value}%"


def contains(column: Column, value: str) -> Column:
    """Whether a text has the value in it, whatever the case."""
    return F.ilike(column, F.lit(like_pattern(value)), F.lit("\\"))


def contains_raw(column: Column, value: str) -> Column:
    """The same with ``%`` and ``_`` as wildcards, as typed into a search box."""
    return F.ilike(column, F.lit("%" + value.replace("\\", "\\\\") + "%"), F.lit("\\"))


def any_contains(columns: list[Column], value: str) -> Column:
    return reduce(lambda a, b: a | b, [contains(c, value) for c in columns])


def normalized_code(value: str) -> str:
    """A typed classification code as tables have it: without version and spaces, in upper case, long forms written short."""
    bare = re.sub(r"\s+", "", re.sub(r"\s*\([0-9]{4}\.[0-9]{2}\)\s*", "", value).upper())
    if not bare:
        raise ConditionError("a classification code is empty")
    if long := re.fullmatch(r"([A-H][0-9]{2}[A-Z])([0-9]{4})([0-9]{6})", bare):
        if int(long[2]) == 0:
            raise ConditionError(f"no main group: {value}")
        return f"{long[1]}{int(long[2])}/{long[3].rstrip('0').ljust(2, '0')}"
    return bare


def code_prefix(code_norm: Column, value: str) -> Column:
    """Whether a normalized code begins with the value, which is normalized too; without wildcards this reaches the scan."""
    value = normalized_code(value)
    if any(c in value for c in "*?？"):
        return F.ilike(code_norm, F.lit(like_pattern(value, prefix=True)), F.lit("\\"))
    return code_norm.startswith(value)


def on_date(column: Column, value: str) -> Column:
    """Whether a text date is in a year (YYYY), in a month, or on a day (one or two digits each)."""
    found = re.fullmatch(r"([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?", value.strip())
    if not found:
        raise ConditionError(f"not a date: {value}")
    numbers = [int(n) for n in found.groups() if n is not None]
    try:
        start = datetime.date(*numbers, *[1] * (3 - len(numbers)))
    except ValueError:
        raise ConditionError(f"not a date: {value}") from None
    if len(numbers) == 3:
        return column == start.isoformat()
    if len(numbers) == 2:
        end = f"{start.year + start.month // 12}-{start.month % 12 + 1:02d}-01"
    else:
        end = f"{start.year + 1}-01-01"
    return (column >= start.isoformat()) & (column < end)


def in_range(column: Column, first: str | None, last: str | None) -> Column:
    """Whether a text date lies in a range that includes both ends; open where an end is None."""
    out = F.lit(True)
    if first:
        out = out & (column >= first)
    if last:
        out = out & (column <= last)
    return out


def has_child(parents: DataFrame, children: DataFrame, key: str, condition: Column, flag: str) -> DataFrame:
    """``parents`` with a Boolean ``flag``: whether a child row of the same key meets the condition.

    The matching keys are made distinct first, so parents are not multiplied, and the flag is never null.
    """
    hit = children.where(condition).select(F.col(key)).distinct().withColumn(flag, F.lit(True))
    return parents.join(hit, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_child(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    """``parents`` that have a child row of the same key which meets the condition."""
    return parents.join(children.where(condition).select(key), key, "left_semi")


def without_child(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    """``parents`` that have no child row of the same key which meets the condition."""
    return parents.join(children.where(condition).select(key), key, "left_anti")


def json_text(value: Column) -> Column:
    """A nested value as the JSON text that a search for claims or descriptions looks through; a text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)


def agent_contains(agency: Column, agent: Column, value: str) -> Column:
    """Whether a row of agents has the value in the agency's name or the agent's."""
    return contains(agency, value) | contains(agent, value)


def code_contains(code_norm: Column, value: str) -> Column:
    """Whether a normalized code has the value, normalized, in it."""
    return F.ilike(code_norm, F.lit(like_pattern(normalized_code(value))), F.lit("\\"))


def default_field(parents: DataFrame, key: str, texts: list[str], names: list[DataFrame], ipc: DataFrame, value: str) -> DataFrame:
    """``parents`` that have a value without a field: in one of their ``texts``, in a name (key, name) of a child table, or in a normalized code (key, code_norm)."""
    marks = []
    for i, children in enumerate(names):
        parents = has_child(parents, children, key, contains(F.col("name"), value), f"__name{i}")
        marks.append(f"__name{i}")
    parents = has_child(parents, ipc, key, code_contains(F.col("code_norm"), value), "__code")
    hit = any_contains([F.col(c) for c in texts], value)
    for mark in [*marks, "__code"]:
        hit = F.coalesce(hit, F.lit(False)) | F.col(mark)
    return parents.where(hit).drop(*marks, "__code")


def _asked(rows: DataFrame, key: str, values: list[str], hit: Callable[[str], Column]) -> DataFrame:
    """(key, asked): which of the values a row has, a row for each."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(hit(v), F.lit(v)) for v in values]))).alias("asked"))


def default_field_each(parents: DataFrame, key: str, texts: list[str], names: list[DataFrame], ipc: DataFrame, values: list[str]) -> DataFrame:
    """``parents`` once for each of several values that :func:`default_field` finds them by, with ``asked``, the value; every table is read once. Parents without a key are left out."""
    found = _asked(parents, key, values, lambda v: any_contains([F.col(c) for c in texts], v))
    for children in names:
        found = found.union(_asked(children, key, values, lambda v: contains(F.col("name"), v)))
    found = found.union(_asked(ipc, key, values, lambda v: code_contains(F.col("code_norm"), v)))
    return parents.join(found.distinct(), key)


def free_search_each(parents: DataFrame, key: str, texts: list[str], applicants: DataFrame, ipc: DataFrame, values: list[str]) -> DataFrame:
    """The same of :func:`free_search`."""
    found = _asked(parents, key, values, lambda v: reduce(lambda a, b: a | b, [contains_raw(F.col(c), v) for c in texts]))
    found = found.union(_asked(applicants, key, values, lambda v: contains_raw(F.col("name"), v)))
    found = found.union(_asked(ipc, key, values, lambda v: contains_raw(F.replace(F.col("ipc_code"), F.lit(" "), F.lit("")), re.sub(r"\s+", "", v))))
    return parents.join(found.distinct(), key)


def free_search(parents: DataFrame, key: str, texts: list[str], applicants: DataFrame, ipc: DataFrame, value: str) -> DataFrame:
    """``parents`` that a search box finds: in a text, in an applicant's name (key, name), or in a code as written (key, ipc_code), spaces aside."""
    marked = has_child(parents, applicants, key, contains_raw(F.col("name"), value), "__name")
    marked = has_child(marked, ipc, key, contains_raw(F.replace(F.col("ipc_code"), F.lit(" "), F.lit("")), re.sub(r"\s+", "", value)), "__code")
    hit = reduce(lambda a, b: a | b, [contains_raw(F.col(c), value) for c in texts])
    return marked.where(F.coalesce(hit, F.lit(False)) | F.col("__name") | F.col("__code")).drop("__name", "__code")
