"""Filters by lists of codes and of names; a row passes by either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import codes


def listed(setting: str, lower: bool = False) -> list[str]:
    """Values of a comma list, trimmed, blanks dropped."""
    values = [v.strip() for v in setting.split(",")]
    return [v.lower() if lower else v for v in values if v]


def code_matches(code_list: Column, allowed: list[str]) -> Column:
    """Whether a code, or what stands before its slash, is in the list, both normalized (those that are no codes without white space). An empty list lets nothing pass."""
    if not allowed:
        return F.lit(False)
    entries = [codes.normalized_or_compact(F.lit(c)) for c in allowed]  # folded into constants when the query is planned
    group = lambda c: F.when(F.instr(c, "/") > 1, F.substring_index(c, "/", 1))
    own = F.transform(code_list, codes.normalized_or_compact)
    return F.coalesce(F.exists(own, lambda c: c.isin(*entries) | F.coalesce(group(c).isin(*entries), F.lit(False))), F.lit(False))


def name_matches(names: Column, keywords: list[str]) -> Column:
    """Whether a name has one of the keywords in it, whatever the case. No keyword lets nothing pass."""
    if not keywords:
        return F.lit(False)
    hit = lambda n: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.lower(n).contains(k))
    return F.coalesce(F.exists(names, hit), F.lit(False))


def counted(rows: DataFrame, by_code: Column, by_name: Column) -> DataFrame:
    """How many rows pass by code only, by name only, by both, and how many by neither."""
    return rows.agg(
        F.count_if(by_code & ~by_name).alias("code_only"),
        F.count_if(~by_code & by_name).alias("name_only"),
        F.count_if(by_code & by_name).alias("both"),
        F.count_if(~by_code & ~by_name).alias("skipped"),
    )
