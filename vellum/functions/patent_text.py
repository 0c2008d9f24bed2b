"""Parts of patent texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import non_empty, trimmed

#: Wordings of paragraphs that state a problem, its solution, or the effects of it.
PROBLEM = ("为解决上述技术问题", "所要解决的技术问题", "要解决的技术问题", "本发明所要解决的技术问题")
SOLUTION = ("采用如下技术方案", "通过如下技术方案", "通过以下技术方案", "本发明提供.{0,4}技术方案", "技术方案是", "解决上述技术问题所采用的技术方案")
EFFECT = ("有益效果", "具有如下技术效果", "具有以下有益效果", "与现有技术相比", "具有以下优点", "本发明具有如下.{0,4}效果")
MARKER = r"\[\[PATENT_IMAGE:([^\]]+)\]\]"


def image_marker(file_name: Column) -> Column:
    """What stands in a paragraph for an image of a file."""
    return F.concat(F.lit("[[PATENT_IMAGE:"), file_name, F.lit("]]"))


def first_match(paragraphs: Column, patterns: tuple[str, ...]) -> Column:
    """Place of the first paragraph that one of the patterns is found in, from 1; null if none is."""
    return F.nullif(F.array_position(F.transform(paragraphs, lambda p: p.rlike("|".join(patterns))), True), F.lit(0))


def disclosure_parts(paragraphs: Column) -> tuple[Column, Column, Column]:
    """Problem, solution and effect: each from its first marked paragraph up to the next marked one, or the end.

    Of marks in one paragraph the last of problem, solution, effect counts. Without a problem's mark, what stands before the
    solution is the problem. Null where there is none.
    """
    found = F.struct(paragraphs.alias("all"), *[first_match(paragraphs, p).alias(f"at{i}") for i, p in enumerate((PROBLEM, SOLUTION, EFFECT))])
    parts = bound(found, lambda f: F.struct(*[x.alias(f"part{i}") for i, x in enumerate(_cut(f["all"], [f[f"at{i}"] for i in range(3)]))]))
    return parts["part0"], parts["part1"], parts["part2"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _cut(paragraphs: Column, marks: list[Column]) -> tuple[Column, Column, Column]:
    """The parts from the places of their marks; marks and paragraphs are at hand."""
    last = F.size(paragraphs) + 1

    def part(first: Column, end: Column) -> Column:
        return non_empty(trimmed(F.array_join(F.slice(paragraphs, first.cast("int"), (end - first).cast("int")), "\n")))

    def segment(i: int) -> Column:
        at = marks[i]
        behind = [F.when((other > at) | ((other == at) & F.lit(j > i)), other) for j, other in enumerate(marks) if j != i]
        end = F.coalesce(F.array_min(F.array(*behind)), last)
        return F.when(end > at, part(at, end))

    problem, solution, effect = (segment(i) for i in range(3))
    before = F.when(marks[0].isNull() & solution.isNotNull() & (marks[1] > 1), part(F.lit(1), marks[1]))
    return F.coalesce(problem, before), solution, effect


def inline_images(text: Column) -> Column:
    """Files that a text's image markers name, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), 1))


def detected_type(xml: Column) -> Column:
    """Type of a patent by its root's kind, else by words in its text: ``invention``, ``utility_model``, ``invention_application``; null if nothing tells it."""
    root = F.regexp_extract(xml, r"(?s)<(?:[A-Za-z_][\w.-]*:)?[A-Za-z][\w.-]*\b[^>]*>", 0)
    kind = F.upper(F.regexp_extract(root, r"""\skind\s*=\s*["']([^"']*)["']""", 1))
    by_kind = F.when(kind == "A", "invention_application").when(kind == "B", "invention").when(kind == "U", "utility_model")
    lower = F.lower(xml)
    by_word = F.when(lower.contains("实用新型") | lower.contains("utility-model"), "utility_model").when(lower.contains("发明") | lower.contains("invention"), "invention")
    return F.coalesce(by_kind, by_word)
