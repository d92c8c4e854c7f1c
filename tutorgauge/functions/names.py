"""Parsers for task, run, file and branch names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _after_first(column: Column, mark: str) -> Column:
    return F.when(column.contains(mark), F.get(F.split(column, _quoted(mark), 2), F.lit(1))).otherwise(column)


def eval_name(column: Column) -> dict[str, Column]:
    """``[suite|]task:lang|shots`` into its parts; null where the text has another form."""
    form = r"^(?:[^|]*\|)?([^:|]+):([^:|]+)\|(\d+)$"
    part = lambda i: F.when(column.rlike(form), F.regexp_extract(column, form, i))
    return {"task": part(1), "eval_lang": part(2), "n_shots": part(3).cast("int")}


def run_name(column: Column, tag: str, lineage: str = "S1") -> dict[str, Column]:
    """``…details_<tag>-<org>_<model>[-lora[-4bit]]-<tag>-<lineage>-<lang>_<teacher>`` into its parts.

    ``tag`` is the short project tag the run names carry. Names of another form give nulls.
    """
    parts = F.split(_after_first(column, f"details_{tag}-"), _quoted(f"-{tag}-{lineage}-"))
    parts = F.when(F.size(parts) == 2, parts)
    student, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    teacher = F.replace(F.coalesce(F.get(F.split(rest, "_", 2), F.lit(1)), F.when(rest.isNotNull(), F.lit(""))), F.lit("_"), F.lit("."))
    teacher = reduce(lambda c, s: F.regexp_replace(c, _quoted(s) + "$", ""), fv.TEACHER_SUFFIXES, teacher)
    low = F.lower(student)
    lora = low.contains("lora")
    return {
        "base_model": F.array_join(F.split(F.regexp_replace(student, "(?is)-lora.*$", ""), "_", 2), "/"),
        "teacher_model": teacher,
        "lora": lora,
        "qlora": (lora & low.contains("4bit")) | low.contains("8bit"),
        "target_lang": F.get(F.split(rest, "_", 2), F.lit(0)),
    }


def metric_file_name(stem: Column, tag: str, lineage: str = "S1") -> dict[str, Column]:
    """``<tag>-<lineage>-<lang>_<org>__<model>_intrinsic_metrics`` into language and model."""
    short = F.replace(F.replace(stem, F.lit(f"{tag}-{lineage}-"), F.lit("")), F.lit("_intrinsic_metrics"), F.lit(""))
    parts = F.split(short, "_", 2)
    return {
        "language": F.get(parts, F.lit(0)),
        "model": F.replace(F.get(parts, F.lit(1)), F.lit("__"), F.lit("/")),
    }


def metric_file_name_short(stem: Column) -> dict[str, Column]:
    """Same files, read by position: last dash part of the first piece, and the middle pieces.

    Both are null where the stem has fewer than three pieces.
    """
    pieces = F.split(stem, "_")
    enough = F.size(pieces) >= 3
    middle = F.array_join(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 3, F.lit(0))), "_")
    return {
        "target_lang": F.when(enough, F.element_at(F.split(F.get(pieces, F.lit(0)), "-"), -1)),
        "teacher_model": F.when(enough, _after_first(middle, "__")),
    }


def short_model_name(column: Column) -> Column:
    """Model name without its organisation."""
    return F.element_at(F.split(column, "/"), -1)


def base_model_of_branch(branch: Column, strict: bool = True) -> dict[str, Column]:
    """Base model id and license by the first known part found in a branch name."""
    def chain(pick: int) -> Column:
        expr = None
        for row in fv.BASE_MODELS:
            hit = branch.contains(row[0])
            expr = F.when(hit, F.lit(row[pick])) if expr is None else expr.when(hit, F.lit(row[pick]))
        if strict:
            return expr.otherwise(F.raise_error(F.concat(F.lit("no base model in branch: "), branch)))
        return expr

    return {"base_model": chain(1), "license": chain(2)}


def lookup(column: Column, table: dict[str, str]) -> Column:
    """Value of ``column`` in a fixed table, null where it is not listed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def language_code(name: Column) -> Column:
    return lookup(name, fv.LANGUAGE_CODES)


def iso1_code(iso3: Column) -> Column:
    """Two-letter code where one is known, the code itself otherwise."""
    return F.coalesce(lookup(iso3, fv.ISO3_TO_ISO1), iso3)


def script_code(iso1: Column) -> Column:
    """Language and script code of a two-letter code, null where none is known."""
    return lookup(iso1, fv.SCRIPT_CODES)


def display_name(iso1: Column, strict: bool = True) -> Column:
    """English name of a language code; an unknown code is an error."""
    name = lookup(iso1, fv.DISPLAY_NAMES)
    if not strict:
        return name
    return F.coalesce(name, F.raise_error(F.concat(F.lit("Unknown language: "), iso1)).cast("string"))
