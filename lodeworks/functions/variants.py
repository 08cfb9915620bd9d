"""JSON whose types vary, as VARIANT: fields read only if they have the type that is wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def at(v: Column, path: str) -> Column:
    """What is at a path ("a.b[0]"), JSON null included; null only if nothing is there."""
    return F.try_variant_get(v, f"$.{path}" if path else "$", "variant")


def has_type(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def text(v: Column) -> Column:
    """A JSON text; null for anything else."""
    return F.when(has_type(v, "STRING"), as_text(v))


def whole(v: Column) -> Column:
    """A JSON integer from 0 on; null for anything else."""
    n = F.try_variant_get(v, "$", "bigint")
    return F.when(has_type(v, "BIGINT") & (n >= 0), n)


def truth(v: Column) -> Column:
    return F.when(has_type(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean"))


def number(v: Column) -> Column:
    """A JSON number, or a text that is one."""
    numeric = has_type(v, "BIGINT") | has_type(v, "DECIMAL") | has_type(v, "DOUBLE") | has_type(v, "FLOAT")
    return F.when(numeric, F.try_variant_get(v, "$", "double")).when(has_type(v, "STRING") & as_text(v).rlike(NUMBER), as_text(v).try_cast("double"))


def items(v: Column) -> Column:
    """An array's elements, as variants; none of anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def texts(v: Column) -> Column:
    """Those of an array's elements that are texts."""
    return F.transform(F.filter(items(v), lambda e: has_type(e, "STRING")), as_text)
