"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """``path`` with ``/`` as separator and without ``.``, ``..`` and empty parts; leading ``..`` that lead out stay.

    An empty path gives an empty one.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    up = F.lit("..")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.element_at(done, -1) != up)
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), done).when((part == up) & F.coalesce(can_pop, F.lit(False)), popped).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dirname(path: Column) -> Column:
    """All before the last ``/``, or ``.``."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """The last dot-separated part in lower case; the whole path if it has no dot."""
    return F.lower(F.substring_index(path, ".", -1))
