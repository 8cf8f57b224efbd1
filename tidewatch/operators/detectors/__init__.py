"""Finding generators: each is a column, an array of findings of one occurrence, so a scan yields all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import schemas

FIELDS = ["code", "category", "severity", "metric", "observed", "expected", "lower", "upper", "score", "evidence"]


def finding(**values: Column | str | None) -> Column:
    """A finding struct; fields not given are null."""
    cols = []
    for f in FIELDS:
        v = values.get(f)
        c = F.lit(v) if v is None or isinstance(v, str) else v
        cols.append(c.cast("double" if f in FIELDS[4:9] else "string").alias(f))
    return F.struct(*cols)


def some(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def none() -> Column:
    return F.array().cast(f"array<{schemas.FINDING}>")
