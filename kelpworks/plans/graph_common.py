"""The edge list with the parts of its ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import with_parts
from ..sources.tables import load


def edges_view(spark, folder, *more):
    e = load(spark, folder, "edges", "from_id", "to_id", "kind", "confidence", *more).filter("from_id <> '' AND to_id <> ''")
    return with_parts(e.distinct())
