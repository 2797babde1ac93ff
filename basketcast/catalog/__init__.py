"""Named queries over the sample tables, each with its SQL twin where one exists."""

from basketcast.catalog.registry import ORACLES, QUERIES
from basketcast.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates, encoders, evaluation, filters, joins, models, scalars, scores, sequences, sets, sources)

__all__ = ["ORACLES", "QUERIES"]
