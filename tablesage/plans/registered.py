"""All registered queries."""

from tablesage.plans import (  # noqa: F401
    evaluation_queries, linking_queries, log_queries, profiling_queries, relational, selection_queries, training_queries,
)
from tablesage.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["question_tables"](spark, sf_dir)
