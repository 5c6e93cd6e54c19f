"""Model availability: which models qualify, how probes ended, classes of request errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The action a usable model supports, and parts of names that rule one out.
ACTION = "generateContent"
EXCLUDED = r"vision|embedding|aqa"


def candidates(models: DataFrame) -> DataFrame:
    """Models that support the action, by the last part of their name."""
    model_id = F.element_at(F.split("name", "/"), -1)
    return models.where(F.array_contains("supported_actions", ACTION)).select(model_id.alias("model_id")).where(~F.col("model_id").rlike(EXCLUDED))


def outcome(message: Column) -> Column:
    low = F.lower(message)
    return F.when(message.isNull(), "usable").when(low.contains("429") | low.contains("resource_exhausted"), "no_quota").when(low.contains("403") | low.contains("permission_denied"), "no_permission").otherwise("failed")


def error_class(status: Column, reached: Column) -> Column:
    """``ok``, ``status_error`` for an answer that is no success, ``request_error`` where none came, else ``other``."""
    return F.when(reached & status.between(200, 299), "ok").when(reached & (status >= 300), "status_error").when(~reached, "request_error").otherwise("other")
