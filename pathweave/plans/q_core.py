"""Dataset build queries (vocabularies, sampling, statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import examples
from ..operators.pipeline import Build
from .oracle_fixtures import with_fx
from .registry import register


@register("dataset_stats", with_fx("""
SELECT role, total, empty, sum_total, sum_sampled, max_unfiltered,
       sum_total / nullif(total, 0) AS avg_total, sum_sampled / nullif(total, 0) AS avg_sampled
FROM (SELECT role, cast(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS bigint) AS total,
             cast(sum(CASE WHEN k > 0 THEN 0 ELSE 1 END) AS bigint) AS empty,
             cast(sum(n) AS bigint) AS sum_total, cast(sum(k) AS bigint) AS sum_sampled,
             cast(max(n) AS bigint) AS max_unfiltered
      FROM (SELECT role, ex, max(n) AS n, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS k FROM flags GROUP BY role, ex)
      GROUP BY role)
""", "flags"))
def dataset_stats(spark, sf_dir):
    """D4 over the whole build (the flagship of the dataset stage)."""
    return examples.dataset_stats(Build(spark, sf_dir).sizes)
