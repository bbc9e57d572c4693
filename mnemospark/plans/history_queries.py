"""Problem 4: the history of every fact, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.operators.history import relation_history
from mnemospark.sources.tables import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return relation_history(table(spark, sf, "relations"))


QUERIES = {"p4_found": p4_found}

ORACLE = {
    "p4_found": r"""
WITH one AS (SELECT DISTINCT ON (id) * FROM relations ORDER BY id),
t AS (
  SELECT id, user_id, subject_key, object_key,
         regexp_replace(lower(trim(predicate)), '[\s_-]+', '_', 'g') AS predicate,
         coalesce(lower(trim(status)), 'active') AS status,
         least(first_seen, last_seen) AS lo, greatest(first_seen, last_seen) AS hi
  FROM one WHERE first_seen IS NOT NULL AND last_seen IS NOT NULL),
e AS (SELECT *, CASE WHEN status IN ('superseded', 'retracted') THEN hi ELSE lo END AS eff FROM t),
s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, subject_key, predicate, eff ORDER BY id DESC) = 1),
c AS (
  SELECT *, lag(object_key) OVER w AS po, lag(status) OVER w AS ps, row_number() OVER w AS n
  FROM s WINDOW w AS (PARTITION BY user_id, subject_key, predicate ORDER BY eff)),
v AS (SELECT * FROM c WHERE n = 1 OR po IS DISTINCT FROM object_key OR ps IS DISTINCT FROM status)
SELECT user_id, subject_key, predicate, object_key, status, CAST(floor(epoch(eff)) AS BIGINT) AS valid_from,
       coalesce(CAST(floor(epoch(lead(eff) OVER (PARTITION BY user_id, subject_key, predicate ORDER BY eff))) AS BIGINT), -1) AS valid_to
FROM v
"""
}
