"""Registry of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import schema_drift
from .plans import composite_queries, flow_queries, kpi_queries, name_queries, record_queries, relational_queries, url_queries  # noqa: F401
from .plans.kpi_queries import flagship  # noqa: F401
from .plans.registry import ORACLE, QUERIES
from .session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of fields from file to file of a feed."""
    return schema_drift.changes(table(spark, sf_dir, "export_files"), table(spark, sf_dir, "export_rows"))


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent lead table over all files."""
    return schema_drift.consistent_table(table(spark, sf_dir, "export_files"), table(spark, sf_dir, "export_rows"))


def p1_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of every field of every feed and where they appear first."""
    return schema_drift.alternatives(table(spark, sf_dir, "export_files"), table(spark, sf_dir, "export_rows"))


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged union of every file: each field with the types of its values."""
    return schema_drift.file_schemas(table(spark, sf_dir, "export_rows"))


#: Types by the JSON functions of SQL; a key is addressed by a JSON pointer.
P1_FIELDS = r"""
WITH k AS (SELECT file_id, payload, unnest(json_keys(payload)) AS field FROM export_rows WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
t AS (SELECT file_id, field, CASE json_type(json_extract(payload, '/' || replace(replace(field, '~', '~0'), '/', '~1'))) WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal'
  WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind FROM k WHERE field <> 'lead_id')
SELECT file_id, field, coalesce(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), []) AS kinds FROM t GROUP BY file_id, field
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [p1_found, p1_table, p1_alternatives, p1_fields]
    return {f.__name__: f for f in made} | QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p1_fields": P1_FIELDS} | ORACLE
