"""Running the surveyed SQL shapes through ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Warehouse function names that Spark spells differently, as inlined SQL functions.
SQL_FUNCTIONS = {
    "array_length": "(a ARRAY<DOUBLE>) RETURNS INT RETURN array_size(a)",
    "json_extract_scalar": "(t STRING, p STRING) RETURNS STRING RETURN get_json_object(t, p)",
}


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """``ARRAY_LENGTH`` and ``JSON_EXTRACT_SCALAR`` for queries that use the warehouse names.

    Generation, embedding and vector search are table operations here:
    ``operators.generate`` and ``operators.vector_search``.
    """
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
