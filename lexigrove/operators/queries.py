"""Driver queries of the key statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.operators.keystats import heavy_keys, key_stats
from lexigrove.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "postings"), ["field", "term"], "0.01").select("field", "term")


def p1_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    return key_stats(
        table(spark, folder, "postings"),
        ["field", "term"],
        {"n_with_id": ("count", "id"), "first_indexed": ("min", "indexed_at"), "last_indexed": ("max", "indexed_at")},
        distinct=["segment_id", "doc_ord"],
        distinct_name="n_docs",
    )


QUERIES = {"p1_found": p1_found, "p1_key_stats": p1_key_stats}

SQL = {
    "p1_found": """
        SELECT field, term FROM postings GROUP BY field, term
        HAVING count(*) * 100 >= (SELECT count(*) FROM postings)""",
    "p1_key_stats": """
        SELECT field, term, count(*) AS n_rows, count(id) AS n_with_id, min(indexed_at) AS first_indexed,
               max(indexed_at) AS last_indexed, count(DISTINCT (segment_id, doc_ord)) AS n_docs
        FROM postings GROUP BY field, term""",
}
