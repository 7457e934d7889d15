"""The archive's roles over the tables of a data folder.

Operators know roles (captures, text boxes, vectors, jobs); a role here is a
projection of a table, so column pruning and pushed filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def captures(self) -> DataFrame:
        """id, created_at, process_name, owner, value, k, image_hash, category from ``events``."""
        k = F.get_json_object("props", "$.k").cast("int")
        category = F.when(k < 50, "work").when(k < 80, "social")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.col("event_type").alias("process_name"),
            F.col("user_id").alias("owner"),
            "value",
            k.alias("k"),
            F.md5(F.concat_ws("/", "event_type", "user_id")).alias("image_hash"),
            category.alias("category"),
        )

    def parents(self) -> DataFrame:
        """id, owner, created_at, status, weight from ``orders``."""
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("weight"))

    def children(self) -> DataFrame:
        """parent_id, position, part, state, size, is_deleted from ``lineitem``."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("state"), F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "R").alias("is_deleted"))

    def boxes(self) -> DataFrame:
        """parent_id, position, kind, text from ``conversations``."""
        return self.table("conversations").select(F.col("conv_id").alias("parent_id"), F.col("turn").alias("position"), F.col("role").alias("kind"), "text")

    def texts(self) -> DataFrame:
        """id, text, category, process_name from ``documents``."""
        return self.table("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"), F.col("source").alias("process_name"))

    def vectors(self) -> DataFrame:
        """id, vector, label from ``embeddings``."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


#: The same roles in SQL, as common table expressions.
SQL_CAPTURES = """captures AS (
  SELECT event_id AS id, ts AS created_at, event_type AS process_name, user_id AS owner, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         md5(event_type || '/' || CAST(user_id AS VARCHAR)) AS image_hash,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'work'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 80 THEN 'social' END AS category
  FROM events)"""
SQL_PARENTS = "parents AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS weight FROM orders)"
SQL_CHILDREN = "children AS (SELECT l_orderkey AS parent_id, l_linenumber AS position, l_partkey AS part, l_linestatus AS state, l_quantity AS size, l_returnflag = 'R' AS is_deleted FROM lineitem)"
SQL_BOXES = "boxes AS (SELECT conv_id AS parent_id, turn AS position, role AS kind, text FROM conversations)"
SQL_TEXTS = "texts AS (SELECT doc_id AS id, text, lang AS category, source AS process_name FROM documents)"
SQL_VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)"
