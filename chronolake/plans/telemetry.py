"""Telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import telemetry as tm
from ..sources.roles import SQL_CAPTURES, Roles
from .registry import query

#: A forest over customers: each one's parent is a seventh of its key.
TREE = "tree AS (SELECT c_custkey AS id, c_custkey // 7 AS parent, c_name AS name FROM customer WHERE c_custkey > 0)"


def tree(r: Roles) -> DataFrame:
    return r.table("customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 7).cast("long").alias("parent"), F.col("c_name").alias("name"))


@query("gra2_descendants", f"WITH RECURSIVE {TREE}, d AS (SELECT id FROM tree WHERE parent = 3 UNION SELECT t.id FROM tree t JOIN d ON t.parent = d.id) SELECT id FROM d")
def descendants(r: Roles) -> DataFrame:
    t = tree(r)
    return tm.descendants(t, r.spark.range(3, 4))


@query("gra3_roles", f"WITH RECURSIVE {TREE}, d AS (SELECT id FROM tree WHERE parent = 3 UNION SELECT t.id FROM tree t JOIN d ON t.parent = d.id) SELECT id, CASE WHEN id = 3 THEN 'root' WHEN id IN (SELECT id FROM d) THEN 'helper' ELSE 'other' END AS role FROM tree")
def roles(r: Roles) -> DataFrame:
    t = tree(r)
    return tm.roles(t, [("root", r.spark.range(3, 4)), ("helper", tm.descendants(t, r.spark.range(3, 4)))], "other").select("id", "role")


@query("win2_counter_lag", f"WITH {SQL_CAPTURES} SELECT id, round(greatest(value - lag(value) OVER (PARTITION BY owner ORDER BY created_at, id), CASE WHEN lag(value) OVER (PARTITION BY owner ORDER BY created_at, id) IS NULL THEN NULL ELSE 0 END), 6) AS delta FROM captures")
def counter_lag(r: Roles) -> DataFrame:
    d = tm.counter_deltas(r.captures(), "owner", ["created_at", "id"], "value")
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("owner").orderBy("created_at", "id")) == 1
    return d.select("id", F.when(~first, F.round("delta", 6)).alias("delta"))


@query("fil14_write_events", "SELECT event_id AS id FROM events WHERE regexp_matches(lower(event_type || ' ' || props), 'purchase|signup')")
def write_events(r: Roles) -> DataFrame:
    return r.table("events").filter(F.lower(F.concat_ws(" ", "event_type", "props")).rlike("purchase|signup")).select(F.col("event_id").alias("id"))


@query("agg24_area_totals", "SELECT lang AS area, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1 UNION ALL SELECT 'other', CAST(greatest((SELECT sum(length(text)) FROM conversations) - (SELECT sum(n_chars) FROM documents WHERE lang = 'en'), 0) AS BIGINT)")
def area_totals(r: Roles) -> DataFrame:
    areas = r.table("documents").groupBy(F.col("lang").alias("area")).agg(F.sum("n_chars").alias("bytes"))
    total = r.table("conversations").agg(F.sum(F.length("text")).alias("t")).crossJoin(r.table("documents").filter("lang = 'en'").agg(F.sum("n_chars").alias("a")))
    return areas.unionAll(total.select(F.lit("other"), F.greatest(F.col("t") - F.col("a"), F.lit(0))))


@query("snk24_process_totals", "SELECT user_id AS owner, count(*) AS events, round(sum(value), 4) AS bytes FROM events GROUP BY 1")
def process_totals(r: Roles) -> DataFrame:
    return r.captures().groupBy("owner").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("bytes")).orderBy(F.desc("bytes"), "owner")


@query("snk25_attribution_top", "SELECT event_type AS process_name, user_id AS owner, round(sum(value), 4) AS bytes FROM events GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def attribution_top(r: Roles) -> DataFrame:
    return r.captures().groupBy("process_name", "owner").agg(F.round(F.sum("value"), 4).alias("bytes")).orderBy(F.desc("bytes"), "process_name", "owner").limit(100)
