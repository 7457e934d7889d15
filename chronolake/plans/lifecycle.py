"""Lifecycle, ledger and policy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..operators import lifecycle as lc
from ..operators.bitmap_index import unlinked
from ..sources.indexes import stored_index
from ..sources.roles import SQL_CAPTURES, Roles
from .registry import query

CAPS = f"WITH {SQL_CAPTURES} "
NOW = 1706659200


def state(r: Roles) -> tuple[DataFrame, DataFrame]:
    p = r.parents().withColumn("is_deleted", F.col("status") == "P")
    return p, r.children().select("parent_id", "position", "is_deleted")


@query("snk1_insert_dedup", CAPS + ", old AS (SELECT image_hash, min(id) AS id FROM captures WHERE process_name IN ('view', 'click') AND owner < 100 GROUP BY 1) SELECT id, image_hash FROM old UNION ALL SELECT min(id), image_hash FROM captures WHERE image_hash NOT IN (SELECT image_hash FROM old) GROUP BY image_hash")
def insert_dedup(r: Roles) -> DataFrame:
    c = r.captures()
    old = c.filter("process_name IN ('view', 'click') AND owner < 100").groupBy("image_hash").agg(F.min("id").alias("id")).select("id", "image_hash")
    return lc.insert_new(old, c.select("id", "image_hash"), "image_hash")


@query("snk3_commit_counts", "SELECT count(*) FILTER (WHERE length(text) <= 3000) AS added, count(*) FILTER (WHERE length(text) > 3000) AS skipped FROM documents")
def commit_counts(r: Roles) -> DataFrame:
    box = F.array(*[F.array(F.lit(0.0), F.col("id").cast("double")) for _ in range(4)])
    return lc.commit_children(r.texts(), lc.box_is_valid(box, F.col("text"), 3000))[1]


@query("snk5_hard_delete", "SELECT l_orderkey AS parent_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def hard_delete(r: Roles) -> DataFrame:
    p, c = state(r)
    return lc.hard_delete(p, c, r.table("labels").select(F.col("doc_id").alias("id")))[1].groupBy("parent_id").agg(F.count("*").alias("n"))


@query("snk7_soft_delete", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND strftime(o_orderdate, '%Y-%m') = '1998-03') AS parents, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND strftime(o_orderdate, '%Y-%m') = '1998-03') AS children")
def soft_delete(r: Roles) -> DataFrame:
    p, c = state(r)
    return lc.soft_delete(p, c, F.date_format("created_at", "yyyy-MM") == "1998-03")[2]


@query("snk9_unlink_postings", "WITH c AS (SELECT doc_id AS id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]', '', 'g') AS t FROM documents)), p AS (SELECT id, c || lead(c) OVER (PARTITION BY id ORDER BY i) AS token FROM c WHERE c <> ''), g AS (SELECT DISTINCT id, token FROM p WHERE token IS NOT NULL) SELECT token, count(*) AS n FROM g WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def unlink(r: Roles) -> DataFrame:
    kept = unlinked(stored_index(r).containers(), r.table("labels").select(F.col("doc_id").alias("id")))
    return kept.groupBy("token").agg(F.sum("n").alias("n"))


@query("snk12_content_ids", "SELECT sha256(text) AS content_hash, min(doc_id) AS id FROM documents GROUP BY 1")
def content_ids(r: Roles) -> DataFrame:
    return lc.content_ids(r.texts(), F.col("text"))


@query("snk14_keep_referenced", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def keep_referenced(r: Roles) -> DataFrame:
    return lc.keep_referenced(r.table("customer").select(F.col("c_custkey").alias("id")), r.table("orders"), "o_custkey")


@query("snk17_latest_wins", CAPS + ", a AS (SELECT image_hash, id, value, row_number() OVER (PARTITION BY image_hash ORDER BY value DESC, id DESC) AS r FROM captures) SELECT image_hash, max(value) AS value FROM a GROUP BY 1")
def latest_wins(r: Roles) -> DataFrame:
    c = r.captures().select("image_hash", "value", "process_name")
    out = lc.latest_wins(c.filter("process_name = 'view'"), c.filter("process_name <> 'view'"), ["image_hash"], "value")
    return out.select("image_hash", "value")


@query("snk21_merge_tasks", "SELECT CASE WHEN user_id IN (5, 6, 7) THEN 4 ELSE user_id END AS task_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def merge_tasks(r: Roles) -> DataFrame:
    a = r.captures().select(F.col("owner").alias("task_id"), F.col("process_name").alias("screenshot_id"))
    return lc.merge_tasks(a, 4, [5, 6, 7]).groupBy("task_id").agg(F.count("*").alias("n"))


@query("snk22_task_bounds", CAPS + "SELECT owner AS task_id, count(*) AS n, CAST(floor(epoch(min(created_at))) AS BIGINT) AS start, CAST(floor(epoch(max(created_at))) AS BIGINT) AS end FROM captures WHERE value <= 20 GROUP BY 1")
def task_bounds(r: Roles) -> DataFrame:
    c = r.captures()
    left = c.filter("value <= 20").select(F.col("owner").alias("task_id"), F.col("id").alias("screenshot_id"))
    return lc.task_bounds(left, c).withColumns({k: F.unix_timestamp(k) for k in ("start", "end")})


@query("stm1_ensure_jobs", "SELECT CAST(d.doc_id AS VARCHAR) AS subject_key, CASE WHEN l.doc_id IS NULL THEN 'queued' WHEN n_chars > 2000 AND quality = 1 THEN 'current' WHEN n_chars > 2000 THEN 'processing' ELSE 'requeued' END AS outcome FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def ensure_jobs(r: Roles) -> DataFrame:
    docs = r.table("documents").select(F.col("doc_id").cast("string").alias("subject_key"), "doc_id", F.md5("text").alias("fp"), "n_chars")
    jobs = r.table("labels").join(docs, "doc_id").select("subject_key", F.when(F.col("n_chars") > 2000, F.col("fp")).otherwise("old").alias("fp"), F.when(F.col("quality") == 1, "completed").otherwise("processing").alias("status"))
    return lc.ensured(jobs, docs.select("subject_key", "fp"))


@query("stm4_recover", "SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS status FROM labels")
def recover(r: Roles) -> DataFrame:
    return lc.recovered(r.table("labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("processing").alias("status")))


@query("stm5_invalidate", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'discarded' WHEN doc_id > 500 THEN 'pending' ELSE 'completed' END AS status FROM labels")
def invalidate(r: Roles) -> DataFrame:
    jobs = r.table("labels").select("doc_id", F.when(F.col("toxic") == 1, "discarded").otherwise("completed").alias("status"))
    return lc.invalidated(jobs, F.col("doc_id") <= 500)


@query("dat8_retry", "SELECT vec_id AS id, CASE WHEN label < 4 THEN 'pending' ELSE 'failed' END AS status, CASE label WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 120 WHEN 3 THEN 300 END AS delay FROM embeddings")
def retry(r: Roles) -> DataFrame:
    status, delay = lc.retry(F.col("label"))
    return r.vectors().select("id", status.alias("status"), delay.alias("delay"))


@query("dat1_ms_or_s", "SELECT event_id AS id, CASE WHEN x > 1e10 THEN x / 1000.0 ELSE x END AS s FROM (SELECT event_id, CAST(floor(epoch(ts)) AS DOUBLE) * CASE WHEN event_type = 'view' THEN 1000 ELSE 1 END AS x FROM events)")
def ms_or_s(r: Roles) -> DataFrame:
    x = F.unix_timestamp("created_at").cast("double") * F.when(F.col("process_name") == "view", 1000).otherwise(1)
    return r.captures().select("id", dt.seconds(x).alias("s"))


@query("dat2_epoch_text", CAPS + "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS text FROM captures")
def epoch_text(r: Roles) -> DataFrame:
    return r.captures().select("id", F.from_unixtime(F.unix_timestamp("created_at")).alias("text"))


@query("dat4_retention", f"SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN {NOW} - 30 * 86400 WHEN 'MACHINERY' THEN {NOW} - 365 * 86400 END AS cutoff FROM customer")
def retention(r: Roles) -> DataFrame:
    policy = F.when(F.col("c_mktsegment") == "BUILDING", " 1Month ").when(F.col("c_mktsegment") == "MACHINERY", "1year").otherwise("never")
    return r.table("customer").select(F.col("c_custkey").alias("id"), dt.retention_cutoff(policy, F.lit(NOW)).alias("cutoff"))


@query("dat5_limit", "SELECT p_partkey AS id, CASE WHEN p_size > 0 AND p_type <> 'PROMO' THEN CAST(p_size AS BIGINT) * 1073741824 END AS bytes FROM part")
def limit(r: Roles) -> DataFrame:
    text = F.when(F.col("p_type") == "PROMO", "unlimited").otherwise(F.col("p_size").cast("string"))
    return r.table("part").select(F.col("p_partkey").alias("id"), dt.limit_bytes(text).alias("bytes"))


@query("dat7_month_key", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_key(r: Roles) -> DataFrame:
    return r.parents().groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("win1_frame_suppression")
def frame_suppression(r: Roles) -> DataFrame:
    from ..streaming.frames import suppress_redundant

    c = r.captures().select(F.col("owner").alias("stream"), "id", "created_at", F.array(F.xxhash64(F.floor(F.col("value") / 40)), F.col("k").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("hash"))
    return suppress_redundant(c, "stream", ["created_at", "id"], "hash").select("stream", "id")


