"""Join, set and aggregate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relations as rel
from ..operators.text_assembly import first_texts, joined_text, text_prefix
from ..sources.roles import SQL_BOXES, SQL_CAPTURES, SQL_CHILDREN, SQL_PARENTS, Roles
from .registry import query

BOTH = f"WITH {SQL_PARENTS}, {SQL_CHILDREN} "
CAPS = f"WITH {SQL_CAPTURES} "
CUTOFF = "1998-01-01 00:00:00"
NOW = 1706659200


def kids(r: Roles) -> DataFrame:
    return r.children().filter("NOT is_deleted")


@query("joi1_parent_child", BOTH + "SELECT p.id, c.position, c.part FROM children c JOIN parents p ON c.parent_id = p.id WHERE NOT c.is_deleted")
def parent_child(r: Roles) -> DataFrame:
    p = r.parents()
    return kids(r).join(p, F.col("parent_id") == p["id"]).select("id", "position", "part")


@query("joi2_left_enrich", "SELECT c_custkey AS id, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END, n_name) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_enrich(r: Roles) -> DataFrame:
    c = r.table("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).alias("label"))
    return rel.enrich(c, r.table("nation"), "c_nationkey", "n_nationkey", "label", "n_name").select("id", "label")


def ledger(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents and the jobs that labels stand for."""
    docs = r.table("documents").select(F.lit("text").alias("index_kind"), F.col("doc_id").cast("string").alias("subject_key"), F.lit("m1").alias("model_id"), F.lit("r1").alias("model_revision"), F.lit(1).alias("embedding_version"), F.md5("text").alias("source_fingerprint"), "n_chars")
    done = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("pending")
    jobs = r.table("labels").join(r.table("documents").select("doc_id", "text", "n_chars", "source"), "doc_id").select(
        F.lit("text").alias("index_kind"), F.col("doc_id").cast("string").alias("subject_key"), F.lit("m1").alias("model_id"), F.lit("r1").alias("model_revision"), F.lit(1).alias("embedding_version"),
        F.when(F.col("n_chars") > 200, F.md5("text")).otherwise("stale").alias("source_fingerprint"), done.alias("status"),
        (F.length("source") - 3).alias("attempts"), F.timestamp_seconds(F.lit(NOW) - F.col("n_chars")).alias("updated_at"),
        F.when(F.col("n_chars") > 3000, F.timestamp_seconds(F.lit(NOW) + 60)).alias("next_retry_at"),
    )
    return docs, jobs


SQL_LEDGER = f"""WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS subject_key, md5(text) AS fp, n_chars FROM documents),
 jobs AS (SELECT CAST(l.doc_id AS VARCHAR) AS subject_key, CASE WHEN n_chars > 200 THEN md5(text) ELSE 'stale' END AS fp,
   CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS status, length(source) - 3 AS attempts,
   {NOW} - n_chars AS updated_at, CASE WHEN n_chars > 3000 THEN {NOW} + 60 END AS next_retry_at FROM labels l JOIN documents d ON l.doc_id = d.doc_id) """


@query("joi3_visible", SQL_LEDGER + "SELECT d.subject_key, d.n_chars FROM docs d JOIN jobs j ON d.subject_key = j.subject_key AND d.fp = j.fp WHERE j.status = 'completed'")
def visible(r: Roles) -> DataFrame:
    return rel.visible(*ledger(r)).select("subject_key", "n_chars")


@query("agg14_cache_admission", SQL_LEDGER + "SELECT count(*) AS n, CAST(sum(strlen(d.subject_key)) AS BIGINT) AS key_bytes FROM docs d JOIN jobs j ON d.subject_key = j.subject_key AND d.fp = j.fp WHERE j.status = 'completed'")
def cache_admission(r: Roles) -> DataFrame:
    return rel.visible(*ledger(r)).agg(F.count("*").alias("n"), F.sum(F.octet_length("subject_key")).alias("key_bytes"))


@query("agg10_backlog", SQL_LEDGER + f"SELECT count(*) FILTER (WHERE status = 'pending' OR (status = 'failed' AND attempts < 2)) AS claimable, count(*) FILTER (WHERE status = 'failed' AND attempts >= 2) AS exhausted, {NOW} - min(CASE WHEN status = 'pending' OR (status = 'failed' AND attempts < 2) THEN updated_at END) AS oldest_age FROM jobs")
def backlog(r: Roles) -> DataFrame:
    return rel.backlog(ledger(r)[1], 2, F.lit(NOW))


@query("fil9_claimable", SQL_LEDGER + f"SELECT subject_key FROM jobs WHERE (status = 'pending' OR (status = 'failed' AND attempts < 2)) AND (next_retry_at IS NULL OR next_retry_at <= {NOW}) ORDER BY updated_at, subject_key LIMIT 32")
def claimable(r: Roles) -> DataFrame:
    return rel.claimable_jobs(ledger(r)[1], 2, F.timestamp_seconds(F.lit(NOW)), 32).select("subject_key")


@query("src24_ledger_page", SQL_LEDGER + "SELECT subject_key, status FROM jobs WHERE status = 'failed' ORDER BY updated_at, subject_key LIMIT 25 OFFSET 5")
def ledger_page(r: Roles) -> DataFrame:
    return ledger(r)[1].filter("status = 'failed'").orderBy("updated_at", "subject_key").offset(5).limit(25).select("subject_key", "status")


@query("joi4_semi_count", BOTH + "SELECT count(DISTINCT owner) AS n FROM parents p WHERE EXISTS (SELECT 1 FROM children c WHERE c.parent_id = p.id AND NOT c.is_deleted)")
def semi_count(r: Roles) -> DataFrame:
    p = r.parents()
    return p.join(kids(r), p["id"] == F.col("parent_id"), "left_semi").agg(F.countDistinct("owner").alias("n"))


@query("joi5_semi_list", BOTH + "SELECT DISTINCT owner FROM parents p WHERE EXISTS (SELECT 1 FROM children c WHERE c.parent_id = p.id AND NOT c.is_deleted)")
def semi_list(r: Roles) -> DataFrame:
    p = r.parents()
    return p.join(kids(r), p["id"] == F.col("parent_id"), "left_semi").select("owner").distinct()


@query("joi6_repair_text", BOTH + f"SELECT id FROM parents p WHERE created_at >= TIMESTAMP '{CUTOFF}' AND EXISTS (SELECT 1 FROM children c WHERE c.parent_id = p.id AND NOT c.is_deleted) AND NOT EXISTS (SELECT 1 FROM labels WHERE CAST(doc_id AS VARCHAR) = CAST(p.id AS VARCHAR)) ORDER BY created_at DESC, id DESC LIMIT 500")
def repair_text(r: Roles) -> DataFrame:
    done = r.table("labels").select(F.col("doc_id").cast("string").alias("subject_key"))
    out = rel.repair_candidates(r.parents(), kids(r), done, "id", F.lit(CUTOFF).cast("timestamp"))
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(500).select("id")


@query("joi7_repair_image", BOTH + "SELECT DISTINCT owner FROM parents p WHERE EXISTS (SELECT 1 FROM children c WHERE c.parent_id = p.id AND NOT c.is_deleted) AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = p.owner)")
def repair_image(r: Roles) -> DataFrame:
    done = r.table("labels").select(F.col("doc_id").cast("string").alias("subject_key"))
    p = r.parents()
    owned = p.join(kids(r), p["id"] == F.col("parent_id"), "left_semi").select("owner").distinct()
    return owned.join(done, owned["owner"].cast("string") == done["subject_key"], "left_anti")


@query("joi8_expired", BOTH + f"SELECT s.k AS subject_key FROM (SELECT CAST(doc_id AS VARCHAR) AS k FROM labels UNION SELECT CAST(vec_id * 40 AS VARCHAR) FROM embeddings) s LEFT JOIN parents p ON CAST(p.id AS VARCHAR) = s.k WHERE p.id IS NULL OR p.created_at < TIMESTAMP '{CUTOFF}'")
def expired(r: Roles) -> DataFrame:
    subjects = r.table("labels").select(F.col("doc_id").cast("string").alias("subject_key")).union(r.vectors().select((F.col("id") * 40).cast("string")))
    return rel.expired_subjects(subjects, r.parents(), F.lit(CUTOFF).cast("timestamp"))


@query("joi9_orphans", "SELECT k AS subject_key FROM (SELECT doc_id AS k FROM labels UNION SELECT vec_id * 3 FROM embeddings) WHERE k NOT IN (SELECT doc_id FROM documents)")
def orphans(r: Roles) -> DataFrame:
    subjects = r.table("labels").select(F.col("doc_id").alias("subject_key")).union(r.vectors().select((F.col("id") * 3).alias("subject_key"))).distinct()
    return subjects.join(r.table("documents"), F.col("subject_key") == F.col("doc_id"), "left_anti")


@query("joi10_out_of_scope", "SELECT e.event_id AS id FROM events e WHERE e.user_id NOT IN (SELECT doc_id FROM labels) AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def out_of_scope(r: Roles) -> DataFrame:
    c = r.captures().filter(F.col("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return c.join(r.table("labels"), F.col("owner") == F.col("doc_id"), "left_anti").select("id")


@query("joi12_nearest_in_time", CAPS + """, p AS (SELECT a.id, b.id AS other, abs(epoch(b.created_at) - epoch(a.created_at)) AS gap, b.created_at AS bt,
  CASE WHEN b.created_at < a.created_at THEN 'before' WHEN b.created_at > a.created_at THEN 'after' ELSE 'nearby' END AS relation FROM captures a JOIN captures b ON a.owner = b.owner AND a.id <> b.id),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, bt DESC, other) AS place FROM p) SELECT id, other, relation, round(gap, 3) AS gap, place FROM o WHERE place <= 3""")
def nearest_in_time(r: Roles) -> DataFrame:
    return rel.nearest_in_time(r.captures(), "owner", "created_at", "id", 3).withColumn("gap", F.round("gap", 3))


@query("joi13_max_child", BOTH + "SELECT c.parent_id, c.position, c.part FROM children c WHERE c.position = (SELECT max(d.position) FROM children d WHERE d.parent_id = c.parent_id)")
def max_child(r: Roles) -> DataFrame:
    c = r.children()
    top = c.groupBy(F.col("parent_id").alias("_p")).agg(F.max("position").alias("_m"))
    return c.join(top, (F.col("parent_id") == F.col("_p")) & (F.col("position") == F.col("_m"))).select("parent_id", "position", "part")


@query("joi14_count_subquery", BOTH + "SELECT p.id, (SELECT count(*) FROM children c WHERE c.parent_id = p.id AND NOT c.is_deleted) AS n FROM parents p")
def count_subquery(r: Roles) -> DataFrame:
    n = kids(r).groupBy("parent_id").agg(F.count("*").alias("n"))
    p = r.parents()
    return p.join(n, p["id"] == F.col("parent_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("joi15_score_order_page", BOTH + "SELECT p.id, c.position, c.size FROM children c JOIN parents p ON c.parent_id = p.id WHERE c.part = 16 AND NOT c.is_deleted ORDER BY c.size DESC, p.id, c.position LIMIT 20 OFFSET 2")
def score_order_page(r: Roles) -> DataFrame:
    p = r.parents()
    j = kids(r).filter("part = 16").join(p, F.col("parent_id") == p["id"])
    return j.orderBy(F.desc("size"), "id", "position").offset(2).limit(20).select("id", "position", "size")


@query("joi16_cluster_corpus", f"WITH {SQL_BOXES} SELECT e.vec_id AS id, coalesce(b.body, '') AS body FROM embeddings e LEFT JOIN (SELECT parent_id, string_agg(text, ' ' ORDER BY position) AS body FROM boxes WHERE text <> '' GROUP BY 1) b ON b.parent_id = e.vec_id WHERE e.label = 3")
def cluster_corpus(r: Roles) -> DataFrame:
    body = joined_text(r.boxes(), "parent_id", ["position"])
    v = r.vectors().filter("label = 3")
    return v.join(body, v["id"] == F.col("parent_id"), "left").select("id", F.coalesce("body", F.lit("")).alias("body"))


@query("joi17_task_members", CAPS + "SELECT id, floor(epoch(created_at))::BIGINT AS created_at FROM captures WHERE owner = 7 ORDER BY created_at DESC, id DESC LIMIT 30")
def task_members(r: Roles) -> DataFrame:
    return r.captures().filter("owner = 7").orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", F.unix_timestamp("created_at").alias("created_at"))


@query("joi20_compare_totals", """WITH a AS (SELECT event_type AS g, user_id AS p, sum(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1, 2), b AS (SELECT event_type AS g, user_id AS p, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1, 2),
 j AS (SELECT coalesce(a.g, b.g) AS process_name, coalesce(a.p, b.p) AS owner, coalesce(a.v, 0) AS baseline, coalesce(b.v, 0) AS workload FROM a FULL OUTER JOIN b ON a.g = b.g AND a.p = b.p)
 SELECT process_name, owner, round(baseline, 6) AS baseline, round(workload, 6) AS workload, round(baseline / 864000.0, 6) AS baseline_rate, round(workload / 1728000.0, 6) AS workload_rate, CAST(floor(round(greatest(workload / 1728000.0 - baseline / 864000.0, 0) * 864000.0, 6)) AS BIGINT) AS excess FROM j""")
def compare_totals(r: Roles) -> DataFrame:
    c, split = r.captures(), F.lit("2024-01-11 00:00:00").cast("timestamp")
    a, b = c.filter(F.col("created_at") < split), c.filter(F.col("created_at") >= split)
    x = a.groupBy("process_name", "owner").agg(F.sum("value").alias("baseline"))
    y = b.groupBy("process_name", "owner").agg(F.sum("value").alias("workload"))
    j = x.join(y, ["process_name", "owner"], "full_outer").select("process_name", "owner", F.coalesce("baseline", F.lit(0.0)).alias("u"), F.coalesce("workload", F.lit(0.0)).alias("w"))
    excess = F.floor(F.round(F.greatest(F.col("w") / 1728000.0 - F.col("u") / 864000.0, F.lit(0.0)) * 864000.0, 6)).cast("long")
    return j.select("process_name", "owner", *rel.metric_delta(F.col("u"), F.col("w"), 864000.0, 1728000.0)[:4], excess.alias("excess")).withColumns({k: F.round(k, 6) for k in ("baseline", "workload")})


@query("joi22_monotone_delta", "WITH d AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2) SELECT b.user_id AS owner, b.day, CASE WHEN b.v >= a.v THEN round(b.v - a.v, 2) END AS delta FROM d b LEFT JOIN d a ON a.user_id = b.user_id AND a.day = b.day - 1")
def monotone_delta(r: Roles) -> DataFrame:
    d = r.captures().groupBy("owner", F.floor(F.unix_timestamp("created_at") / 86400).alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))
    before = d.select(F.col("owner").alias("_o"), (F.col("day") + 1).alias("_d"), F.col("v").alias("_v"))
    return d.join(before, (F.col("owner") == F.col("_o")) & (F.col("day") == F.col("_d")), "left").select("owner", "day", F.round(rel.monotone_delta(F.col("_v"), F.col("v")), 2).alias("delta"))


@query("joi28_speed_up", "WITH a AS (SELECT l_linenumber AS size, quantile_cont(l_extendedprice, 0.5) AS p FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_linenumber AS size, quantile_cont(l_extendedprice, 0.5) AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT a.size, round(a.p / nullif(b.p, 0), 6) AS speed_up FROM a JOIN b ON a.size = b.size")
def speed_up(r: Roles) -> DataFrame:
    li = r.table("lineitem")
    p = {s: li.filter(F.col("l_linestatus") == s).groupBy(F.col("l_linenumber").alias("size")).agg(F.percentile("l_extendedprice", F.lit(0.5)).alias(s)) for s in ("O", "F")}
    return p["O"].join(p["F"], "size").select("size", F.round(F.try_divide("O", "F"), 6).alias("speed_up"))


@query("agg8_joined_text", f"WITH {SQL_BOXES} SELECT parent_id, string_agg(text, ' ' ORDER BY position) AS body FROM boxes WHERE text <> '' GROUP BY 1")
def joined(r: Roles) -> DataFrame:
    return joined_text(r.boxes(), "parent_id", ["position"])


@query("agg9_text_prefix", f"WITH {SQL_BOXES}, w AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY parent_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM boxes WHERE text <> '') SELECT parent_id, string_agg(text, ' ' ORDER BY position) AS body FROM w WHERE b < 600 GROUP BY 1")
def prefix(r: Roles) -> DataFrame:
    return text_prefix(r.boxes(), "parent_id", ["position"], 600)


@query("gra5_first_texts", "WITH e AS (SELECT doc_id, 0 AS n, trim(source) AS text FROM documents UNION ALL SELECT doc_id, 1, substr(text, 1, 200) FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, n) AS p FROM e WHERE trim(text) <> '') SELECT text, doc_id AS first_row FROM k WHERE p = 1")
def firsts(r: Roles) -> DataFrame:
    return first_texts(r.table("documents"), "doc_id", "source", "text")


@query("agg11_backfill_work", "SELECT count(*) AS images, round(sum(CASE WHEN o_orderstatus = 'P' THEN 2.0736 ELSE o_totalprice / 1e6 END), 6) AS megapixels FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = o_orderkey)")
def backfill_work(r: Roles) -> DataFrame:
    p = r.parents()
    left = p.join(r.children(), p["id"] == F.col("parent_id"), "left_semi").join(r.table("labels"), p["id"] == F.col("doc_id"), "left_anti")
    return left.agg(F.count("*").alias("images"), F.round(F.sum(F.when(F.col("status") == "P", 2.0736).otherwise(F.col("weight") / 1e6)), 6).alias("megapixels"))


@query("agg12_census", "SELECT o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1")
def census(r: Roles) -> DataFrame:
    return r.table("orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))


@query("agg17_totals_by_keys", "SELECT event_type AS process_name, user_id AS owner, CAST(grouping(event_type, user_id) AS BIGINT) AS level, round(sum(value), 4) AS bytes, count(*) AS events FROM events GROUP BY GROUPING SETS ((event_type, user_id), (event_type), (user_id), ())")
def totals_by_keys(r: Roles) -> DataFrame:
    c = r.captures()
    c.createOrReplaceTempView("_captures_totals")
    return r.spark.sql("SELECT process_name, owner, CAST(grouping_id() AS BIGINT) AS level, round(sum(value), 4) AS bytes, count(*) AS events FROM _captures_totals GROUP BY GROUPING SETS ((process_name, owner), (process_name), (owner), ())")


@query("agg18_counter_totals", CAPS + ", d AS (SELECT process_name, greatest(value - lag(value) OVER (PARTITION BY owner ORDER BY created_at, id), 0) AS delta FROM captures) SELECT process_name, round(sum(delta), 4) AS total FROM d GROUP BY 1")
def counter_totals(r: Roles) -> DataFrame:
    w = Window.partitionBy("owner").orderBy("created_at", "id")
    step = F.col("value") - F.lag("value").over(w)
    delta = F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))).otherwise(F.lit(0.0))
    return r.captures().withColumn("delta", delta).groupBy("process_name").agg(F.round(F.sum("delta"), 4).alias("total"))


@query("agg20_percentiles", "SELECT event_type AS process_name, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY 1")
def percentiles(r: Roles) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = r.captures().groupBy("process_name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p.alias("p"), F.max("value").alias("most"))
    return g.select("process_name", "n", "mean", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("p50", "p95", "p99"))], "most")


@query("agg22_wear_estimate", "WITH b AS (SELECT event_type AS basis, sum(value) AS bytes FROM events GROUP BY 1) SELECT basis, w.waf, round(bytes * w.waf, 4) AS bytes, round(bytes * w.waf / 1e6 * 100, 6) AS percent FROM b, (SELECT unnest([1.0, 1.5, 2.0, 3.0]) AS waf) w")
def wear_estimate(r: Roles) -> DataFrame:
    b = r.captures().groupBy(F.col("process_name").alias("basis")).agg(F.sum("value").alias("bytes"))
    w = b.withColumn("waf", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0, 3.0)])))
    return w.select("basis", "waf", F.round(F.col("bytes") * F.col("waf"), 4).alias("bytes"), F.round(F.col("bytes") * F.col("waf") / 1e6 * 100, 6).alias("percent"))


@query("agg25_first_wins_mode", CAPS + ", c AS (SELECT owner, process_name, count(*) AS n, min(id) AS f FROM captures GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, f) AS p FROM c) SELECT owner, process_name, n FROM o WHERE p = 1")
def first_wins_mode(r: Roles) -> DataFrame:
    return rel.first_wins_mode(r.captures(), "owner", "process_name", "id")


@query("agg28_nested_sum", "SELECT round(sum(v), 4) AS total FROM (SELECT event_type, sum(value) AS v FROM events WHERE event_type <> 'view' GROUP BY 1)")
def nested_sum(r: Roles) -> DataFrame:
    return r.captures().filter("process_name <> 'view'").groupBy("process_name").agg(F.sum("value").alias("v")).agg(F.round(F.sum("v"), 4).alias("total"))


@query("set4_union", "SELECT doc_id AS k FROM labels UNION SELECT vec_id FROM embeddings")
def union(r: Roles) -> DataFrame:
    return r.table("labels").select(F.col("doc_id").alias("k")).union(r.vectors().select("id")).distinct()


@query("set6_key_union", "SELECT coalesce(a.k, b.k) AS k, a.n AS old, b.n AS new FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'view' AND value > 100 GROUP BY 1) a FULL OUTER JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'click' AND value > 100 GROUP BY 1) b ON a.k = b.k")
def key_union(r: Roles) -> DataFrame:
    big = r.captures().filter("value > 100")
    a = big.filter("process_name = 'view'").groupBy(F.col("owner").alias("k")).agg(F.count("*").alias("old"))
    b = big.filter("process_name = 'click'").groupBy(F.col("owner").alias("k")).agg(F.count("*").alias("new"))
    return a.join(b, "k", "full_outer")


@query("gra1_children_map", BOTH + "SELECT owner, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM parents GROUP BY 1")
def children_map(r: Roles) -> DataFrame:
    return r.parents().groupBy("owner").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("gra4_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('seed-42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 64")
def seeded_sample(r: Roles) -> DataFrame:
    return r.table("documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("seed-42-"), F.col("doc_id").cast("string")), 256), "doc_id").limit(64)
