"""Timeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeline as t
from ..sources.roles import SQL_CAPTURES, Roles
from .registry import query

START, END = 1704412800, 1705276800  # 2024-01-05 and 2024-01-15
NOW = 1706659200  # 2024-01-31
RANGE = f"epoch(created_at)::DOUBLE >= {START} AND created_at <= make_timestamp({END}000000)"
RECORD = ("id", "process_name", "created_at", "category")


def secs(df: DataFrame, name: str = "created_at") -> DataFrame:
    """Times as whole epoch seconds, which compare alike everywhere."""
    return df.withColumn(name, F.unix_timestamp(name))


WITH = f"WITH {SQL_CAPTURES} "
SECS = "CAST(floor(epoch(created_at)) AS BIGINT) AS created_at"


@query("src1_range_scan", WITH + f"SELECT id, process_name, {SECS}, category FROM captures WHERE {RANGE} ORDER BY created_at, id LIMIT 500")
def range_scan(r: Roles) -> DataFrame:
    return secs(t.in_range(r.captures(), START, END).orderBy("created_at", "id").limit(500).select(*RECORD))


@query("src2_range_page", WITH + f"SELECT id, process_name, {SECS}, category FROM captures WHERE {RANGE} ORDER BY created_at, id LIMIT 50 OFFSET 100")
def range_page(r: Roles) -> DataFrame:
    return secs(t.page(t.in_range(r.captures(), START, END), ["created_at", "id"], 100, 50).select(*RECORD))


@query("src3_summary_scan", WITH + f"SELECT id, process_name, {SECS} FROM captures WHERE {RANGE}")
def summary_scan(r: Roles) -> DataFrame:
    return secs(t.in_range(r.captures(), START, END).select("id", "process_name", "created_at"))


@query("src4_multi_get", WITH + "SELECT id, process_name, category FROM captures WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def multi_get(r: Roles) -> DataFrame:
    ids = r.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return t.multi_get(r.captures(), ids).select("id", "process_name", "category")


@query("src5_summary_multi_get", WITH + "SELECT id, process_name FROM captures WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def summary_multi_get(r: Roles) -> DataFrame:
    ids = r.table("labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return t.multi_get(r.captures(), ids).select("id", "process_name")


@query("src6_point_get", WITH + f"SELECT id, process_name, {SECS}, category FROM captures WHERE id = 42")
def point_get(r: Roles) -> DataFrame:
    return secs(r.captures().filter("id = 42").select(*RECORD))


@query("src7_point_get_by_path", "SELECT page_id, url FROM pages WHERE url = (SELECT max(url) FROM pages)")
def point_get_by_path(r: Roles) -> DataFrame:
    pages = r.table("pages").select("page_id", "url")
    return pages.join(pages.agg(F.max("url").alias("url")), "url", "left_semi").select("page_id", "url")


@query("src8_boxes_of_parent", "SELECT turn AS position, role AS kind, text FROM conversations WHERE conv_id = 7")
def boxes_of_parent(r: Roles) -> DataFrame:
    return r.boxes().filter("parent_id = 7").orderBy("position").select("position", "kind", "text")


@query("src9_ids_by_hash", WITH + "SELECT image_hash, max(id) AS id FROM captures GROUP BY image_hash")
def ids_by_hash(r: Roles) -> DataFrame:
    return r.captures().groupBy("image_hash").agg(F.max("id").alias("id"))


@query("src10_newest_by_hash", WITH + "SELECT image_hash, arg_max(id, struct_pack(c := created_at, i := id)) AS newest, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS ids FROM captures GROUP BY image_hash")
def newest_by_hash(r: Roles) -> DataFrame:
    return t.newest_by(r.captures(), "image_hash").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("src11_category_by_hash", WITH + "SELECT image_hash, arg_max_null(category, id) AS category FROM captures GROUP BY image_hash")
def category_by_hash(r: Roles) -> DataFrame:
    return r.captures().groupBy("image_hash").agg(F.max_by("category", "id").alias("category"))


@query("src12_exists", WITH + "SELECT EXISTS (SELECT 1 FROM captures WHERE image_hash = md5('click/46')) AS found")
def exists(r: Roles) -> DataFrame:
    return r.captures().filter(F.col("image_hash") == F.md5(F.lit("click/46"))).limit(1).agg((F.count("*") > 0).alias("found"))


@query("src13_all_paths", "SELECT url FROM pages")
def all_paths(r: Roles) -> DataFrame:
    return r.table("pages").select("url")


@query("src14_keyset_page", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id > 99 ORDER BY vec_id LIMIT 64")
def keyset(r: Roles) -> DataFrame:
    return t.keyset_page(r.vectors().select("id", "label"), "id", 99, 64)


@query("src17_clustering_page", f"""WITH {SQL_CAPTURES}, b AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations WHERE text <> '' GROUP BY conv_id)
 SELECT c.id, c.process_name, coalesce(b.body, '') AS body, (SELECT count(*) FROM captures) AS total FROM (SELECT * FROM captures ORDER BY created_at, id LIMIT 1000) c LEFT JOIN b ON b.id = c.id""")
def clustering_page(r: Roles) -> DataFrame:
    from ..operators.text_assembly import joined_text

    shots = r.captures()
    body = joined_text(r.boxes(), "parent_id", ["position"]).withColumnRenamed("parent_id", "id")
    total = shots.agg(F.count("*").alias("total"))
    return t.page(shots, ["created_at", "id"], 0, 1000).join(body, "id", "left").crossJoin(F.broadcast(total)).select("id", "process_name", F.coalesce("body", F.lit("")).alias("body"), "total")


@query("src22_recent_vectors", "SELECT event_id AS id FROM events WHERE ts >= make_timestamp(1706054400000000)")
def recent(r: Roles) -> DataFrame:
    return r.captures().filter(F.col("created_at") >= F.timestamp_seconds(F.lit(NOW - 7 * 86400))).select("id")


@query("agg1_density", WITH + "SELECT CAST(floor(epoch(created_at) / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS n FROM captures GROUP BY 1")
def density(r: Roles) -> DataFrame:
    return t.density(r.captures(), 3600)


@query("agg2_range_count", WITH + f"SELECT count(*) AS n FROM captures WHERE {RANGE}")
def range_count(r: Roles) -> DataFrame:
    return t.in_range(r.captures(), START, END).agg(F.count("*").alias("n"))


@query("agg3_live_counts", """SELECT (SELECT count(*) FROM orders) AS parents, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS children,
 (SELECT count(DISTINCT o_custkey) FROM orders) AS distinct_hashes, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS queued""")
def live_counts(r: Roles) -> DataFrame:
    p = r.parents().agg(F.count("*").alias("parents"), F.countDistinct("owner").alias("distinct_hashes"), F.count_if(F.col("status") == "P").alias("pending"))
    c = r.children().agg(F.count_if(~F.col("is_deleted")).alias("children"), F.count_if("is_deleted").alias("queued"))
    return p.crossJoin(c)


@query("agg4_process_counts", WITH + "SELECT process_name, count(*) AS n FROM captures WHERE trim(process_name) <> '' GROUP BY 1")
def process_counts(r: Roles) -> DataFrame:
    return t.process_counts(r.captures()).orderBy(F.desc("n"), F.lower("process_name"))


@query("agg5_process_share", WITH + "SELECT process_name, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM captures), 6) AS percent FROM captures GROUP BY 1")
def process_share(r: Roles) -> DataFrame:
    return t.process_share(r.captures()).withColumn("percent", F.round("percent", 6))


@query("agg6_categories", WITH + "SELECT DISTINCT category FROM captures WHERE category <> ''")
def categories(r: Roles) -> DataFrame:
    return r.captures().filter("category <> ''").select("category").distinct().orderBy("category")


@query("agg7_monthly_page", WITH + "SELECT id, strftime(created_at, '%Y-%m') AS month, (SELECT count(*) FROM captures WHERE process_name = 'view') AS total FROM captures WHERE process_name = 'view' ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 200")
def monthly_page(r: Roles) -> DataFrame:
    own = r.captures().filter("process_name = 'view'")
    total = own.agg(F.count("*").alias("total"))
    return t.page(own, [F.desc("created_at"), F.desc("id")], 200, 200).select("id", t.monthly(own).alias("month")).crossJoin(F.broadcast(total))


@query("agg26_top_and_others", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rn FROM c) SELECT CASE WHEN rn <= 8 THEN source ELSE 'others' END AS process_name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def top_and_others(r: Roles) -> DataFrame:
    return t.top_and_others(t.process_counts(r.texts()), "process_name", "n")


@query("win3_even_sample", f"""WITH {SQL_CAPTURES}, o AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS row, count(*) OVER () AS n FROM captures)
 SELECT id FROM o WHERE row IN (SELECT CAST(floor(i * ((SELECT max(n) FROM o) - 1) / 99.0) AS BIGINT) FROM range(100) t(i))""")
def even_sample(r: Roles) -> DataFrame:
    return t.evenly_spaced(r.captures().select("id", "created_at"), 100, ["created_at", "id"]).select("id")


@query("win4_reclaim", WITH + """, o AS (SELECT id, value, created_at FROM captures WHERE value > 0 ORDER BY created_at, id LIMIT 20000),
 w AS (SELECT id, coalesce(sum(value) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o) SELECT id FROM w WHERE b < 12345.5""")
def reclaim(r: Roles) -> DataFrame:
    return t.reclaim_until(r.captures(), 12345.5, "value", ["created_at", "id"]).select("id")


@query("win6_rolling_window", WITH + "SELECT id, value FROM captures WHERE created_at >= (SELECT max(created_at) - INTERVAL 30 MINUTE FROM captures)")
def rolling_window(r: Roles) -> DataFrame:
    shots = r.captures()
    last = shots.agg((F.max("created_at") - F.expr("INTERVAL 30 MINUTES")).alias("cutoff"))
    return shots.join(F.broadcast(last), F.col("created_at") >= F.col("cutoff")).select("id", "value")


@query("top5_relevance", f"""WITH t AS (SELECT user_id AS task, count(*) AS n, min(epoch(ts)) AS s, max(epoch(ts)) AS e FROM events GROUP BY 1)
 SELECT task, round(n * least(greatest((e - s) / 3600.0, 0.0), 720.0) / 720.0 / (greatest(({NOW} - e) / 3600.0, 0.0) + 1.0), 6) AS score FROM t""")
def relevance(r: Roles) -> DataFrame:
    e = F.col("created_at").cast("double")
    tasks = r.captures().groupBy(F.col("owner").alias("task")).agg(F.count("*").alias("n"), F.min(e).alias("s"), F.max(e).alias("e"))
    return tasks.select("task", F.round(t.relevance(F.col("n"), F.col("s"), F.col("e"), NOW), 6).alias("score")).orderBy(F.desc("score"), "task")


@query("top9_fifo_peek", WITH + f"SELECT id FROM captures WHERE epoch(created_at) >= {NOW} - 20 * 86400 ORDER BY created_at, id LIMIT 128")
def fifo_peek(r: Roles) -> DataFrame:
    return t.page(r.captures().filter(F.col("created_at").cast("double") >= NOW - 20 * 86400), ["created_at", "id"], 0, 128).select("id")


@query("top10_expired", WITH + "SELECT id FROM captures WHERE created_at < TIMESTAMP '2024-01-08 00:00:00' ORDER BY created_at, id LIMIT 20000")
def expired(r: Roles) -> DataFrame:
    return t.older_than(r.captures(), "2024-01-08 00:00:00", 20_000).select("id")


@query("top11_skip_take", WITH + "SELECT id FROM captures ORDER BY value DESC, id LIMIT 20 OFFSET 30")
def skip_take(r: Roles) -> DataFrame:
    return t.page(r.captures(), [F.desc("value"), "id"], 30, 20).select("id")


@query("top12_numeric_first", "SELECT id, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(id, '[1-9][0-9]*') THEN 0 ELSE 1 END, TRY_CAST(id AS BIGINT), id) AS place FROM (SELECT DISTINCT json_extract_string(props, '$.k') AS id FROM events UNION SELECT DISTINCT event_type FROM events)")
def numeric_first(r: Roles) -> DataFrame:
    from pyspark.sql import Window

    shots = r.captures()
    ids = shots.select(F.col("k").cast("string").alias("id")).union(shots.select("process_name")).distinct()
    number = F.col("id").rlike("^[1-9][0-9]*$")
    return ids.select("id", F.row_number().over(Window.orderBy(F.when(number, 0).otherwise(1), F.when(number, F.col("id").cast("long")), "id")).alias("place"))


@query("top14_timeline_merge", WITH + "SELECT image_hash, arg_max(id, id) AS id FROM captures WHERE process_name <> 'view' GROUP BY 1 UNION ALL SELECT image_hash, max(id) FROM captures WHERE process_name = 'view' GROUP BY 1")
def timeline_merge(r: Roles) -> DataFrame:
    shots = r.captures()
    new = shots.filter("process_name = 'view'").groupBy("image_hash").agg(F.max("id").alias("id"))
    old = shots.groupBy("image_hash").agg(F.max("id").alias("id"))
    return t.merge_timelines(new, old, "image_hash")


@query("fil1_optional_filters", WITH + "SELECT id FROM captures WHERE (category IS NULL OR category NOT IN ('social')) AND process_name = 'click'")
def optional_filters(r: Roles) -> DataFrame:
    keep = t.any_of(category=t.not_in(F.col("category"), ["social"]), process=F.col("process_name") == "click", owner=None)
    return r.captures().filter(keep).select("id")


@query("fil2_unknown_times_kept", WITH + f"SELECT id FROM captures WHERE process_name IN ('view', 'click') AND (k >= 90 OR epoch(created_at) BETWEEN {START} AND {END})")
def unknown_times_kept(r: Roles) -> DataFrame:
    ts = F.when(F.col("k") < 90, F.col("created_at").cast("double"))
    return r.captures().filter(F.col("process_name").isin("view", "click") & t.known_in_range(ts, START, END)).select("id")


@query("fil3_filter_after_page", WITH + "SELECT id FROM (SELECT * FROM captures ORDER BY id DESC LIMIT 100) WHERE process_name = 'purchase'")
def filter_after_page(r: Roles) -> DataFrame:
    return t.page(r.captures(), [F.desc("id")], 0, 100).filter("process_name = 'purchase'").select("id")
