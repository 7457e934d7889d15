"""Ledger transitions, keyed replaces, title rules, and redacted retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import privacy as pv
from ..functions import text as tx
from ..functions.vector import threshold
from ..operators import ledger as lg
from ..operators import relations as rel
from ..sources.roles import SQL_CAPTURES, SQL_VECTORS, Roles
from .privacy import HIT, WORDS
from .registry import query
from .relations import NOW, SQL_LEDGER, ledger

CAPS = f"WITH {SQL_CAPTURES} "
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
MASKS = "regexp_replace(regexp_replace(regexp_replace({}, '(?i)credit card', repeat('█', 11), 'g'), '(?i)worthless', repeat('█', 9), 'g'), '(?i)password', repeat('█', 8), 'g')"
KEEP = f"NOT {HIT}"


def titles(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# Readers


@query("src25_single_visible", SQL_LEDGER + "SELECT d.subject_key, d.n_chars FROM docs d JOIN jobs j ON d.subject_key = j.subject_key AND d.fp = j.fp WHERE j.status = 'completed' AND d.subject_key = '7'")
def single_visible(r: Roles) -> DataFrame:
    return rel.visible(*ledger(r)).filter("subject_key = '7'").select("subject_key", "n_chars")


@query("src26_current_generation", "SELECT n_nationkey AS kind, n_regionkey % 2 AS epoch FROM nation LEFT JOIN region ON r_regionkey = n_nationkey WHERE n_regionkey % 2 = coalesce(r_regionkey % 2, 0)")
def current_generation(r: Roles) -> DataFrame:
    manifest = r.table("nation").select(F.col("n_nationkey").alias("kind"), (F.col("n_regionkey") % 2).alias("epoch"))
    epochs = r.table("region").select(F.col("r_regionkey").alias("kind"), (F.col("r_regionkey") % 2).alias("epoch"))
    return lg.current_generations(manifest, epochs)


@query("src30_cluster_by_id", "SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT min(text) FROM documents WHERE doc_id = c_custkey) AS summary FROM customer WHERE c_custkey = 7")
def cluster_by_id(r: Roles) -> DataFrame:
    c = r.table("customer").filter("c_custkey = 7").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    n = r.parents().groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("n"))
    s = r.texts().groupBy("id").agg(F.min("text").alias("summary"))
    return c.join(n, "id", "left").join(s, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), "summary")


def examples(r: Roles) -> DataFrame:
    v = r.vectors()
    return v.select(F.col("label").alias("cluster_id"), "id", (F.col("id") % 3 != 0).alias("is_positive"), F.round(F.col("vector")[0].cast("double"), 5).alias("score"))


SQL_EXAMPLES = f"WITH {SQL_VECTORS}, examples AS (SELECT label AS cluster_id, id, id % 3 <> 0 AS is_positive, round(vector[1], 5) AS score FROM vectors) "


@query("src32_cluster_examples", SQL_EXAMPLES + "SELECT * FROM examples WHERE cluster_id = 3")
def cluster_examples(r: Roles) -> DataFrame:
    return examples(r).filter("cluster_id = 3")


@query("clu13_cold_list", "SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 06:00:00'")
def cold_list(r: Roles) -> DataFrame:
    old = F.max("created_at") < F.lit("2024-01-30 06:00:00").cast("timestamp")
    return r.captures().groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("n"), old.alias("cold")).filter("cold").drop("cold")


@query("top15_first_parsed", "WITH m AS (SELECT l_orderkey AS k, min(l_linenumber) FILTER (WHERE l_returnflag <> 'N') AS m FROM lineitem GROUP BY 1) SELECT l_orderkey AS task, min(l_partkey) FILTER (WHERE l_returnflag <> 'N' AND l_linenumber = m) AS value, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linenumber < coalesce(m, 99)) AS errors FROM lineitem JOIN m ON k = l_orderkey GROUP BY 1")
def first_parsed(r: Roles) -> DataFrame:
    tries = r.table("lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("at"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("value"))
    return lg.first_parsed(tries, "task", "at", "value")


@query("top13_image_page", f"WITH {SQL_CAPTURES}, h AS (SELECT id, created_at, process_name, round(value, 2) AS score FROM captures ORDER BY round(value, 2) DESC, id LIMIT 100), f AS (SELECT * FROM h WHERE process_name IN ('view', 'click') AND (created_at >= TIMESTAMP '2024-01-05 00:00:00' OR id % 5 = 0)) SELECT id, score FROM f ORDER BY score DESC, id LIMIT 20 OFFSET 5")
def image_page(r: Roles) -> DataFrame:
    from ..operators.vectors import overfetch_page

    c = r.captures().select("id", F.concat(F.lit(" "), "process_name").alias("process_name"), F.when(F.col("id") % 5 == 0, "unreadable").otherwise(F.col("created_at").cast("string")).alias("taken"), F.round("value", 2).alias("score"))
    hits = c.orderBy(F.desc("score"), "id").limit(100)
    at = F.col("taken").try_cast("timestamp")
    keep = F.trim("process_name").isin("view", "click") & (at.isNull() | (at >= F.lit("2024-01-05 00:00:00").cast("timestamp")))
    return overfetch_page(hits, keep, 40 - 35, 20 + 25).limit(20).select("id", "score")


# Writers


@query("snk2_pending_insert", CAPS + ", old AS (SELECT image_hash, min(id) AS d FROM captures WHERE k < 10 AND value <= 30 GROUP BY 1), new AS (SELECT image_hash, min(id) AS f FROM captures WHERE k >= 10 GROUP BY 1), j AS (SELECT id, coalesce(d, CASE WHEN f <> id THEN f END) AS duplicate_of FROM captures JOIN new USING (image_hash) LEFT JOIN old USING (image_hash) WHERE k >= 10) SELECT id, CASE WHEN duplicate_of IS NULL THEN 'pending' ELSE 'duplicate' END AS status, duplicate_of FROM j")
def pending_insert(r: Roles) -> DataFrame:
    c = r.captures().withColumn("is_deleted", F.col("value") > 30)
    return lg.pending_insert(c.filter("k < 10"), c.filter("k >= 10"))


@query("snk4_abort_pending", SQL_LEDGER + "SELECT subject_key, CASE WHEN status = 'pending' AND attempts > 2 THEN 'aborted' ELSE status END AS status FROM jobs")
def abort_pending(r: Roles) -> DataFrame:
    return lg.aborted(ledger(r)[1], F.col("attempts") > 2).select("subject_key", "status")


@query("snk15_inline_to_ids", "WITH c AS (SELECT sha256(text) AS h, min(conv_id * 1000 + turn) AS content_id FROM conversations GROUP BY 1) SELECT conv_id, turn, content_id FROM conversations JOIN c ON h = sha256(text)")
def inline_to_ids(r: Roles) -> DataFrame:
    from ..operators.lifecycle import content_ids

    b = r.table("conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    ids = content_ids(b, F.col("text")).withColumnRenamed("id", "content_id")
    return b.withColumn("content_hash", F.sha2("text", 256)).join(ids, "content_hash").select("conv_id", "turn", "content_id")


@query("snk19_summary_upsert", "WITH old AS (SELECT doc_id AS id, source AS title, lang AS summary FROM documents WHERE doc_id < 150), new AS (SELECT page_id AS id, url AS title, CAST(NULL AS VARCHAR) AS summary FROM pages WHERE page_id % 3 <> 0 AND page_id IN (SELECT c_custkey FROM customer)) SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def summary_upsert(r: Roles) -> DataFrame:
    old = r.texts().filter("id < 150").select("id", F.col("process_name").alias("title"), F.col("category").alias("summary"), F.lit(None).cast("string").alias("ocr_summary"))
    new = r.table("pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 != 0, F.col("url")).otherwise("  ").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("").alias("ocr_summary"))
    return lg.upserted_summaries(old, new, r.table("customer").select(F.col("c_custkey").alias("id"))).select("id", "title", "summary")


@query("snk20_hot_replace", "SELECT user_id AS task, 'cold' AS layer, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 UNION ALL SELECT o_custkey, 'hot', count(*) FROM orders GROUP BY 1")
def hot_replace(r: Roles) -> DataFrame:
    layer = F.when(F.col("process_name") == "error", "cold").otherwise("hot")
    old = r.captures().groupBy(F.col("owner").alias("task"), layer.alias("layer")).agg(F.count("*").alias("n"))
    new = r.parents().groupBy(F.col("owner").alias("task")).agg(F.count("*").alias("n")).select("task", F.lit("hot").alias("layer"), "n")
    return lg.replaced(old, new, r.spark.createDataFrame([("hot",)], "layer string"), "layer").select("task", "layer", "n")


@query("snk23_task_edits", "SELECT c_custkey AS id, coalesce(min(text), c_name) AS label FROM customer LEFT JOIN documents ON doc_id = c_custkey AND source = 'src1' WHERE c_custkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY c_custkey, c_name")
def task_edits(r: Roles) -> DataFrame:
    tasks = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    renamed = r.texts().filter("process_name = 'src1'").groupBy("id").agg(F.min("text").alias("_new"))
    gone = r.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return tasks.join(gone, "id", "left_anti").join(renamed, "id", "left").select("id", F.coalesce("_new", "label").alias("label"))


@query("snk30_anchor_migration", "SELECT doc_id % 7 AS category, 'doc ' || doc_id AS text, CASE WHEN quality = 1 THEN 1.0 ELSE toxic + 2.0 END AS weight, CASE WHEN quality = 1 THEN 'global' ELSE 'local' END AS scope, '' AS process_name FROM labels")
def anchor_migration(r: Roles) -> DataFrame:
    return lg.migrated_anchors(raw_anchors(r, ""))


def raw_anchors(r: Roles, blank: str) -> DataFrame:
    """Anchors as JSON arrays: bare strings for good rows, structs for others; with ``blank``, toxic ones have no text."""
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    name = F.when(F.col("toxic") == 1, blank).otherwise(name) if blank else name
    new = F.to_json(F.struct(name.alias("text"), (F.col("toxic") + 2.0).alias("weight"), F.lit("local").alias("scope")))
    body = F.when(F.col("quality") == 1, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(new)
    return r.table("labels").select((F.col("doc_id") % 7).alias("category"), F.concat(F.lit("["), body, F.lit("]")).alias("anchors"))


@query("clu15_anchor_index", "SELECT doc_id % 7 AS category, 'doc ' || doc_id AS text, CASE WHEN quality = 1 THEN 1.0 ELSE 2.0 END AS weight FROM labels WHERE toxic <> 1")
def anchor_index(r: Roles) -> DataFrame:
    return lg.anchor_index(lg.migrated_anchors(raw_anchors(r, " "))).select("category", "text", "weight")


@query("snk32_examples_replace", SQL_EXAMPLES + "SELECT * FROM examples WHERE cluster_id NOT IN (2, 3) UNION ALL SELECT 2, doc_id, quality = 1, 0.5 FROM labels")
def examples_replace(r: Roles) -> DataFrame:
    new = r.table("labels").select(F.lit(2).alias("cluster_id"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_positive"), F.lit(0.5).alias("score"))
    return lg.replaced(examples(r), new, r.spark.createDataFrame([(2,), (3,)], "cluster_id int"), "cluster_id").select("cluster_id", "id", "is_positive", "score")


@query("snk33_vector_delete", "SELECT page_id, md5(url) AS key FROM pages WHERE md5(url) NOT IN (SELECT md5(url) FROM pages JOIN labels ON doc_id = page_id WHERE toxic = 1)")
def vector_delete(r: Roles) -> DataFrame:
    p = r.table("pages").select("page_id", F.md5("url").alias("key"))
    gone = p.join(r.table("labels").filter("toxic = 1"), F.col("page_id") == F.col("doc_id")).select("key")
    return p.join(gone, "key", "left_anti").select("page_id", "key")


@query("snk13_link_set_ids", """WITH l AS (SELECT l_orderkey AS k, '[' || string_agg('["' || l_partkey || '","' || l_linestatus || '"]', ',' ORDER BY CAST(l_partkey AS VARCHAR), l_linestatus) || ']' AS j FROM lineitem GROUP BY 1) SELECT k, sha256(j) AS content_hash, min(k) OVER (PARTITION BY j) AS link_set FROM l""")
def link_set_ids(r: Roles) -> DataFrame:
    from ..operators.lifecycle import content_ids

    links = r.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("url"), F.col("l_linestatus").alias("text"))).alias("links"))
    keyed = links.select("k", tx.link_set_key(F.col("links")).alias("j")).select("k", F.sha2("j", 256).alias("content_hash"), "j")
    ids = content_ids(keyed.select(F.col("k").alias("id"), "j"), F.col("j")).withColumnRenamed("id", "link_set")
    return keyed.join(ids, "content_hash").select("k", "content_hash", "link_set")


@query("snk29_anchor_removal_by_text", "SELECT doc_id % 7 AS category, count(*) AS n FROM labels WHERE NOT (doc_id % 7 = 3 AND quality <> 1 OR doc_id % 7 = 4) GROUP BY 1")
def anchor_removal_by_text(r: Roles) -> DataFrame:
    anchors = lg.migrated_anchors(raw_anchors(r, ""))
    texts = anchors.filter("category IN (3, 4)").select("category", "text", F.when(F.col("category") == 3, "local").alias("scope"), F.lit(None).cast("string").alias("process_name"))
    return lg.without_anchors(anchors, texts).groupBy("category").agg(F.count("*").alias("n"))


@query("agg13_contract_min_max", SQL_LEDGER + "SELECT count(*) AS n, min(octet_length(encode(d.fp))) AS dims_low, max(octet_length(encode(d.fp))) AS dims_high, 'm1' AS model_low, 'm1' AS model_high, 'r1' AS revision_low, 'r1' AS revision_high, 1 AS version_low, 1 AS version_high, true AS uniform FROM docs d JOIN jobs j ON d.subject_key = j.subject_key AND d.fp = j.fp WHERE j.status = 'completed'")
def contract_min_max(r: Roles) -> DataFrame:
    seen = rel.visible(*ledger(r)).withColumn("dims", F.octet_length("source_fingerprint"))
    return lg.contract_range(seen)


# Ledger


DUE = f"status IN ('pending', 'failed') AND (next_retry_at IS NULL OR next_retry_at <= {NOW})"


@query("stm6_exclude", SQL_LEDGER + "SELECT coalesce(d.subject_key, j.subject_key) AS subject_key, CASE WHEN d.subject_key IS NOT NULL THEN 'excluded' ELSE status END AS status, CASE WHEN d.subject_key IS NOT NULL THEN sha256('v1' || chr(0)) ELSE j.fp END AS fp FROM jobs j FULL OUTER JOIN (SELECT subject_key FROM docs WHERE n_chars < 100) d ON d.subject_key = j.subject_key")
def exclude(r: Roles) -> DataFrame:
    docs, jobs = ledger(r)
    return lg.excluded(jobs, docs.filter("n_chars < 100").select("subject_key")).select("subject_key", "status", F.col("source_fingerprint").alias("fp"))


@query("stm7_cascade", CAPS + ", g AS (SELECT id, image_hash FROM captures WHERE k < 90), h AS (SELECT DISTINCT image_hash FROM g WHERE image_hash NOT IN (SELECT image_hash FROM captures WHERE k >= 90 AND value <= 30)) SELECT 'text' AS kind, CAST(id AS VARCHAR) AS subject_key FROM g UNION ALL SELECT 'image', image_hash FROM h")
def cascade(r: Roles) -> DataFrame:
    c = r.captures().withColumn("is_deleted", F.col("value") > 30)
    ids, hashes = lg.cascade(c, c.filter("k < 90").select("id"))
    return ids.select(F.lit("text").alias("kind"), F.col("id").cast("string").alias("subject_key")).unionAll(hashes.select(F.lit("image"), "image_hash"))


@query("stm8_epochs", "SELECT lang AS kind, 5 + max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS epoch FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def epochs(r: Roles) -> DataFrame:
    d = r.texts().select(F.col("category").alias("kind"), F.col("id").cast("string").alias("subject_key"), F.md5("text").alias("fingerprint"))
    gone = r.table("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("subject_key"))
    start = d.select("kind").distinct().withColumn("epoch", F.lit(5))
    return lg.next_epochs(start, d, d.join(gone, "subject_key", "left_anti"))


@query("stm12_reconcile", "SELECT CAST(doc_id AS VARCHAR) AS subject_key, CASE WHEN trim(text) = '' THEN 'exclude' ELSE 'enqueue' END AS outcome FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reconcile(r: Roles) -> DataFrame:
    text = tx.index_text(F.lit(""), F.lit(" "), F.when(F.trim("text") == "", "").otherwise(F.ltrim("text")))
    return lg.reconciled(r.texts().select(F.col("id").cast("string").alias("subject_key"), text.alias("index_text")), ledger(r)[1])


@query("stm16_retry_list", SQL_LEDGER + "SELECT subject_key, row_number() OVER (ORDER BY updated_at, subject_key) <= 32 AS again FROM jobs WHERE status = 'failed'")
def retry_list(r: Roles) -> DataFrame:
    failed = ledger(r)[1].filter("status = 'failed'").select("subject_key", "updated_at")
    first = failed.orderBy("updated_at", "subject_key").limit(32).select("subject_key", F.lit(True).alias("_a"))
    return failed.join(first, "subject_key", "left").select("subject_key", F.coalesce("_a", F.lit(False)).alias("again"))


# Classification


@query("clu6_process_prior", "SELECT doc_id AS id, c AS category, round(n_chars / 1000.0 + CASE WHEN (source = 'src1' AND c = 'work') OR (source = 'src2' AND c = 'social') THEN 0.12 ELSE 0 END, 6) AS score FROM documents, (VALUES ('work'), ('other')) v(c)")
def process_prior(r: Roles) -> DataFrame:
    d = r.table("documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"), F.concat(F.lit(" "), F.upper("source")).alias("process_name"))
    s = d.select("id", "score", F.explode(F.array(F.lit("work"), F.lit("other"))).alias("category"))
    out = lg.with_prior(s, d.select("id", "process_name").distinct(), {"src1": "work", "src2": "social"})
    return out.select("id", "category", F.round("score", 6).alias("score"))


@query("clu10_batch_size", "SELECT p_partkey AS id, least(CASE WHEN p_size > 25 THEN 128 ELSE 32 END, greatest(1, 4096 // greatest(p_partkey, 1))) AS rows FROM part")
def batch_sizes(r: Roles) -> DataFrame:
    return r.table("part").select(F.col("p_partkey").alias("id"), lg.batch_size(F.col("p_size") > 25, F.col("p_partkey")).alias("rows"))


@query("clu18_rederived", SQL_EXAMPLES + ", e AS (SELECT * FROM examples JOIN (SELECT DISTINCT doc_id FROM documents) ON doc_id = id), a AS (SELECT cluster_id, min(score) FILTER (WHERE is_positive) * 0.85 AS b, max(score) FILTER (WHERE NOT is_positive) * 1.05 AS h FROM e GROUP BY 1) SELECT cluster_id, round(CASE WHEN b IS NOT NULL THEN greatest(b, h) END, 5) AS threshold, CASE WHEN b IS NOT NULL THEN 'scorer-1' END AS model_id FROM a")
def rederived(r: Roles) -> DataFrame:
    docs = r.texts().select("id").distinct()
    e = examples(r).join(docs, "id", "left_semi").groupBy("cluster_id").agg(F.collect_list(F.when(F.col("is_positive"), F.col("score"))).alias("p"), F.collect_list(F.when(~F.col("is_positive"), F.col("score"))).alias("n"))
    t = threshold(F.col("p"), F.col("n"))
    return e.select("cluster_id", F.round(t, 5).alias("threshold"), F.when(t.isNotNull(), "scorer-1").alias("model_id"))


@query("joi27_scope_rule", "WITH a AS (SELECT n_name AS anchor, n_regionkey = 0 AS local, CASE n_nationkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE '' END AS process FROM nation) SELECT event_id AS id, anchor FROM events JOIN a ON NOT local OR (process <> '' AND process = event_type)")
def scope_rule(r: Roles) -> DataFrame:
    n = F.col("n_nationkey") % 3
    anchors = r.table("nation").select(F.col("n_name").alias("anchor"), F.when(F.col("n_regionkey") == 0, "local").otherwise("global").alias("scope"), F.when(n == 0, " View").when(n == 1, "CLICK").otherwise(" ").alias("process_name"))
    return lg.in_scope(r.captures().select("id", "process_name"), anchors).select("id", "anchor")


@query("clu7_category_scope", f"WITH {SQL_VECTORS}, a AS (SELECT v.id, label, id % 2 AS scope, vector FROM vectors v JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = v.id) SELECT v.id, coalesce(bool_or(list_cosine_similarity(v.vector, a.vector) > 0.95), false) AS duplicate FROM vectors v LEFT JOIN a ON a.label = v.label AND a.scope = v.id % 2 AND a.id <> v.id GROUP BY 1")
def category_scope(r: Roles) -> DataFrame:
    v = r.vectors().select("id", F.col("label").alias("category"), (F.col("id") % 2).alias("scope"), "vector")
    known = r.table("labels").filter("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return lg.semantic_duplicates(v, v.join(known, "id", "left_semi"))


# Scalars


@query("str3_is_cjk", r"SELECT page_id, regexp_matches(c, '^[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}]$') AS cjk FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '中' WHEN 1 THEN '𠀀' WHEN 2 THEN 'é' ELSE substr(url, 1, 1) END AS c FROM pages)")
def cjk(r: Roles) -> DataFrame:
    n = F.col("page_id") % 4
    char = F.when(n == 0, "中").when(n == 1, "𠀀").when(n == 2, "é").otherwise(F.substring("url", 1, 1))
    return r.table("pages").select("page_id", tx.is_cjk(char).alias("cjk"))


@query("str17_mask_json", "SELECT doc_id AS id, source AS kept, " + MASKS.format("text") + " AS text FROM documents")
def mask_json(r: Roles) -> DataFrame:
    json = F.to_json(F.struct(F.struct(F.col("text").alias("password")).alias("a"), F.array("process_name").alias("worthless")))
    out = pv.json_masked(json, WORDS[:3])
    return r.texts().select("id", F.get_json_object(out, "$.worthless[0]").alias("kept"), F.get_json_object(out, "$.a.password").alias("text"))


@query("str18_percent_decode", "SELECT page_id, url_decode(url || '%20%E4%BD%A0+5') || '%' AS url FROM pages")
def percent_decode(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", tx.percent_decoded(F.concat("url", F.lit("%20%E4%BD%A0+5%"))).alias("url"))


@query("str22_title_entity", rf"""WITH t AS (SELECT page_id, page_id % 6 AS n, CASE page_id % 6 WHEN 0 THEN 'Pull requests · me/repo' || page_id || '  - GitHub' WHEN 1 THEN left({TITLE}, 20) || ' | Site ' || page_id || ' - google chrome' WHEN 2 THEN 'a.py - proj' || page_id || ' - Visual Studio Code' WHEN 3 THEN {TITLE} || ' - Mozilla Firefox' WHEN 4 THEN {TITLE} || ' · Notes' ELSE {TITLE} END AS t FROM pages),
 c AS (SELECT page_id, n, trim(regexp_replace(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '(?i) [-|·] (GitHub|Notes|Mozilla Firefox|Visual Studio Code|Google Chrome)$', ''), '', '')) AS t FROM t),
 s AS (SELECT page_id, n, t, regexp_extract(t, '(?:^|[\s:/·])[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+)', 1) AS repo, list_filter(list_transform(string_split_regex(t, '\s+[-|·]\s+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM c)
 SELECT page_id, CASE WHEN repo <> '' THEN repo WHEN n = 2 THEN 'proj' || page_id WHEN len(p) > 1 AND length(p[-1]) BETWEEN 2 AND 48 THEN p[-1] WHEN length(t) > 64 THEN substr(t, 1, 61) || '...' ELSE t END AS entity FROM s""")
def title_entities(r: Roles) -> DataFrame:
    n, t = F.col("page_id") % 6, F.col("title")
    title = (
        F.when(n == 0, F.concat(F.lit("Pull requests · me/repo"), "page_id", F.lit("  - GitHub")))
        .when(n == 1, F.concat(F.substring(t, 1, 20), F.lit(" | Site "), "page_id", F.lit(" - google chrome")))
        .when(n == 2, F.concat(F.lit("a.py - proj"), "page_id", F.lit(" - Visual Studio Code")))
        .when(n == 3, F.concat(t, F.lit(" - Mozilla Firefox"))).when(n == 4, F.concat(t, F.lit(" · Notes"))).otherwise(t)
    )
    process = F.when(n == 2, "Code.exe").when(n == 4, "notes.exe").otherwise("chrome.exe")
    return titles(r).select("page_id", tx.title_entity(title, process, F.when(n == 0, "GitHub").otherwise("")).alias("entity"))


@query("str35_anchor_hash", "SELECT item_id, sha256(text) AS hash FROM benchmark")
def anchor_hashes(r: Roles) -> DataFrame:
    return r.table("benchmark").select("item_id", tx.anchor_hash(F.col("text")).alias("hash"))


@query("sea5_title_score", f"""WITH p AS (SELECT page_id, trim(CASE WHEN page_id % 3 = 0 THEN left({TITLE}, 9) ELSE {TITLE} END) AS t FROM pages), c AS (SELECT page_id, t, string_split(t, '') AS c, length(t)::DOUBLE AS n FROM p),
 h AS (SELECT *, list_sum(list_transform(list_distinct(c), lambda x: -(len(list_filter(c, lambda y: y = x)) / n) * log2(len(list_filter(c, lambda y: y = x)) / n))) AS h FROM c)
 SELECT page_id, round(CASE WHEN n <= 1 OR t LIKE 'http://%' THEN 0 ELSE ln(1 + n) * exp(-0.5 * pow(((CASE WHEN n < 16 THEN h / log2(n) * 4 ELSE h END) - 4) / 1.5, 2)) * (length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / n) / ln(exp(1) + n) END, 5) AS score FROM h""")
def title_scores(r: Roles) -> DataFrame:
    t = F.when(F.col("page_id") % 3 == 0, F.substring("title", 1, 9)).otherwise(F.col("title"))
    return titles(r).select("page_id", F.round(tx.title_score(t), 5).alias("score"))


@query("dat6_retry_time", "SELECT event_id AS id, CASE WHEN event_id % 3 <> 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def retry_times(r: Roles) -> DataFrame:
    n, c = F.col("id") % 3, F.col("created_at")
    text = F.when(n == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).when(n == 1, F.concat(F.date_format(c + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return r.captures().select("id", dt.retry_time(text).alias("at"))


# Redacted retrieval: a record is a conversation, its turns are the boxes, its title and URL those of the page of that id.


def records(r: Roles) -> DataFrame:
    turns = r.boxes().groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda b: b["text"]).alias("boxes"))
    p = titles(r).select(F.col("page_id").alias("id"), "title", "url")
    return turns.join(p, "id", "left")


def _lines(boxes):
    return F.array_join(boxes, "\n").alias("boxes")


SQL_TURNS = "WITH t AS (SELECT *, " + HIT + " AS hit FROM conversations), p AS (SELECT page_id, " + TITLE + " AS title, url FROM pages), k AS (SELECT conv_id AS id, bool_or(hit) AS dirty, string_agg(text, chr(10) ORDER BY turn) AS whole, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE NOT hit) AS left_over, string_agg(" + MASKS.format("text") + ", chr(10) ORDER BY turn) AS masked FROM t GROUP BY 1) "


def _title(hit: str) -> str:
    return f"coalesce({HIT.replace('text', hit)}, false)"


@query("api3_details_reject", SQL_TURNS + f"SELECT id, title, url, whole AS boxes FROM k LEFT JOIN p ON page_id = id WHERE NOT dirty AND NOT {_title('title')} AND NOT {_title('url')}")
def details_reject(r: Roles) -> DataFrame:
    keep = ~pv.record_hit(F.col("title"), F.col("url"), F.col("boxes"), WORDS)
    return records(r).filter(keep).select("id", "title", "url", _lines(F.col("boxes")))


@query("api3_details_remove", SQL_TURNS + f"SELECT id, CASE WHEN {_title('title')} THEN '[censored]' ELSE title END AS title, CASE WHEN {_title('url')} THEN '[censored]' ELSE url END AS url, left_over AS boxes FROM k LEFT JOIN p ON page_id = id")
def details_remove(r: Roles) -> DataFrame:
    return records(r).select("id", pv.redacted(F.col("title"), WORDS, "remove").alias("title"), pv.redacted(F.col("url"), WORDS, "remove", "url").alias("url"), _lines(pv.redacted_boxes(F.col("boxes"), WORDS, "remove")))


@query("api3_details_mask", SQL_TURNS + f"SELECT id, CASE WHEN {_title('url').replace('|there', '')} THEN '[censored]' ELSE url END AS url, masked AS boxes FROM k LEFT JOIN p ON page_id = id")
def details_mask(r: Roles) -> DataFrame:
    return records(r).select("id", pv.redacted(F.col("url"), WORDS[:3], "mask", "url").alias("url"), _lines(pv.redacted_boxes(F.col("boxes"), WORDS[:3], "mask")))


@query("api2_redacted_range", f"SELECT d.doc_id AS id, CASE WHEN {HIT} THEN '[censored]' ELSE text END AS title FROM documents d JOIN events ON event_id = d.doc_id WHERE ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def redacted_range(r: Roles) -> DataFrame:
    at = F.col("created_at").between(F.lit("2024-01-01 06:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return r.captures().filter(at).select("id").join(r.texts(), "id").select("id", pv.redacted(F.col("text"), WORDS, "remove").alias("title"))


@query("api7_task_screenshots", f"SELECT event_id AS id, 'Work' AS task, CASE WHEN {HIT} THEN '[censored]' ELSE text END AS title FROM (SELECT * FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 30) LEFT JOIN documents ON doc_id = event_id")
def task_screenshots(r: Roles) -> DataFrame:
    mine = r.captures().filter("owner = 7").orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", F.lit("Work").alias("task"))
    return mine.join(r.texts(), "id", "left").select("id", "task", pv.redacted(F.col("text"), WORDS, "remove").alias("title"))
