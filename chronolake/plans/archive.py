"""Queries over the archive's remaining readers, rules and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.vector import dot
from ..operators import relations as rel
from ..operators import timeline as t
from ..operators.text_assembly import joined_text, text_prefix
from ..sources import logs
from ..sources.roles import SQL_BOXES, SQL_CAPTURES, SQL_CHILDREN, SQL_PARENTS, SQL_VECTORS, Roles
from .registry import query
from .relations import SQL_LEDGER, kids, ledger

CAPS = f"WITH {SQL_CAPTURES} "
DONE = "FROM docs d JOIN jobs j ON d.subject_key = j.subject_key AND d.fp = j.fp WHERE j.status = 'completed'"


@query("src15_visible_page", SQL_LEDGER + f"SELECT d.subject_key, d.n_chars {DONE} ORDER BY d.subject_key LIMIT 50 OFFSET 20")
def visible_page(r: Roles) -> DataFrame:
    return t.page(rel.visible(*ledger(r)).select("subject_key", "n_chars"), ["subject_key"], 20, 50)


@query("src16_visible_by_subjects", SQL_LEDGER + f"SELECT d.subject_key, d.n_chars {DONE} AND d.subject_key IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE label = 2)")
def visible_by_subjects(r: Roles) -> DataFrame:
    wanted = r.vectors().filter("label = 2").select(F.col("id").cast("string").alias("subject_key"))
    return rel.visible(*ledger(r)).join(wanted, "subject_key", "left_semi").select("subject_key", "n_chars")


@query("src20_export_snapshot", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cursor, vec_id AS id, d.doc_id IS NULL AS missing FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM labels) d ON d.doc_id = vec_id")
def export_snapshot(r: Roles) -> DataFrame:
    have = r.table("labels").select(F.col("doc_id").alias("_d")).distinct()
    return t.row_numbers(r.vectors().select("id"), ["id"], "cursor").join(have, F.col("id") == F.col("_d"), "left").select("cursor", "id", F.col("_d").isNull().alias("missing"))


@query("src21_decode_vectors", f"WITH {SQL_VECTORS} SELECT id, len(vector) AS dims, round(vector[1], 6) AS first FROM vectors")
def decode_vectors(r: Roles) -> DataFrame:
    packed = logs.encode_vectors(r.vectors().select("id", "vector"))
    return logs.decode_vectors(packed).select("id", F.size("vector").cast("long").alias("dims"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("src23_ledger_row", SQL_LEDGER + "SELECT subject_key, status FROM jobs WHERE subject_key = '4'")
def ledger_row(r: Roles) -> DataFrame:
    return ledger(r)[1].filter("subject_key = '4'").select("subject_key", "status")


@query("src27_latest_per_kind", CAPS + "SELECT process_name, arg_max(id, struct_pack(c := created_at, i := id)) AS id FROM captures GROUP BY 1")
def latest_per_kind(r: Roles) -> DataFrame:
    return r.captures().groupBy("process_name").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("src28_run_subjects", "SELECT DISTINCT user_id AS owner FROM events WHERE event_type = 'signup'")
def run_subjects(r: Roles) -> DataFrame:
    return r.captures().filter("process_name = 'signup'").select("owner").distinct()


@query("src29_errors_page", CAPS + "SELECT id, k FROM captures WHERE process_name = 'error' ORDER BY id LIMIT 100 OFFSET 40")
def errors_page(r: Roles) -> DataFrame:
    return t.page(r.captures().filter("process_name = 'error'").select("id", "k"), ["id"], 40, 100)


@query("src31_enabled_targets", "SELECT p_partkey AS id, p_brand AS anchor FROM part WHERE p_size >= 25")
def enabled_targets(r: Roles) -> DataFrame:
    return r.table("part").filter("p_size >= 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("anchor")).orderBy("id")


@query("src33_failed_ids", SQL_LEDGER + "SELECT subject_key FROM jobs WHERE status = 'failed' ORDER BY updated_at, subject_key LIMIT 10")
def failed_ids(r: Roles) -> DataFrame:
    return ledger(r)[1].filter("status = 'failed'").orderBy("updated_at", "subject_key").limit(10).select("subject_key")


@query("fil5_exclusion_rules", "SELECT page_id, (url = '' OR contains(url, '.net') OR starts_with(url, 'https://m.') OR contains(lower(url), 'fr/')) AS excluded FROM pages")
def exclusion_rules(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", rules.excluded(F.col("url"), F.lit(""), contains=[".net"], starts=["https://m."], user_words=["FR/"], processes=["none"]).alias("excluded"))


@query("fil6_browser_process", "SELECT event_id AS id FROM events WHERE lower(event_type) IN ('view', 'click')")
def browser_process(r: Roles) -> DataFrame:
    return r.captures().filter(rules.member(F.upper("process_name"), ["view", "click"])).select("id")


@query("fil8_valid_rows", "SELECT doc_id AS id FROM documents WHERE length(text) <= 16384")
def valid_rows(r: Roles) -> DataFrame:
    from ..operators.lifecycle import box_is_valid

    box = F.array(*[F.array(F.lit(1.0), F.lit(2.0)) for _ in range(4)])
    return r.texts().filter(box_is_valid(box, F.col("text"))).select("id")


@query("fil15_weak_labels", "SELECT doc_id AS id FROM documents WHERE trim(lang) = '' OR lower(source) = 'src3' OR lower(lang) IN ('en', 'de')")
def weak_labels(r: Roles) -> DataFrame:
    return r.texts().filter(rules.weak_label(F.col("category"), F.lit("src3"), ["EN", "de"]) | (F.lower("process_name") == "src3")).select("id")


@query("fil17_summary_redaction", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(there|tion)') THEN '[censored]' ELSE text END AS text FROM conversations")
def summary_redaction(r: Roles) -> DataFrame:
    from ..functions.privacy import redacted

    return r.boxes().select(F.col("parent_id").alias("conv_id"), F.col("position").alias("turn"), redacted(F.col("text"), ["there", "tion"], "remove").alias("text"))


@query("joi11_related", f"WITH {SQL_PARENTS}, {SQL_CHILDREN}, m AS (SELECT owner FROM parents WHERE id = 100) SELECT p.id, CASE WHEN epoch(p.created_at) < epoch(c.created_at) THEN 'before' WHEN epoch(p.created_at) > epoch(c.created_at) THEN 'after' ELSE 'nearby' END AS relation FROM parents p JOIN parents c ON c.id = 100 AND p.owner = c.owner AND p.id <> c.id ORDER BY abs(epoch(p.created_at) - epoch(c.created_at)), p.created_at DESC, p.id LIMIT 5")
def related(r: Roles) -> DataFrame:
    p = r.parents()
    now = p.filter("id = 100").select(F.col("owner").alias("_o"), F.col("created_at").alias("_t"), F.col("id").alias("_i"))
    gap = F.col("created_at").cast("double") - F.col("_t").cast("double")
    relation = F.when(gap < 0, "before").when(gap > 0, "after").otherwise("nearby")
    near = p.join(now, (p["owner"] == F.col("_o")) & (p["id"] != F.col("_i"))).withColumn("relation", relation)
    return near.orderBy(F.abs(gap), F.desc("created_at"), "id").limit(5).select("id", "relation")


@query("agg15_visible_count", SQL_LEDGER + f"SELECT count(*) AS n, count(*) > 0 AS any {DONE}")
def visible_count(r: Roles) -> DataFrame:
    return rel.visible(*ledger(r)).agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any"))


@query("agg19_rate_delta", "WITH s AS (SELECT user_id AS owner, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS b FROM events GROUP BY 1) SELECT owner, round(a / 100.0, 6) AS baseline_rate, round(b / 200.0, 6) AS workload_rate, round(greatest(b / 200.0 - a / 100.0, 0) * 100.0, 4) AS excess FROM s")
def rate_delta(r: Roles) -> DataFrame:
    s = r.captures().groupBy("owner").agg(*[F.sum(F.when(F.col("process_name") == p, F.col("value")).otherwise(0.0)).alias(k) for k, p in (("a", "view"), ("b", "click"))])
    return s.select("owner", F.round(F.col("a") / 100.0, 6).alias("baseline_rate"), F.round(F.col("b") / 200.0, 6).alias("workload_rate"), F.round(F.greatest(F.col("b") / 200.0 - F.col("a") / 100.0, F.lit(0.0)) * 100.0, 4).alias("excess"))


@query("str2_url_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^(www|m|app)\.', '') AS host FROM pages")
def url_hosts(r: Roles) -> DataFrame:
    from ..functions.text import host

    return r.table("pages").select("page_id", host(F.col("url")).alias("host"))


@query("str12_suffix_strip", r"SELECT page_id, CASE WHEN length(regexp_replace(x, ' [-–] (Brave|Firefox|Edge)$', '')) < 2 THEN x ELSE regexp_replace(x, ' [-–] (Brave|Firefox|Edge)$', '') END AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - Firefox' AS x FROM pages)")
def suffix_strip(r: Roles) -> DataFrame:
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - Firefox"))
    return r.table("pages").select("page_id", rules.strip_suffix(title, ["Brave", "Firefox", "Edge"]).alias("title"))


@query("str29_process_name", "SELECT page_id, lower(string_split(url, '/')[-1]) AS name FROM pages")
def process_name(r: Roles) -> DataFrame:
    from ..functions.text import process_from_path

    return r.table("pages").select("page_id", process_from_path(F.col("url")).alias("name"))


@query("str32_prefix_rewrite", "SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'M:' || substr(url, 11) WHEN starts_with(url, 'https://') THEN 'S:' || substr(url, 9) ELSE url END AS path FROM pages")
def prefix_rewrite(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", rules.rewrite_prefix(F.col("url"), {"https://": "S:", "https://m.": "M:"}).alias("path"))


@query("str33_float_list", "SELECT event_id AS id, 1.5 AS first FROM events WHERE event_type = 'view'")
def float_lists(r: Roles) -> DataFrame:
    from ..functions.text import float_list

    return r.captures().filter("process_name = 'view'").select("id", float_list(F.lit(" 1.5, ,2"))[0].alias("first"))


@query("jsn4_box_nesting", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS x2 FROM orders")
def box_nesting(r: Roles) -> DataFrame:
    b = rules.box(*[F.col("weight") if i == 2 else F.lit(float(i)) for i in range(8)])
    return r.parents().select("id", F.round(b[1][0], 2).alias("x2"))


@query("jsn1_json_parse", "SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_parse(r: Roles) -> DataFrame:
    return r.table("events").select(F.col("event_id").alias("id"), F.from_json("props", "k int")["k"].alias("k"))


@query("dat3_unknown_times", "SELECT doc_id AS id, CASE WHEN n_chars - 500 > 0 THEN n_chars - 500 END AS seconds FROM documents")
def unknown_times(r: Roles) -> DataFrame:
    from ..functions.dates import known

    return r.table("documents").select(F.col("doc_id").alias("id"), known(F.col("n_chars") - 500).alias("seconds"))


@query("vec4_cls_pool", f"WITH {SQL_VECTORS} SELECT id, round(vector[1], 6) AS first FROM vectors")
def cls_pool(r: Roles) -> DataFrame:
    return r.vectors().select("id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("vec3_mean_pool", f"WITH {SQL_VECTORS} SELECT id, round((vector[1] + vector[5]) / 2, 6) AS first FROM vectors")
def mean_pool(r: Roles) -> DataFrame:
    from ..functions.vector import mean_pool as pool

    head = F.transform(F.slice("vector", 1, 12), lambda x: x.cast("double"))
    mask = F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))
    return r.vectors().select("id", F.round(pool(head, mask, 4)[0], 6).alias("first"))


@query("vec10_peak_bytes", "SELECT o_orderkey AS id, o_custkey * (384 * 4 + 15 * 12 + 15 * 8) AS bytes FROM orders")
def peak_bytes(r: Roles) -> DataFrame:
    from ..functions.vector import peak_bytes as peak

    return r.parents().select("id", peak(F.col("owner"), 384).alias("bytes"))


@query("stm11_enqueue_recent", CAPS + "SELECT DISTINCT owner FROM captures WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00' AND owner NOT IN (SELECT doc_id FROM labels)")
def enqueue_recent(r: Roles) -> DataFrame:
    recent = r.captures().filter(F.col("created_at") >= F.lit("2024-01-24 00:00:00").cast("timestamp")).select("owner").distinct()
    return recent.join(r.table("labels"), F.col("owner") == F.col("doc_id"), "left_anti")


@query("stm15_storage_policy", CAPS + ", old AS (SELECT id FROM captures WHERE created_at < TIMESTAMP '2024-01-05 00:00:00' ORDER BY created_at, id LIMIT 20000), o AS (SELECT id, value, created_at FROM captures WHERE value > 0 AND id NOT IN (SELECT id FROM old) ORDER BY created_at, id LIMIT 20000), w AS (SELECT id, coalesce(sum(value) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o) SELECT id, 'expired' AS reason FROM old UNION ALL SELECT id, 'reclaimed' FROM w WHERE b < 5000.5")
def storage_policy(r: Roles) -> DataFrame:
    c = r.captures()
    old = t.older_than(c, "2024-01-05 00:00:00", 20_000).select("id")
    rest = t.reclaim_until(c.join(old, "id", "left_anti"), 5000.5, "value", ["created_at", "id"]).select("id")
    return old.withColumn("reason", F.lit("expired")).unionAll(rest.withColumn("reason", F.lit("reclaimed")))


@query("stm17_claim_batch", SQL_LEDGER + "SELECT j.subject_key, CASE WHEN d.subject_key IS NULL THEN 'gone' WHEN j.fp <> d.fp THEN 'changed' ELSE 'leased' END AS outcome FROM jobs j LEFT JOIN docs d ON d.subject_key = j.subject_key WHERE j.status = 'pending'")
def claim_batch(r: Roles) -> DataFrame:
    docs, jobs = ledger(r)
    d = docs.select(F.col("subject_key").alias("_k"), F.col("source_fingerprint").alias("_fp"))
    j = jobs.filter("status = 'pending'").join(d, F.col("subject_key") == F.col("_k"), "left")
    return j.select("subject_key", F.when(F.col("_k").isNull(), "gone").when(F.col("source_fingerprint") != F.col("_fp"), "changed").otherwise("leased").alias("outcome"))


@query("api8_corpus_page", f"WITH {SQL_BOXES}, b AS (SELECT parent_id, string_agg(text, ' ' ORDER BY position) AS body FROM boxes WHERE text <> '' GROUP BY 1), p AS (SELECT vec_id AS id FROM embeddings WHERE label = 5 ORDER BY vec_id LIMIT 30) SELECT id, body FROM p JOIN b ON b.parent_id = p.id")
def corpus_page(r: Roles) -> DataFrame:
    page = r.vectors().filter("label = 5").orderBy("id").limit(30).select("id")
    body = joined_text(r.boxes(), "parent_id", ["position"])
    return page.join(body, F.col("id") == F.col("parent_id")).select("id", "body")


@query("snk10_delete_candidates", "SELECT q.k AS id, p.o_orderkey IS NULL AS purge FROM (SELECT doc_id * 17 AS k FROM labels) q LEFT JOIN orders p ON p.o_orderkey = q.k")
def delete_candidates(r: Roles) -> DataFrame:
    q = r.table("labels").select((F.col("doc_id") * 17).alias("k"))
    p = r.parents().select(F.col("id").alias("_p"))
    return q.join(p, F.col("k") == F.col("_p"), "left").select(F.col("k").alias("id"), F.col("_p").isNull().alias("purge"))


@query("snk16_category_update", CAPS + "SELECT id, coalesce(CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'flagged' END, category) AS category FROM captures")
def category_update(r: Roles) -> DataFrame:
    new = r.table("labels").filter("toxic = 1").select("doc_id").distinct()
    c = r.captures().join(new, F.col("id") == F.col("doc_id"), "left")
    return c.select("id", F.coalesce(F.when(F.col("doc_id").isNotNull(), "flagged"), "category").alias("category"))


@query("snk28_backfill", "SELECT doc_id AS id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def backfill(r: Roles) -> DataFrame:
    texts = r.texts().filter(F.trim("text") != "").select("id")
    return texts.join(r.vectors(), "id", "left_anti")


