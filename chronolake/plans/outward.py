"""What the archive answers to others: details, ranges, searches and tasks, redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import redaction as rd
from ..operators import search as s
from ..operators import vector_blocks as vb
from ..operators.vectors import overfetch_page
from ..sources.indexes import stored_blocks, stored_index
from ..sources.roles import SQL_VECTORS, Roles
from .registry import query
from .search import GRAMS, SQL_LINKS, THE, corpus, links, strict_sql

LISTED = rd.Words(("credit card", "worthless", "password", "thea"))
MAIL = rd.Entities(("EMAIL",))
WORD = "(?i)(credit card|worthless|password|thea)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def hit(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{WORD}') OR regexp_matches({x}, '{EMAIL}'), false)"


def blocked(x: str) -> str:
    for w in LISTED.listed:
        x = f"regexp_replace({x}, '(?i){w}', repeat('█', {len(w)}), 'g')"
    return f"regexp_replace({x}, '{EMAIL}', '[EMAIL]', 'g')"


RECORDS = rf"""WITH {SQL_LINKS}, l AS (SELECT page_id, list({{'u': url, 't': text}} ORDER BY link_id) AS links FROM links GROUP BY 1),
 r AS (SELECT p.page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, p.url, l.links, string_split(d.text, chr(10)) AS boxes FROM pages p LEFT JOIN l USING (page_id) LEFT JOIN documents d ON d.doc_id = p.page_id) """


def shown(links_sql: str, boxes_sql: str) -> str:
    return f"array_to_string(list_transform({links_sql}, lambda x: x.u || '|' || x.t), chr(10)) AS links, array_to_string({boxes_sql}, chr(10)) AS boxes"


def page_records(r: Roles) -> DataFrame:
    """Pages as records: their title, URL and links, the document of that id as boxes, a line each."""
    each = links(r).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("link_id", "url", "text"))).alias("l"))
    each = each.select("page_id", F.transform("l", lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"))).alias("links"))
    boxes = r.texts().select(F.col("id").alias("page_id"), F.split("text", "\n").alias("boxes"))
    pages = r.table("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return pages.join(each, "page_id", "left").join(boxes, "page_id", "left").select(F.col("page_id").alias("id"), "title", "url", "links", "boxes")


def plain(records: DataFrame) -> DataFrame:
    return records.select("id", "title", "url", F.array_join(F.transform("links", lambda x: F.concat(x["url"], F.lit("|"), x["text"])), "\n").alias("links"), F.array_join("boxes", "\n").alias("boxes"))


def under(r: Roles, mode: str) -> DataFrame:
    return plain(rd.redacted_records(rd.redacted_records(page_records(r), LISTED, mode), MAIL, mode))


ANY = f"{hit('title')} OR {hit('url')} OR coalesce(len(list_filter(links, lambda x: {hit('x.t')})) > 0, false) OR coalesce(len(list_filter(boxes, lambda b: {hit('b')})) > 0, false)"


@query("fil16_record_reject", RECORDS + f"SELECT id, title, url, {shown('links', 'boxes')} FROM r WHERE NOT ({ANY})")
def record_reject(r: Roles) -> DataFrame:
    return under(r, "reject")


KEPT = f"list_filter(links, lambda x: NOT {hit('x.t')})"


@query("fil16_record_remove", RECORDS + f"SELECT id, CASE WHEN {hit('title')} THEN '[censored]' ELSE title END AS title, CASE WHEN {hit('url')} THEN '[censored]' ELSE url END AS url, {shown(f'CASE WHEN len({KEPT}) > 0 THEN {KEPT} END', f'list_filter(boxes, lambda b: NOT {hit('b')})')} FROM r")
def record_remove(r: Roles) -> DataFrame:
    return under(r, "remove_paragraph")


@query("fil16_record_mask", RECORDS + f"SELECT id, {blocked('title')} AS title, CASE WHEN {hit('url')} THEN '[censored]' ELSE url END AS url, array_to_string(list_transform(links, lambda x: x.u || '|' || {blocked('x.t')}), chr(10)) AS links, array_to_string(list_transform(boxes, lambda b: {blocked('b')}), chr(10)) AS boxes FROM r")
def record_mask(r: Roles) -> DataFrame:
    return under(r, "mask")


SUMMARIES = "WITH m AS (SELECT c.conv_id AS id, c.turn, c.role AS title, c.text AS summary, d.text AS ocr_summary, CASE WHEN c.turn % 2 = 0 THEN c.text END AS point FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id) "


def summaries(r: Roles) -> DataFrame:
    c = r.boxes().select(F.col("parent_id").alias("id"), F.col("position").alias("turn"), F.col("kind").alias("title"), F.col("text").alias("summary"))
    d = r.texts().select("id", F.col("text").alias("ocr_summary"))
    point = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.struct(F.col("summary").alias("password")).alias("thea"), F.col("turn").alias("n"))))
    return c.join(d, "id", "left").withColumns({"key_points": point, "evidence": F.to_json(F.struct(F.array("title").alias("roles")))})


def words_hit(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{WORD}'), false)"


def words_blocked(x: str) -> str:
    for w in LISTED.listed:
        x = f"regexp_replace({x}, '(?i){w}', repeat('█', {len(w)}), 'g')"
    return x


def summary_rows(r: Roles, mode: str) -> DataFrame:
    """The summaries' texts, what is left of the JSON value of the key points, and whether the parts are there."""
    out = rd.redacted_summaries(summaries(r), LISTED, mode)
    return out.select("id", "turn", "title", "summary", "ocr_summary", F.get_json_object("key_points", "$.thea.password").alias("point"), F.col("evidence").isNotNull().alias("evidence"))


@query("fil17_summary_reject", SUMMARIES + f"SELECT *, true AS evidence FROM m WHERE NOT ({words_hit('title')} OR {words_hit('summary')} OR {words_hit('ocr_summary')})")
def summary_reject(r: Roles) -> DataFrame:
    return summary_rows(r, "reject")


@query("fil17_summary_remove", SUMMARIES + "SELECT id, turn, " + ", ".join(f"CASE WHEN {words_hit(c)} THEN '[censored]' ELSE {c} END AS {c}" for c in ("title", "summary", "ocr_summary")) + f", CASE WHEN NOT {words_hit('point')} THEN point END AS point, true AS evidence FROM m")
def summary_remove(r: Roles) -> DataFrame:
    return summary_rows(r, "remove_paragraph")


@query("fil17_summary_mask", SUMMARIES + "SELECT id, turn, " + ", ".join(f"{words_blocked(c)} AS {c}" for c in ("title", "summary", "ocr_summary", "point")) + ", true AS evidence FROM m")
def summary_mask(r: Roles) -> DataFrame:
    return summary_rows(r, "mask")


SPAN = "ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-25 00:00:00'"
TITLED = f"WITH c AS (SELECT event_id AS id, event_type AS process_name, text AS title FROM events LEFT JOIN documents ON doc_id = event_id WHERE {SPAN}) "


def ranged(r: Roles, mode: str) -> DataFrame:
    """Captures of a time range, the document of that id as their title, under both tiers."""
    at = F.expr(SPAN.replace("ts BETWEEN", "created_at BETWEEN"))
    c = r.captures().filter(at).select("id", "process_name").join(r.texts().select("id", F.col("text").alias("title")), "id", "left")
    return rd.redacted_titles(rd.redacted_titles(c, LISTED, mode), MAIL, mode)


@query("api2_range_reject", TITLED + f"SELECT * FROM c WHERE NOT {hit('title')}")
def range_reject(r: Roles) -> DataFrame:
    return ranged(r, "reject")


@query("api2_range_remove", TITLED + f"SELECT id, process_name, CASE WHEN {hit('title')} THEN '[censored]' ELSE title END AS title FROM c")
def range_remove(r: Roles) -> DataFrame:
    return ranged(r, "remove_paragraph")


@query("api2_range_mask", TITLED + f"SELECT id, process_name, {blocked('title')} AS title FROM c")
def range_mask(r: Roles) -> DataFrame:
    return ranged(r, "mask")


FOUND = f"WITH {GRAMS}, f AS (SELECT doc_id AS id, source AS title, text FROM documents WHERE doc_id IN ({strict_sql(THE)}) ORDER BY doc_id DESC LIMIT 60 OFFSET 5) "


def found(r: Roles, mode: str) -> DataFrame:
    hits = s.search(corpus(r), stored_index(r), "there", limit=60, offset=5).select("id", F.col("process_name").alias("title"), "text")
    return rd.redacted_results(hits, LISTED, MAIL, mode).select("id", "title", "text")


@query("api4_search_remove", FOUND + f"SELECT * FROM f WHERE NOT {hit('title')} AND NOT {hit('text')}")
def search_remove(r: Roles) -> DataFrame:
    return found(r, "remove_paragraph")


@query("api4_search_mask", FOUND + f"SELECT id, title, {blocked('text')} AS text FROM f WHERE NOT regexp_matches(title, '{WORD}') AND NOT regexp_matches(text, '{WORD}')")
def search_mask(r: Roles) -> DataFrame:
    return found(r, "mask")


NEAR = f"WITH {SQL_VECTORS}, q AS (SELECT vector AS qv FROM vectors WHERE id = 0), s AS (SELECT id, list_dot_product(vector, qv) AS score FROM vectors, q), b AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 50), f AS (SELECT b.id, score, source AS title, text FROM b JOIN documents ON doc_id = b.id WHERE source <> 'src3' ORDER BY score DESC, b.id LIMIT 20 OFFSET 5) "


def nearest(r: Roles, mode: str) -> DataFrame:
    """The nearest vectors' documents: over-fetched, filtered, paged, then redacted."""
    q = [float(x) for x in r.vectors().filter("id = 0").first()["vector"]]
    hits = vb.top_k(stored_blocks(r), [q], 50, normalize=False).join(r.texts().select("id", F.col("process_name").alias("title"), "text"), "id")
    page = overfetch_page(hits, F.col("title") != "src3", 5, 20)
    return rd.redacted_results(page, LISTED, MAIL, mode).select("id", F.round("score", 6).alias("score"), "title", "text")


@query("api5_search_reject", NEAR + f"SELECT id, round(score, 6) AS score, title, text FROM f WHERE NOT {hit('title')} AND NOT {hit('text')}")
def nl_reject(r: Roles) -> DataFrame:
    return nearest(r, "reject")


@query("api5_search_mask", NEAR + f"SELECT id, round(score, 6) AS score, title, {blocked('text')} AS text FROM f WHERE NOT regexp_matches(title, '{WORD}') AND NOT regexp_matches(text, '{WORD}')")
def nl_mask(r: Roles) -> DataFrame:
    return nearest(r, "mask")


TASK = "WITH a AS (SELECT event_id AS id, user_id AS task_id, ts FROM events WHERE user_id = 7), p AS (SELECT a.id, 'Renamed' AS task, source AS title, text AS title_text FROM a LEFT JOIN documents ON doc_id = a.id ORDER BY ts DESC, a.id DESC LIMIT 30) "


def members(r: Roles, mode: str) -> DataFrame:
    """A renamed task's captures, newest first, under both tiers."""
    tasks = r.captures().select(F.col("owner").alias("task_id")).distinct().withColumn("label", F.when(F.col("task_id") == 7, "Renamed").otherwise(F.concat(F.lit("task "), "task_id")))
    mine = r.captures().filter("owner = 7").orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", F.col("owner").alias("task_id"))
    rows = mine.join(tasks, "task_id").join(r.texts().select("id", F.col("text").alias("title")), "id", "left").select("id", F.col("label").alias("task"), "title")
    return rd.redacted_titles(rd.redacted_titles(rows, LISTED, mode), MAIL, mode)


@query("api7_task_reject", TASK + f"SELECT id, task, title_text AS title FROM p WHERE NOT {hit('title_text')}")
def task_reject(r: Roles) -> DataFrame:
    return members(r, "reject")


@query("api7_task_mask", TASK + f"SELECT id, task, {blocked('title_text')} AS title FROM p")
def task_mask(r: Roles) -> DataFrame:
    return members(r, "mask")
