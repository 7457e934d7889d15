"""Search, link and string queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as s
from ..sources.indexes import stored_index
from ..sources.roles import Roles
from .registry import query

KEY = b"archive-key"
#: Bigrams of letters and digits in SQL.
GRAMS = r"""chars AS (SELECT doc_id AS id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}]', '', 'g') AS t FROM documents)),
 pairs AS (SELECT id, c || lead(c) OVER (PARTITION BY id ORDER BY i) AS token FROM chars WHERE c <> ''), grams AS (SELECT DISTINCT id, token FROM pairs WHERE token IS NOT NULL)"""


def corpus(r: Roles) -> DataFrame:
    """Documents as text boxes: parent is their source, time their id."""
    return r.texts().select("id", F.regexp_replace("process_name", "src", "").cast("long").alias("parent_id"), "text", "category", "process_name", F.col("id").alias("created_at"))


def links(r: Roles) -> DataFrame:
    """(link_id, page_id, url, text) of every anchor of every page."""
    a = F.regexp_extract_all("html", F.lit(r"<a href=\"([^\"]*)\"[^>]*>([^<]*)<"), F.lit(1))
    b = F.regexp_extract_all("html", F.lit(r"<a href=\"([^\"]*)\"[^>]*>([^<]*)<"), F.lit(2))
    each = r.table("pages").select("page_id", F.posexplode(F.arrays_zip(a.alias("url"), b.alias("text"))).alias("pos", "l"))
    return each.select((F.col("page_id") * 10000 + F.col("pos")).alias("link_id"), "page_id", "l.url", "l.text")


SQL_LINKS = r"""links AS (SELECT page_id * 10000 + i - 1 AS link_id, page_id, u[i] AS url, t[i] AS text FROM (SELECT page_id, u, t, unnest(range(1, len(u) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)<', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)<', 2) AS t FROM pages)))"""


def strict_sql(tokens: list[str]) -> str:
    return f"SELECT id FROM grams WHERE token IN ({', '.join(repr(t) for t in tokens)}) GROUP BY id HAVING count(*) = {len(tokens)}"


THE, AND = s.keyword_tokens("there")[0], s.keyword_tokens("ation")[0]


@query("sea3_bigram_index", f"WITH {GRAMS} SELECT token, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM grams GROUP BY token")
def bigram_index(r: Roles) -> DataFrame:
    return stored_index(r).containers().groupBy("token").agg(F.sum("n").alias("n"), F.min("low").alias("first_id"), F.max("high").alias("last_id"))


@query("set1_strict", f"WITH {GRAMS} {strict_sql(THE)}")
def strict(r: Roles) -> DataFrame:
    return s.matches(stored_index(r), THE, False).select("id")


@query("set2_fuzzy", f"WITH {GRAMS} SELECT id, count(*) AS hits FROM grams WHERE token IN ({', '.join(repr(t) for t in THE)}) GROUP BY id")
def fuzzy(r: Roles) -> DataFrame:
    return s.matches(stored_index(r), THE, True)


@query("set3_cross_keyword", f"WITH {GRAMS} SELECT DISTINCT lang AS category, source AS process_name FROM documents WHERE doc_id IN ({strict_sql(THE)}) INTERSECT SELECT DISTINCT lang, source FROM documents WHERE doc_id IN ({strict_sql(AND)})")
def cross_keyword(r: Roles) -> DataFrame:
    index, texts = stored_index(r), r.texts()
    sides = [texts.join(s.matches(index, t, False), "id", "left_semi").select("category", "process_name") for t in (THE, AND)]
    return sides[0].intersect(sides[1])


@query("set5_single_character", "SELECT doc_id AS id FROM documents WHERE false")
def single_character(r: Roles) -> DataFrame:
    return s.search(corpus(r), stored_index(r), "a").select("id")


@query("sea1_search_strict", f"WITH {GRAMS} SELECT id, source AS process_name FROM (SELECT doc_id AS id, source FROM documents WHERE lang IN ('en', 'fr') AND doc_id IN ({strict_sql(THE)}) ORDER BY doc_id DESC LIMIT 50 OFFSET 10) WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5')")
def search_strict(r: Roles) -> DataFrame:
    return s.search(corpus(r), stored_index(r), "there", categories=["en", "fr"], processes=[f"src{k}" for k in range(1, 6)], limit=50, offset=10).select("id", "process_name")


@query("sea1_search_fuzzy", f"WITH {GRAMS} SELECT g.id, count(*) AS hits FROM grams g WHERE token IN ({', '.join(repr(t) for t in THE)}) GROUP BY g.id ORDER BY hits DESC, g.id DESC LIMIT 30")
def search_fuzzy(r: Roles) -> DataFrame:
    return s.search(corpus(r), stored_index(r), "there", fuzzy=True, limit=30).select("id", "hits")


@query("sea1_search_multi", f"WITH {GRAMS}, p AS (SELECT source FROM documents WHERE doc_id IN ({strict_sql(THE)}) INTERSECT SELECT source FROM documents WHERE doc_id IN ({strict_sql(AND)})) SELECT CAST(replace(source, 'src', '') AS BIGINT) AS parent_id, max(doc_id) AS id FROM documents WHERE source IN (SELECT source FROM p) GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def search_multi(r: Roles) -> DataFrame:
    return s.search(corpus(r), stored_index(r), "there ation", limit=10).select("parent_id", "id")


@query("sea2_fallback_listing", "SELECT id FROM (SELECT doc_id AS id, source FROM documents WHERE lang = 'de' ORDER BY doc_id DESC LIMIT 40) WHERE source = 'src7' OR source = 'src8'")
def fallback(r: Roles) -> DataFrame:
    return s.search(corpus(r), stored_index(r), " ... ", categories=["de"], processes=["src7", "src8"], limit=40).select("id")


@query("agg23_document_frequency", f"WITH {GRAMS} SELECT token, count(*) AS df FROM grams GROUP BY token HAVING count(*) > 5")
def document_frequency(r: Roles) -> DataFrame:
    return stored_index(r).frequency().filter("df > 5")


ENTROPY = "(SELECT coalesce(-sum(p * log2(p)), 0) FROM (SELECT count(*) / length(any_value({0}))::DOUBLE AS p FROM (SELECT unnest(string_split({0}, '')) AS c) WHERE c <> '' GROUP BY c))"


@query("jsn3_links", f"WITH {SQL_LINKS} SELECT link_id, page_id, url, text FROM links")
def link_rows(r: Roles) -> DataFrame:
    return links(r)


@query("sea4_link_scores")
def link_scores(r: Roles) -> DataFrame:
    texts = r.texts()
    return s.score_links(links(r).select("link_id", "text"), stored_index(r).frequency(), texts.agg(F.count("*").alias("n")))


@query("str1_bigrams", f"WITH {GRAMS} SELECT id, count(*) AS n FROM grams GROUP BY id")
def bigram_counts(r: Roles) -> DataFrame:
    return r.texts().select("id", F.size(tx.bigrams(F.col("text"))).alias("n")).filter("n > 0")


@query("str4_hmac")
def hmac(r: Roles) -> DataFrame:
    return r.texts().select("id", tx.hmac_sha256(F.col("text"), KEY).alias("token_hash"))


@query("str6_md5", "SELECT doc_id AS id, md5(text) AS hash FROM documents")
def md5(r: Roles) -> DataFrame:
    return r.texts().select("id", F.md5("text").alias("hash"))


@query("str7_entropy", "WITH c AS (SELECT item_id, length(text) AS n, unnest(string_split(text, '')) AS c FROM benchmark), k AS (SELECT item_id, n, c, count(*) AS m FROM c WHERE c <> '' GROUP BY 1, 2, 3) SELECT item_id, round(-sum((m / n::DOUBLE) * log2(m / n::DOUBLE)), 6) AS bits FROM k GROUP BY 1")
def entropies(r: Roles) -> DataFrame:
    return r.table("benchmark").select("item_id", F.round(tx.entropy(F.col("text")), 6).alias("bits"))


@query("str8_entropy_penalty", "WITH c AS (SELECT item_id, length(text) AS n, unnest(string_split(text, '')) AS c FROM benchmark), k AS (SELECT item_id, n, c, count(*) AS m FROM c WHERE c <> '' GROUP BY 1, 2, 3), h AS (SELECT item_id, -sum((m / n::DOUBLE) * log2(m / n::DOUBLE)) AS h FROM k GROUP BY 1) SELECT item_id, round(exp(-0.5 * ((h - 4.0) / 1.5) * ((h - 4.0) / 1.5)), 6) AS penalty FROM h")
def penalties(r: Roles) -> DataFrame:
    return r.table("benchmark").select("item_id", F.round(tx.entropy_penalty(F.col("text")), 6).alias("penalty"))


@query("str9_index_text", "SELECT doc_id AS id, concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''), nullif(trim(substr(text, 1, 200)), '')) AS body FROM documents")
def index_text(r: Roles) -> DataFrame:
    return r.texts().select("id", tx.index_text(F.col("process_name"), F.col("category"), F.col("text")).alias("body"))


@query("str10_rerank_document", "SELECT doc_id AS id, concat_ws(' | ', nullif(source, ''), nullif(lang, ''), nullif(substr(text, 1, 600), '')) AS body FROM documents")
def rerank_document(r: Roles) -> DataFrame:
    return r.texts().select("id", tx.rerank_document(F.col("process_name"), F.col("category"), F.col("text")).alias("body"))


@query("str14_clean_snippet", r"WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' '), 1) AS i FROM documents), k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE length(w) > 1 AND regexp_matches(w, '\p{L}')) SELECT d.doc_id AS id, coalesce(substr(s.t, 1, 200), '') AS snippet FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM k WHERE p <= 24 GROUP BY 1) s ON s.doc_id = d.doc_id")
def clean_snippet(r: Roles) -> DataFrame:
    return r.texts().select("id", tx.clean_snippet(F.col("text")).alias("snippet"))


@query("fil13_informative", r"SELECT doc_id AS id FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 8 AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 4 AND len(list_distinct(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ''))) >= 4")
def informative(r: Roles) -> DataFrame:
    return r.texts().filter(tx.informative(F.col("text"))).select("id")


@query("str30_fingerprint", "SELECT doc_id AS id, sha256('v1' || chr(0) || text) AS fp FROM documents")
def fingerprints(r: Roles) -> DataFrame:
    return r.texts().select("id", tx.fingerprint(F.col("text")).alias("fp"))


@query("str20_site_name", r"SELECT page_id, CASE WHEN h = '' THEN NULL ELSE upper(substr(h, 1, 1)) || substr(string_split(h, '.')[1], 2) END AS site FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^(www|m|app)\.', '') AS h FROM pages)")
def site_names(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", tx.site_name(F.col("url")).alias("site"))


@query("str21_url_entity", "SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: length(s) BETWEEN 2 AND 48 AND lower(s) NOT IN ('search', 'home', 'index', 'en', 'fr', 'de', 'es'))[1] AS entity FROM pages")
def url_entities(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", tx.url_entity(F.col("url")).alias("entity"))


@query("str23_process_label", "SELECT DISTINCT event_type AS process_name, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS label FROM events")
def process_labels(r: Roles) -> DataFrame:
    return r.captures().select("process_name").distinct().select("process_name", tx.process_label(F.col("process_name")).alias("label"))


@query("str25_urls_in_text", """SELECT DISTINCT page_id, CASE WHEN lower(u) LIKE 'www.%' THEN 'https://' || u ELSE u END AS url FROM (SELECT page_id, unnest(regexp_extract_all(html || ' www.' || substr(url, 8), '(?i)(?:https?://|www\\.)[^ \\t\\n\\r"''<>]+')) AS u FROM pages)""")
def urls_in_text(r: Roles) -> DataFrame:
    text = F.concat("html", F.lit(" www."), F.expr("substr(url, 8)"))
    return r.table("pages").select("page_id", F.explode(tx.urls_in(text)).alias("url"))


@query("str26_path_category", "SELECT page_id, CASE WHEN contains(lower(url), '.net/') THEN 'net' WHEN contains(lower(url), 'https:') THEN 'secure' ELSE 'other' END AS category FROM pages")
def path_category(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", tx.path_category(F.col("url"), [(".net/", "net"), ("https:", "secure")]).alias("category"))


@query("str27_human_bytes", "SELECT doc_id AS id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS size FROM (SELECT doc_id, n_chars AS n FROM documents)")
def human_bytes(r: Roles) -> DataFrame:
    return r.table("documents").select(F.col("doc_id").alias("id"), tx.human_bytes(F.col("n_chars")).alias("size"))


@query("str28_lenient_int", "SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lenient_int(r: Roles) -> DataFrame:
    return r.table("events").select(F.col("event_id").alias("id"), tx.lenient_int(F.get_json_object("props", "$.k")).alias("k"))


@query("str31_blank_to_null", "SELECT doc_id AS id, nullif(trim(lang), '') AS lang FROM documents")
def blank_to_null(r: Roles) -> DataFrame:
    return r.texts().select("id", tx.blank_to_null(F.col("category")).alias("lang"))


@query("str11_link_set_key")
def link_set_keys(r: Roles) -> DataFrame:
    sets = links(r).groupBy("page_id").agg(F.collect_list(F.struct("url", "text")).alias("links"))
    return sets.select("page_id", F.sha2(tx.link_set_key(F.col("links")), 256).alias("content_hash"))


@query("jsn2_nested_get", "SELECT event_id AS id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS deep FROM events")
def nested_get(r: Roles) -> DataFrame:
    return r.table("events").select(F.col("event_id").alias("id"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("deep"))
