"""Redaction and personal-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import privacy as pv
from ..functions import spans as sp
from ..functions import words
from ..sources.roles import Roles
from .registry import query

WORDS = ["worthless", "credit card", "password", "there", "x"]
HIT = "regexp_matches(text, '(?i)(credit card|worthless|password|there)')"


@query("fil10_contains_sensitive", f"SELECT doc_id AS id FROM documents WHERE {HIT}")
def contains_sensitive(r: Roles) -> DataFrame:
    return r.texts().filter(pv.contains_any(F.col("text"), WORDS)).select("id")


@query("fil11_record_sensitive", f"SELECT doc_id AS id, ({HIT} OR regexp_matches(source, '(?i)(src7)')) AS sensitive FROM documents")
def record_sensitive(r: Roles) -> DataFrame:
    return r.texts().select("id", (pv.contains_any(F.col("text"), WORDS) | pv.contains_any(F.col("process_name"), ["src7"])).alias("sensitive"))


@query("fil12_json_sensitive", f"SELECT doc_id AS id FROM documents WHERE {HIT} OR regexp_matches(source, '(?i)(credit card|worthless|password|there)')")
def json_sensitive(r: Roles) -> DataFrame:
    json = F.to_json(F.struct(F.struct(F.col("text").alias("password")).alias("there"), F.array("process_name").alias("worthless")))
    return r.texts().filter(pv.json_contains(json, WORDS)).select("id")


@query("fil16_redact_remove", f"SELECT doc_id AS id, CASE WHEN {HIT} THEN '[censored]' ELSE text END AS text FROM documents")
def redact_remove(r: Roles) -> DataFrame:
    return r.texts().select("id", pv.redacted(F.col("text"), WORDS, "remove").alias("text"))


@query("fil16_redact_reject", f"SELECT doc_id AS id FROM documents WHERE NOT {HIT}")
def redact_reject(r: Roles) -> DataFrame:
    return r.texts().filter(~pv.contains_any(F.col("text"), WORDS)).select("id")


@query("str15_mask_words", "SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)credit card', repeat('█', 11), 'g'), '(?i)worthless', repeat('█', 9), 'g'), '(?i)password', repeat('█', 8), 'g') AS text FROM documents")
def mask_words(r: Roles) -> DataFrame:
    return r.texts().select("id", pv.masked(F.col("text"), WORDS[:3]).alias("text"))


MACHINE_KINDS = ("EMAIL", "PHONE", "IP")


@query("str16_mask_pii", r"SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', '[EMAIL]', 'g'), '(\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-?[0-9]{4})', '[PHONE]', 'g'), '\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b', '[IP]', 'g') AS text FROM documents")
def mask_pii(r: Roles) -> DataFrame:
    t = r.texts().select("id", "text").withColumn("found", sp.found(F.col("text"), MACHINE_KINDS))
    return t.select("id", sp.masked(F.col("text"), F.col("found")).alias("text"))


@query("str19_normalize_digits")
def normalize_digits(r: Roles) -> DataFrame:
    """The normalized text and the pieces of the way back to the text's own places."""
    t = r.texts().select("id", sp.normalize(F.col("text")).alias("form"))
    return t.select("id", "form.text", "form.pieces")


@query("pii10_remap")
def remap(r: Roles) -> DataFrame:
    """Entities of the normalized texts, in places of the texts."""
    t = r.texts().select("id", sp.normalize(F.col("text")).alias("form")).withColumn("found", sp.found(F.col("form.text")))
    return t.select("id", F.explode(sp.remapped(F.col("found"), F.col("form.pieces"))).alias("e")).select("id", "e.*")


def entity_rows(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.select("id", F.explode(sp.analyzed(F.col("text"), kinds)).alias("e")).select("id", "e.*")


@query("pii3_id_cards", """WITH p AS (SELECT p_partkey AS id, CAST(p_partkey * 104729 + 320112750915342 AS VARCHAR) AS s FROM part)
 SELECT id, 'ID_CARD_15' AS kind, 2 AS start, 18 AS "end", 0.35 AS score FROM p WHERE regexp_matches(s, '^[1-9][0-9]{7}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}$')""")
def id_cards(r: Roles) -> DataFrame:
    """Old cards written with a blank after the fifth digit: found in the normalized text, placed in the text."""
    s = (F.col("p_partkey") * 104729 + 320112750915342).cast("string")
    return entity_rows(r.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("证件"), F.substring(s, 1, 5), F.lit(" "), F.substring(s, 6, 10), F.lit("。")).alias("text")), "ID_CARD", "ID_CARD_15")


@query("pii4_mobile_landline", """SELECT o_orderkey AS id, 'MOBILE' AS kind, 2 AS start, 14 AS "end", 0.5 AS score FROM orders WHERE substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '3'), 1, 1) BETWEEN '3' AND '9'
 UNION ALL SELECT o_orderkey, 'LANDLINE', 15, 27, 0.3 FROM orders""")
def mobile_landline(r: Roles) -> DataFrame:
    n = F.lpad(F.col("o_orderkey").cast("string"), 9, "3")
    text = F.concat(F.lit("电话1"), F.substring(n, 1, 2), F.lit("-"), F.substring(n, 3, 7), F.lit("0，"), F.lit("0"), F.lit("21－"), F.lpad(F.col("o_orderkey").cast("string"), 8, "6"))
    text = F.translate(text, "－", "-")
    return entity_rows(r.table("orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "MOBILE", "LANDLINE")


LUHN = "list_reduce(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substr(s, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(s, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(s, i, 1) AS INTEGER) * 2 END ELSE CAST(substr(s, i, 1) AS INTEGER) END), lambda a, b: a + b)"


@query("pii6_bank_cards", f"""WITH c AS (SELECT p_partkey AS id, CAST(p_partkey * 3 + 4111111111111111 AS VARCHAR) AS s FROM part) SELECT id, 'BANK_CARD' AS kind, 3 AS start, 22 AS "end", 0.3 AS score FROM c WHERE {LUHN} % 10 = 0""")
def bank_cards(r: Roles) -> DataFrame:
    s = (F.col("p_partkey") * 3 + 4111111111111111).cast("string")
    grouped = F.concat_ws("-", *[F.substring(s, k, 4) for k in (1, 5, 9, 13)])
    return entity_rows(r.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("卡号 "), grouped).alias("text")), "BANK_CARD")


@query("pii7_names", """SELECT c_custkey AS id, 'NAME' AS kind, CASE WHEN c_nationkey % 3 = 0 THEN 3 ELSE 0 END AS start, CASE WHEN c_nationkey % 3 = 0 THEN 5 ELSE 3 END AS "end", 0.55 AS score FROM customer WHERE c_nationkey % 3 < 2""")
def people(r: Roles) -> DataFrame:
    """A surname with a word for persons before it, ten characters after it, or eleven: the last is no name."""
    n = F.col("c_nationkey") % 3
    text = F.when(n == 0, F.concat(F.lit("用户名王明 "), F.col("c_name"))).when(n == 1, F.concat(F.lit("欧阳明"), F.repeat(F.lit("-"), F.lit(8)), F.lit("先生"))).otherwise(F.concat(F.lit("欧阳明"), F.repeat(F.lit("-"), F.lit(9)), F.lit("先生")))
    return entity_rows(r.table("customer").select(F.col("c_custkey").alias("id"), text.alias("text")), "NAME")


@query("pii8_addresses", """SELECT s_suppkey AS id, 'ADDRESS' AS kind, 0 AS start, 14 + length(CAST(s_suppkey AS VARCHAR)) AS "end", 0.7 AS score FROM supplier WHERE s_nationkey % 2 = 0""")
def places(r: Roles) -> DataFrame:
    text = F.concat(F.lit("江苏省南京市"), F.when(F.col("s_nationkey") % 2 == 0, "江宁区").otherwise("江宁"), F.lit("天元大路"), F.col("s_suppkey").cast("string"), F.lit("号，"), F.col("s_name"))
    return entity_rows(r.table("supplier").select(F.col("s_suppkey").alias("id"), text.alias("text")), "ADDRESS")


@query("pii1_id_card", "WITH c AS (SELECT p_partkey AS id, lpad(CAST((p_partkey * 7919 + 11010119900101000) AS VARCHAR), 17, '0') AS s FROM part), k AS (SELECT id, s, list_reduce(list_transform([7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2], lambda w, i: w * CAST(substr(s, i, 1) AS INTEGER)), lambda a, b: a + b) % 11 AS m FROM c) SELECT id, substr('10X98765432', CAST(m + 1 AS INTEGER), 1) = '1' AS valid FROM k")
def id_card(r: Roles) -> DataFrame:
    s = F.concat((F.col("p_partkey") * 7919 + 11010119900101000).cast("string"), F.lit("1"))
    return r.table("part").select(F.col("p_partkey").alias("id"), pv.id_card(s).alias("valid"))


@query("pii2_id_card_15", "SELECT p_partkey AS id, (CAST(substr(s, 9, 2) AS INTEGER) BETWEEN 1 AND 12 AND CAST(substr(s, 11, 2) AS INTEGER) BETWEEN 1 AND 31) AS valid FROM (SELECT p_partkey, CAST(p_partkey * 104729 + 320112750915342 AS VARCHAR) AS s FROM part)")
def id_card_15(r: Roles) -> DataFrame:
    s = (F.col("p_partkey") * 104729 + 320112750915342).cast("string")
    return r.table("part").select(F.col("p_partkey").alias("id"), pv.id_card_15(s).alias("valid"))


@query("pii5_luhn", "WITH c AS (SELECT p_partkey AS id, CAST(p_partkey * 3 + 4111111111111111 AS VARCHAR) AS s FROM part) SELECT id, list_reduce(list_transform(range(1, 17), lambda i: CASE WHEN (16 - i) % 2 = 1 THEN CASE WHEN CAST(substr(s, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(s, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(s, i, 1) AS INTEGER) * 2 END ELSE CAST(substr(s, i, 1) AS INTEGER) END), lambda a, b: a + b) % 10 = 0 AS valid FROM c")
def luhn(r: Roles) -> DataFrame:
    return r.table("part").select(F.col("p_partkey").alias("id"), pv.luhn((F.col("p_partkey") * 3 + 4111111111111111).cast("string")).alias("valid"))


@query("pii4_phones", r"SELECT doc_id AS id, unnest(regexp_extract_all(text, '(\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})', 1)) AS value FROM documents")
def phones(r: Roles) -> DataFrame:
    found = F.filter(pv.entities(F.col("text")), lambda e: e["kind"] == "PHONE")
    return r.texts().select("id", F.explode(found).alias("e")).select("id", "e.value")


@query("pii9_decision", r"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})') OR regexp_matches(text, '(\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})') OR regexp_matches(text, '\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b')")
def decision(r: Roles) -> DataFrame:
    found = F.filter(pv.entities(F.col("text")), lambda e: e["kind"].isin("EMAIL", "PHONE", "IP"))
    return r.texts().filter(pv.has_pii(found)).select("id")


@query("pii11_analyze")
def analyze(r: Roles) -> DataFrame:
    """Entities of every kind, in places of the texts."""
    return entity_rows(r.texts().select("id", "text"), *sp.KINDS)


BANNED = "SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 9 AND regexp_full_match(w, '[a-z]+')"


@query("fil10_long_list", f"WITH w AS ({BANNED}) SELECT doc_id AS id FROM documents WHERE EXISTS (SELECT 1 FROM w WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), w.w))")
def long_list(r: Roles) -> DataFrame:
    """Texts with any of the long words of the benchmark: a list of hundreds, one automaton."""
    w = r.table("benchmark").select(F.explode(F.split("text", " ")).alias("w")).filter("length(w) >= 9 AND w rlike '^[a-z]+$'").distinct()
    # A word list is configuration: it comes to the driver, as it does from its file.
    return r.texts().filter(words.contains(F.col("text"), [x["w"] for x in w.collect()])).select("id")


@query("set7_word_list", "SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 2")
def word_list(r: Roles) -> DataFrame:
    w = r.table("benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return w.filter(F.length("word") >= 2).distinct().orderBy("word")
