"""Comparisons, link ranks, archives, provenance and titles, each as its whole operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import activity
from ..functions import vector as vx
from ..operators import comparison as cmp
from ..operators import redaction as rd
from ..operators import vectors as v
from ..operators.relations import first_wins_mode
from ..operators.search import score_links
from ..operators.text_assembly import text_prefix
from ..sources.indexes import stored_index
from ..sources.roles import SQL_BOXES, SQL_CAPTURES, SQL_VECTORS, Roles
from .registry import query
from .search import links

CAPS = f"WITH {SQL_CAPTURES} "
BEFORE, AFTER = 3600.0, 5400.0
TOTALS = "SELECT process_name AS name, count(*) AS n, sum(floor(value)) AS v FROM captures WHERE {} GROUP BY 1"


def delta_sql(a: str, b: str, name: str) -> str:
    rate = f"({b} / {AFTER} - {a} / {BEFORE})"
    return f"CAST({b} - {a} AS BIGINT) AS {name}_raw, round({a} / {BEFORE}, 6) AS {name}_before, round({b} / {AFTER}, 6) AS {name}_after, round({rate}, 6) AS {name}_excess, CAST(trunc({rate} * {min(BEFORE, AFTER)}) AS BIGINT) AS {name}_adjusted"


@query("joi21_named_totals", CAPS + f", a AS ({TOTALS.format("owner < 75 AND process_name <> 'view'")}), b AS ({TOTALS.format("owner >= 75 AND process_name <> 'error'")}), j AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0)::DOUBLE AS an, coalesce(b.n, 0)::DOUBLE AS bn, coalesce(a.v, 0)::DOUBLE AS av, coalesce(b.v, 0)::DOUBLE AS bv FROM a FULL JOIN b ON a.name = b.name) SELECT name, {delta_sql('an', 'bn', 'n')}, {delta_sql('av', 'bv', 'v')} FROM j")
def named_totals(r: Roles) -> DataFrame:
    """Events and bytes by process in two runs: rates, and what the second has above the first one's rate."""
    side = lambda where: r.captures().filter(where).groupBy(F.col("process_name").alias("name")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("v"))
    out = cmp.named_totals(side("owner < 75 AND process_name <> 'view'"), side("owner >= 75 AND process_name <> 'error'"), "name", ["n", "v"], BEFORE, AFTER)
    each = [c for n in ("n", "v") for c in (F.col(f"{n}.delta_raw").alias(f"{n}_raw"), F.round(f"{n}.baseline_per_second", 6).alias(f"{n}_before"), F.round(f"{n}.workload_per_second", 6).alias(f"{n}_after"), F.round(f"{n}.excess_per_second", 6).alias(f"{n}_excess"), F.col(f"{n}.adjusted_delta").alias(f"{n}_adjusted"))]
    return out.select("name", *each)


DAYS = CAPS + ", d AS (SELECT owner, CAST(floor(epoch(created_at) / 86400) AS BIGINT) AS day, CAST(sum(floor(value)) AS BIGINT) AS v FROM captures GROUP BY 1, 2), b AS (SELECT owner, v FROM d WHERE day = 19724), a AS (SELECT owner, v FROM d WHERE day = 19725), j AS (SELECT a.owner, b.v AS before, a.v AS after, CASE WHEN a.v >= b.v THEN a.v - b.v END AS delta FROM a LEFT JOIN b USING (owner)) "


def days(r: Roles) -> tuple[DataFrame, DataFrame]:
    d = r.captures().groupBy("owner", F.floor(F.unix_timestamp("created_at") / 86400).alias("day")).agg(F.sum(F.floor("value")).alias("v"))
    return cmp.counter_deltas(d.filter("day = 19724"), d.filter("day = 19725"), "owner", "v")


@query("joi22_counter_deltas", DAYS + "SELECT * FROM j")
def counter_deltas(r: Roles) -> DataFrame:
    return days(r)[0]


@query("joi22_total", DAYS + "SELECT CAST(sum(delta) AS BIGINT) AS total, count(delta) > 0 AS available FROM j")
def counter_total(r: Roles) -> DataFrame:
    return days(r)[1]


@query("joi23_agreement", """WITH j AS (SELECT doc_id, quality = 1 AS lc, n_chars > 500 AS rc, toxic = 1 AS lb, n_chars > 5000 AS rb, quality * 0.3 + toxic * 0.2 + 0.2 AS l, least(n_chars / 5000.0, 0.9) AS r FROM labels JOIN documents USING (doc_id))
 SELECT count(*) AS n, round(avg((lc = rc)::INT), 6) AS category_agreement, round(avg((lb = rb)::INT), 6) AS branch_agreement, round(max(abs(l - r)), 6) AS most_delta, count(*) FILTER ((l >= 0.38) <> (r >= 0.38)) AS crossed_38, count(*) FILTER ((l >= 0.5) <> (r >= 0.5)) AS crossed_50, count(*) FILTER ((l >= 0.55) <> (r >= 0.55)) AS crossed_55, false AS passed FROM j""")
def agreement(r: Roles) -> DataFrame:
    """Labels against a rule on lengths, of the labelled documents: shares of equal outcomes and thresholds that one side alone reaches."""
    text = r.table("documents").select("doc_id", "n_chars").join(r.table("labels").select("doc_id"), "doc_id", "left_semi")
    left = r.table("labels").join(text.select("doc_id"), "doc_id", "left_semi").select("doc_id", (F.col("quality") == 1).alias("category"), (F.col("toxic") == 1).alias("branch"), F.expr("cast(quality * 0.3 + toxic * 0.2 + 0.2 as double)").alias("confidence"))
    right = text.select("doc_id", (F.col("n_chars") > 500).alias("category"), (F.col("n_chars") > 5000).alias("branch"), F.least(F.col("n_chars") / 5000.0, F.lit(0.9)).alias("confidence"))
    return cmp.agreement(left, right, "doc_id").withColumns({c: F.round(c, 6) for c in ("category_agreement", "branch_agreement", "most_delta")})


@query("agg21_embedding_comparison", f"""WITH {SQL_VECTORS}, t AS (SELECT id, vector AS x, list_transform(vector, lambda c, i: c + CASE WHEN i = 1 + id % 64 THEN 0.001 ELSE 0 END) AS y FROM vectors), e AS (SELECT *, list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])) AS d, sqrt(list_dot_product(x, x)) AS sx, sqrt(list_dot_product(y, y)) AS sy FROM t)
 SELECT count(*) AS n, round(min(list_dot_product(x, y) / (sx * sy)), 6) AS min_cosine, round(avg(list_dot_product(x, y) / (sx * sy)), 6) AS mean_cosine, round(max(list_max(d)), 6) AS max_abs_error, round(sum(list_sum(d)) / sum(len(d)), 6) AS mean_abs_error, round(max(abs(sx - 1)), 6) AS norm_error_left, round(max(abs(sy - 1)), 6) AS norm_error_right,
 (SELECT round(max(abs(list_dot_product(a.x, b.x) - list_dot_product(a.y, b.y))), 6) FROM t a, t b) AS pairwise_delta, false AS passed FROM e""")
def embedding_comparison(r: Roles) -> DataFrame:
    """Every embedding against itself with one component moved."""
    left = r.vectors().select("id", F.col("vector").cast("array<double>").alias("vector"))
    right = left.select("id", F.transform("vector", lambda c, i: c + F.when(i == F.col("id") % 64, 0.001).otherwise(0.0)).alias("vector"))
    out = cmp.embedding_comparison(left, right)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("n", "passed")})


SERIES = {"startup": "l_quantity", "load": "l_extendedprice", "inference": "l_extendedprice * l_discount", "load_and_inference": "l_extendedprice + l_extendedprice * l_discount"}


@query("agg27_cold_runs", "SELECT l_linestatus AS backend, count(*) AS runs, " + ", ".join(f"round(quantile_cont({x}, 0.5), 2) AS {n}_p50, round(quantile_cont({x}, 0.95), 2) AS {n}_p95, round(max({x}), 2) AS {n}_most" for n, x in SERIES.items()) + " FROM lineitem GROUP BY 1")
def cold_runs(r: Roles) -> DataFrame:
    """Four series of each backend's runs, the last of them load and first inference of the same run."""
    runs = r.table("lineitem").select(F.col("l_linestatus").alias("backend"), F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.expr(x).cast("double").alias("x")) for n, x in SERIES.items()])).alias("s")).select("backend", "s.*")
    q = cmp.quantiles(runs, ["backend", "series"], "x", [0.5, 0.95])
    one = lambda n, c: F.round(F.max(F.when(F.col("series") == n, F.col(c))), 2)
    each = [one(n, c).alias(f"{n}_{k}") for n in SERIES for k, c in (("p50", "q0"), ("p95", "q1"), ("most", "most"))]
    return q.groupBy("backend").agg(F.max("n").alias("runs"), *each)


@query("top8_link_ranking")
def link_ranking(r: Roles) -> DataFrame:
    """Each page's links by score, equal ones in the order of the page."""
    texts = r.texts()
    own = links(r)
    scored = score_links(own.select("link_id", "text"), stored_index(r).frequency(), texts.agg(F.count("*").alias("n")))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "link_id"))
    return own.select("link_id", "page_id").join(scored.select("link_id", "score"), "link_id").select("link_id", "page_id", F.round("score", 6).alias("score"), place.alias("place"))


CUT = "2024-01-20 00:00:00"
CLUSTERS = f"""WITH {SQL_VECTORS}, {SQL_CAPTURES}, m AS (SELECT v.id, CAST(v.label AS BIGINT) AS label, v.vector, c.created_at AS seen FROM vectors v JOIN captures c USING (id)), e AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM m), g AS (SELECT label, d, avg(x) AS a FROM e GROUP BY 1, 2), u AS (SELECT label, max(a) / sqrt(sum(a * a)) AS most FROM g GROUP BY 1),
 k AS (SELECT label, min(seen) AS start, max(seen) AS "end", count(*) AS n FROM m WHERE seen < TIMESTAMP '2024-01-10 00:00:00' OR label % 2 = 0 GROUP BY 1) """


def layers(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Clusters of the vectors that are captures too: odd labels are seen until the tenth, even ones to the end; what is archived, and what stays hot."""
    m = r.vectors().join(r.captures().select("id", F.col("created_at").alias("at")), "id").withColumn("label", F.col("label").cast("long"))
    centre = v.centroids(m.select("label", "vector")).select("label", "centroid")
    span = m.filter("at < '2024-01-10 00:00:00' OR label % 2 = 0").groupBy("label").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"))
    return cmp.archived(span.join(centre, "label"), m.select("id", "at"), F.lit(CUT).cast("timestamp"))


@query("snk27_cold_archive", CLUSTERS + f"SELECT 'cold' AS layer, CAST(count(*) AS BIGINT) AS n FROM k WHERE \"end\" < TIMESTAMP '{CUT}' UNION ALL SELECT 'hot', count(*) FROM m WHERE seen >= TIMESTAMP '{CUT}'")
def cold_archive(r: Roles) -> DataFrame:
    cold, hot = layers(r)
    return cold.agg(F.count("*").alias("n")).select(F.lit("cold").alias("layer"), "n").unionAll(hot.agg(F.count("*").alias("n")).select(F.lit("hot"), "n"))


@query("clu13_archived_centroids", CLUSTERS + f"SELECT 'cold_cluster_' || k.label || '_' || CAST(floor(epoch(start)) AS BIGINT) AS key, k.label, n, round(most, 6) AS most FROM k JOIN u USING (label) WHERE \"end\" < TIMESTAMP '{CUT}'")
def archived_centroids(r: Roles) -> DataFrame:
    return layers(r)[0].select("key", "label", "n", F.round(F.array_max("centroid"), 6).alias("most"))


@query("clu17_provenance", """WITH s AS (SELECT * FROM (VALUES ('m1', 'r1', NULL, 'cpu'), ('m1', 'r2', 'q8', NULL)) t(a, b, c, d)), t AS (SELECT doc_id AS id, 'm1' AS a, CASE WHEN quality = 1 THEN 'r1' ELSE 'r2' END AS b, CASE WHEN toxic = 1 THEN 'q8' END AS c, CASE WHEN toxic = 0 THEN 'cpu' END AS d FROM labels)
 SELECT id, t.b AS revision FROM t JOIN s ON t.a IS NOT DISTINCT FROM s.a AND t.b IS NOT DISTINCT FROM s.b AND t.c IS NOT DISTINCT FROM s.c AND t.d IS NOT DISTINCT FROM s.d""")
def provenance(r: Roles) -> DataFrame:
    """Thresholds that a present scorer derived: model, revision, variant and provider equal, nulls included."""
    names = ["model", "revision", "variant", "provider"]
    t = r.table("labels").select(F.col("doc_id").alias("id"), F.lit("m1").alias("model"), F.when(F.col("quality") == 1, "r1").otherwise("r2").alias("revision"), F.when(F.col("toxic") == 1, "q8").alias("variant"), F.when(F.col("toxic") == 0, "cpu").alias("provider"))
    s = r.spark.createDataFrame([("m1", "r1", None, "cpu"), ("m1", "r2", "q8", None)], ", ".join(f"{n} string" for n in names))
    same = F.lit(True)
    for n in names:
        same = same & t[n].eqNullSafe(s[n])
    return t.join(F.broadcast(s), same, "left_semi").select("id", "revision")


LISTED = rd.Words(("task 7", "task 13"))


@query("api6_task_clusters", CAPS + """, t AS (SELECT owner AS task, process_name, category, created_at FROM captures WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00'), p AS (SELECT task, process_name, count(*) AS c, min(created_at) AS f FROM t GROUP BY 1, 2), d AS (SELECT task, process_name FROM p QUALIFY row_number() OVER (PARTITION BY task ORDER BY c DESC, f) = 1), g AS (SELECT task, count(*) AS n, max(created_at) AS last FROM t GROUP BY 1)
 SELECT task, n, process_name, CASE WHEN regexp_matches('Task ' || task, '(?i)(task 7|task 13)') THEN '[censored]' ELSE 'Task ' || task END AS label FROM g JOIN d USING (task) WHERE process_name IN ('view', 'click', 'error') ORDER BY n DESC, last DESC, task LIMIT 40""")
def task_clusters(r: Roles) -> DataFrame:
    """Tasks of a time range whose main process is asked for, the most relevant first, labels under the word list."""
    t = r.captures().filter("created_at >= '2024-01-05 00:00:00'").withColumnRenamed("owner", "task")
    g = t.groupBy("task").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    main = first_wins_mode(t, "task", "process_name", "created_at").select("task", "process_name")
    page = g.join(main, "task").filter(F.col("process_name").isin("view", "click", "error")).orderBy(F.desc("n"), F.desc("last"), "task").limit(40)
    rows = page.select("task", "n", "process_name", F.concat(F.lit("Task "), F.col("task").cast("string")).alias("label"))
    return rd.redacted_titles(rows, LISTED, "remove_paragraph", "label")


@query("joi19_image_hydration", f"WITH {SQL_BOXES}, {SQL_CAPTURES}, n AS (SELECT image_hash, max(id) AS id FROM captures WHERE k < 90 GROUP BY 1), w AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY parent_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM boxes WHERE text <> ''), p AS (SELECT parent_id, string_agg(text, ' ' ORDER BY position) AS body FROM w WHERE b < 1000 GROUP BY 1) SELECT n.image_hash, n.id, c.process_name, coalesce(substr(body, 1, 1000), '') AS body FROM n JOIN captures c ON c.id = n.id LEFT JOIN p ON parent_id = n.id")
def image_hydration(r: Roles) -> DataFrame:
    """Each image hash's newest live capture, its process and the first thousand characters of its text."""
    newest = r.captures().filter("k < 90").groupBy("image_hash").agg(F.max_by(F.struct("id", "process_name"), "id").alias("c")).select("image_hash", "c.*")
    body = text_prefix(r.boxes(), "parent_id", ["position"], 1000)
    return newest.join(body, newest["id"] == F.col("parent_id"), "left").select("image_hash", "id", "process_name", F.coalesce(F.substring("body", 1, 1000), F.lit("")).alias("body"))


@query("vec1_dot", f"WITH {SQL_VECTORS} SELECT a.id, round(list_dot_product(a.vector, b.vector), 6) AS dot, round(list_dot_product(a.vector, b.vector) / sqrt(list_dot_product(a.vector, a.vector) * list_dot_product(b.vector, b.vector)), 6) AS cosine FROM vectors a JOIN vectors b ON b.id = a.id + 7")
def dots(r: Roles) -> DataFrame:
    """Dot product and cosine of each vector and the one seven on."""
    a, b = r.vectors().select("id", F.col("vector").alias("x")), r.vectors().select((F.col("id") - 7).alias("id"), F.col("vector").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "id").select("id", F.round(vx.dot(x, y), 6).alias("dot"), F.round(vx.dot(vx.normalized(x), vx.normalized(y)), 6).alias("cosine"))


@query("vec2_other_widths", "SELECT vec_id AS id, vec_id % 2 = 0 AS comparable FROM embeddings")
def other_widths(r: Roles) -> DataFrame:
    """Vectors of different widths have no cosine: minus infinity, so they rank last."""
    y = F.when(F.col("id") % 2 == 0, F.col("vector")).otherwise(F.slice("vector", 1, 3))
    return r.vectors().select("id", (vx.dot(F.col("vector"), y) > float("-inf")).alias("comparable"))


@query("str24_activity_titles")
def activity_titles(r: Roles) -> DataFrame:
    """A title for every page and the four that stand with it."""
    p = r.table("pages").select(F.col("page_id").alias("key"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("window_title"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("page_url"))
    p = p.withColumn("process_name", F.element_at(F.array(*map(F.lit, ("chrome.exe", "Code.exe", "notes.exe"))), (F.col("key") % 3 + 1).cast("int")))
    current = p.withColumns({"dominant_process": F.when(F.col("key") % 4 == 0, F.col("process_name")), "task_label": F.concat(F.lit("task "), F.col("key").cast("string"))})
    beside = p.withColumn("grp", F.floor(F.col("key") / 5)).withColumnRenamed("key", "place")
    related = current.select("key", F.floor(F.col("key") / 5).alias("grp")).join(beside, "grp").filter("key <> place").select("key", "place", "process_name", "window_title", "page_url")
    return activity.activities(current.select("key", "process_name", "window_title", "page_url", "dominant_process", "task_label"), related)
