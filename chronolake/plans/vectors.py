"""Vector, clustering and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as vx
from ..operators import density as dn
from ..operators import similarity as si
from ..operators import vector_blocks as vb
from ..operators import vectors as v
from ..sources.indexes import stored_blocks
from ..sources.roles import SQL_VECTORS, Roles
from .registry import query

Q = f"WITH {SQL_VECTORS}, q AS (SELECT vector AS qv FROM vectors WHERE id = 0), s AS (SELECT id, label, list_dot_product(vector, qv) AS score FROM vectors, q) "
#: Anchors: the vectors that the benchmark names, a stated set.
SQL_ANCHORS = f"{SQL_VECTORS}, anchors AS (SELECT id AS anchor, CAST(label AS VARCHAR) AS category, vector AS av, 1.0 + label / 10.0 AS weight, CASE WHEN label % 2 = 0 THEN 'local' ELSE 'global' END AS scope, 'p' || CAST(label AS VARCHAR) AS process_name FROM vectors WHERE id IN (SELECT item_id FROM benchmark)), qs AS (SELECT id, vector, 'p' || CAST(label AS VARCHAR) AS process_name FROM vectors)"


def first_vector(r: Roles) -> list[float]:
    return [float(x) for x in r.vectors().filter("id = 0").first()["vector"]]


def stated(r: Roles) -> DataFrame:
    """The vectors that the benchmark names: the stated set of anchors."""
    return r.vectors().join(r.table("benchmark").select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")


def anchors(r: Roles) -> DataFrame:
    return stated(r).select(F.col("label").cast("string").alias("category"), "vector", (1.0 + F.col("label") / 10.0).alias("weight"), F.when(F.col("label") % 2 == 0, "local").otherwise("global").alias("scope"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("process_name"))


def subjects(r: Roles) -> DataFrame:
    return r.vectors().select("id", "vector", F.concat(F.lit("p"), F.col("label").cast("string")).alias("process_name"))


@query("top1_text_topk", Q + "SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 26")
def topk(r: Roles) -> DataFrame:
    return vb.top_k(stored_blocks(r), [first_vector(r)], 26, normalize=False).select("id", F.round("score", 6).alias("score"))


@query("top2_image_topk", Q + "SELECT id, round(score, 6) AS score FROM s WHERE label = 1 ORDER BY s.score DESC, id LIMIT 10")
def image_topk(r: Roles) -> DataFrame:
    return v.top_k(r.vectors().filter("label = 1"), first_vector(r), 10).select("id", F.round("score", 6).alias("score"))


@query("top3_ties", Q + "SELECT id, round(score, 1) AS score FROM s ORDER BY round(s.score, 1) DESC, id LIMIT 40")
def ties(r: Roles) -> DataFrame:
    s = v.scored(r.vectors(), first_vector(r)).withColumn("score", F.round("score", 1))
    return s.orderBy(F.desc("score"), "id").limit(40).select("id", "score")


@query("fil4_similarity_floor", Q + "SELECT id FROM s WHERE score >= 0.1")
def floor(r: Roles) -> DataFrame:
    return v.scored(r.vectors(), first_vector(r)).filter("score >= 0.1").select("id")


@query("top6_overfetch", Q + "SELECT id FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 50) WHERE label IN (1, 2, 3) ORDER BY score DESC, id LIMIT 20 OFFSET 5")
def overfetch(r: Roles) -> DataFrame:
    hits = v.scored(r.vectors(), first_vector(r))
    return v.overfetch_page(hits, F.col("label").isin(1, 2, 3), 5, 20).select("id")


@query("top7_rescore", Q + ", c AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 40) SELECT c.id FROM c LEFT JOIN labels l ON l.doc_id = c.id ORDER BY l.quality + c.id / 1e6 DESC NULLS LAST, c.score DESC, c.id LIMIT 10")
def rescore(r: Roles) -> DataFrame:
    scores = r.table("labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("doc_id") / 1e6).alias("rescore"))
    return v.rescored(v.top_k(r.vectors(), first_vector(r), 40), scores, 10).select("id")


@query("joi18_hydrate", Q + ", t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 50) SELECT t.id, round(1 - t.score, 6) + 0.0 AS distance, coalesce(d.source, '') AS process_name FROM t JOIN documents d ON d.doc_id = t.id")
def hydrate(r: Roles) -> DataFrame:
    t = r.texts().select("id", "process_name")
    return v.top_k(r.vectors(), first_vector(r), 50).join(t, "id").select("id", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"), F.coalesce("process_name", F.lit("")).alias("process_name"))


@query("agg16_centroids", f"WITH {SQL_VECTORS}, e AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM vectors), m AS (SELECT label, d, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2) SELECT label, max(n) AS n, round(max(m) / sqrt(sum(m * m)), 6) AS most FROM m GROUP BY 1")
def centroid_rows(r: Roles) -> DataFrame:
    return v.centroids(r.vectors()).select("label", "n", F.round(F.array_max("centroid"), 6).alias("most"))


@query("joi24_nearest_centroid", f"WITH {SQL_VECTORS}, e AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM vectors), m AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY d) AS c FROM m GROUP BY 1), p AS (SELECT v.id, c.label, list_dot_product(v.vector, c.c) / sqrt(list_dot_product(c.c, c.c)) AS s FROM vectors v, c), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS p FROM p) SELECT id, CASE WHEN s >= 0.2 THEN label ELSE -1 END AS label, round(s, 6) AS score FROM o WHERE p = 1")
def nearest_centroid(r: Roles) -> DataFrame:
    return v.nearest(r.vectors().select("id", "vector"), v.centroids(r.vectors()), "label", 0.2).select("id", "label", F.round("score", 6).alias("score"))


@query("joi25_best_centroid", f"WITH {SQL_VECTORS}, q AS (SELECT vector AS qv FROM vectors WHERE id = 5), e AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM vectors), m AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY d) AS c FROM m GROUP BY 1) SELECT label, round(list_dot_product(qv, c) / sqrt(list_dot_product(c, c)), 6) AS score FROM c, q ORDER BY 2 DESC, 1 LIMIT 1")
def best_centroid(r: Roles) -> DataFrame:
    q = [float(x) for x in r.vectors().filter("id = 5").first()["vector"]]
    c = v.centroids(r.vectors()).select("label", F.col("centroid").alias("vector"))
    return v.top_k(c, q, 1, key="label").select("label", F.round("score", 6).alias("score"))


@query("joi26_prefilter", f"WITH {SQL_ANCHORS} SELECT a.anchor, q.id FROM anchors a, qs q WHERE list_dot_product(a.av, q.vector) >= 0.3")
def prefilter(r: Roles) -> DataFrame:
    packs, few = v.packed_rows(stated(r).select(F.struct(F.col("id").alias("anchor"), F.col("vector").alias("av")).alias("a")), "a")
    near = F.filter("_points", lambda a: vx.dot(a["av"], F.col("vector")) >= 0.3)
    return r.vectors().join(F.broadcast(packs) if few else packs).select("id", F.explode(near).alias("a")).select("a.anchor", "id")


@query("win5_topk_per_category", f"WITH {SQL_ANCHORS}, p AS (SELECT q.id, a.category, a.weight, list_dot_product(q.vector, a.av) AS cos FROM qs q JOIN anchors a ON a.scope <> 'local' OR a.process_name = q.process_name), r AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY cos DESC, weight DESC) AS rn FROM p WHERE cos >= 0.3) SELECT id, category, round(max(cos) + 0.05 * (arg_max(weight, cos) - 1), 6) AS score, count(*) AS hits FROM r WHERE rn <= 3 GROUP BY 1, 2")
def topk_per_category(r: Roles) -> DataFrame:
    return v.category_scores(subjects(r), anchors(r)).withColumn("score", F.round("score", 6))


@query("clu4_classify", f"WITH {SQL_ANCHORS}, p AS (SELECT q.id, a.category, a.weight, list_dot_product(q.vector, a.av) AS cos FROM qs q JOIN anchors a ON a.scope <> 'local' OR a.process_name = q.process_name), r AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY cos DESC, weight DESC) AS rn FROM p WHERE cos >= 0.3), s AS (SELECT id, category, max(cos) + 0.05 * (arg_max(weight, cos) - 1) AS score FROM r WHERE rn <= 3 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS p FROM s) SELECT id, CASE WHEN score >= 0.38 THEN category ELSE 'unclassified' END AS category, round(score, 6) AS score FROM o WHERE p = 1")
def classify(r: Roles) -> DataFrame:
    return v.classified(v.category_scores(subjects(r), anchors(r))).withColumn("score", F.round("score", 6))


@query("clu5_channel_blend")
def channel_blend(r: Roles) -> DataFrame:
    return v.blended(v.category_scores(subjects(r), anchors(r), "local"), v.category_scores(subjects(r), anchors(r), "global")).withColumn("score", F.round("score", 6))


@query("agg16_cluster_summary", "WITH m AS (SELECT user_id % 10 AS label, ts, event_type, event_id FROM events), c AS (SELECT label, event_type, count(*) AS n, min(event_id) AS f FROM m GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, f) AS p FROM c) SELECT m.label, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, any_value(o.event_type) AS process_name FROM m JOIN o ON o.label = m.label AND o.p = 1 GROUP BY 1")
def cluster_summary(r: Roles) -> DataFrame:
    m = r.captures().select((F.col("owner") % 10).alias("label"), "created_at", "process_name", "id")
    return v.cluster_summary(m).withColumns({k: F.unix_timestamp(k) for k in ("first", "last")})


@query("vec5_normalize", f"WITH {SQL_VECTORS} SELECT id, round(list_dot_product(vector, vector) / list_dot_product(vector, vector), 6) AS length FROM vectors")
def normalize(r: Roles) -> DataFrame:
    u = r.vectors().withColumn("u", vx.normalized(F.transform("vector", lambda x: x * 3)))
    return u.select("id", F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("length"))


@query("vec8_hamming", "SELECT e.event_id AS id, bit_count(xor(e.event_id, e.user_id)) + bit_count(xor(e.user_id, CAST(json_extract_string(props, '$.k') AS BIGINT))) AS distance FROM events e")
def hamming(r: Roles) -> DataFrame:
    c = r.captures().withColumn("k", F.col("k").cast("long"))
    return c.select("id", vx.hamming(F.array("id", "owner"), F.array("owner", "k")).alias("distance"))


@query("vec9_threshold", "WITH g AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN value END) AS p, max(CASE WHEN event_type = 'click' THEN value / 50 END) AS n FROM events GROUP BY 1) SELECT user_id AS owner, round(CASE WHEN p IS NOT NULL THEN greatest(p * 0.85, coalesce(n * 1.05, p * 0.85)) END, 6) AS threshold FROM g")
def thresholds(r: Roles) -> DataFrame:
    g = r.captures().groupBy("owner").agg(F.collect_list(F.when(F.col("process_name") == "view", F.col("value"))).alias("p"), F.collect_list(F.when(F.col("process_name") == "click", F.col("value") / 50)).alias("n"))
    return g.select("owner", F.round(vx.threshold(F.col("p"), F.col("n")), 6).alias("threshold"))


@query("vec11_backfill_seconds", "SELECT o_orderkey AS id, CAST(greatest(floor(o_custkey * 0.15 + o_totalprice / 1e6 * 0.25 + 0.5), 0) AS BIGINT) AS seconds FROM orders")
def backfill_seconds(r: Roles) -> DataFrame:
    return r.parents().select("id", vx.backfill_seconds(F.col("owner"), F.col("weight") / 1e6).alias("seconds"))


@query("vec12_nice_bucket", "SELECT event_id AS id, CASE WHEN value * 1e7 / 150 <= 60000 THEN 60000 WHEN value * 1e7 / 150 <= 300000 THEN 300000 WHEN value * 1e7 / 150 <= 900000 THEN 900000 WHEN value * 1e7 / 150 <= 1800000 THEN 1800000 WHEN value * 1e7 / 150 <= 3600000 THEN 3600000 WHEN value * 1e7 / 150 <= 21600000 THEN 21600000 ELSE 86400000 END AS bucket FROM events")
def nice_bucket(r: Roles) -> DataFrame:
    return r.captures().select("id", vx.nice_bucket(F.col("value") * 1e7).alias("bucket"))


PRIOR = {"p1": "1", "p2": "7"}
SQL_CHANNELS = f"""WITH {SQL_ANCHORS}, sides AS (SELECT id, process_name, 'title' AS side, vector FROM qs UNION ALL SELECT id, process_name, 'text', list_reverse(vector) FROM qs WHERE id % 3 <> 0),
 p AS (SELECT q.id, q.side, a.scope, a.category, a.weight, list_dot_product(q.vector, a.av) AS cos FROM sides q JOIN anchors a ON a.scope <> 'local' OR a.process_name = q.process_name),
 g AS (SELECT id, side, scope, category, max(cos) + 0.05 * (arg_max(weight, cos * 1000 + weight / 1000) - 1) AS score FROM p WHERE cos >= 0.3 GROUP BY ALL),
 kinds AS (SELECT id, side, count(*) FILTER (WHERE score > 0) AS n FROM g WHERE scope = 'local' GROUP BY ALL),
 b AS (SELECT id, side, category, sum(CASE WHEN scope = 'local' THEN 0 ELSE score END) + coalesce(max(CASE WHEN n >= 4 THEN 0.5 WHEN n >= 2 THEN 0.3 WHEN n = 1 THEN 0.15 END), 0) * sum(CASE WHEN scope = 'local' THEN score ELSE 0 END) AS score FROM g LEFT JOIN kinds USING (id, side) GROUP BY id, side, category),
 best AS (SELECT id, category AS title_category, score AS title_score FROM b WHERE side = 'title' QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, category) = 1),
 lbest AS (SELECT id, category AS local_category, score AS local_score FROM g WHERE side = 'title' AND scope = 'local' QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, category) = 1),
 q AS (SELECT qs.id, title_category, coalesce(title_score, 0) AS title_score, local_category, local_score, CASE process_name WHEN 'p1' THEN '1' WHEN 'p2' THEN '7' END AS prior_category,
   coalesce(title_score, 0) < 0.55 AND qs.id % 3 <> 0 AS open, coalesce(local_score >= 0.5 AND local_category = title_category, false) AS agrees FROM qs LEFT JOIN best USING (id) LEFT JOIN lbest USING (id)),
 cats AS (SELECT id, category FROM b UNION SELECT id, prior_category FROM q WHERE prior_category IS NOT NULL),
 f AS (SELECT c.id, c.category, CASE WHEN q.open AND NOT q.agrees THEN 0.8 * coalesce(t.score, 0) + (1 - 0.8) * coalesce(o.score, 0) ELSE coalesce(t.score, 0) END + CASE WHEN c.category = q.prior_category THEN 0.12 ELSE 0 END AS score
   FROM cats c JOIN q USING (id) LEFT JOIN b t ON t.id = c.id AND t.category = c.category AND t.side = 'title' LEFT JOIN b o ON o.id = c.id AND o.category = c.category AND o.side = 'text'),
 w AS (SELECT id, category AS c, score FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, category) = 1) """


def classified_rows(r: Roles) -> DataFrame:
    q = subjects(r).select("id", "process_name", F.col("vector").alias("title_vector"), F.when(F.col("id") % 3 != 0, F.reverse("vector")).alias("text_vector"))
    out = v.classification(q, anchors(r), PRIOR)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "title_score", "local_score")})


@query("clu4_classification", SQL_CHANNELS + "SELECT q.id, CASE WHEN coalesce(score, 0) >= 0.38 THEN c ELSE 'unclassified' END AS category, round(coalesce(score, 0), 6) AS score FROM q LEFT JOIN w USING (id)")
def classification(r: Roles) -> DataFrame:
    return classified_rows(r).select("id", "category", "score")


@query("clu16_trace", SQL_CHANNELS + "SELECT q.id, CASE WHEN coalesce(score, 0) >= 0.38 THEN c ELSE 'unclassified' END AS category, round(coalesce(score, 0), 6) AS score, title_category, round(title_score, 6) AS title_score, local_category, round(local_score, 6) AS local_score, open AND agrees AS vetoed, open AND NOT agrees AS text_used, prior_category FROM q LEFT JOIN w USING (id)")
def trace(r: Roles) -> DataFrame:
    return classified_rows(r)


def feedback(r: Roles) -> DataFrame:
    """Each vector as a correction: its label the category, what it says in three ways."""
    turned = F.reverse("vector")
    return r.vectors().select(
        F.col("id").alias("seq"), F.col("label").cast("string").alias("category"), F.concat(F.lit("title "), "id").alias("title"), F.concat(F.lit("clean "), "id").alias("clean_title"),
        (F.col("id") % 2 == 0).alias("informative"), F.repeat(F.lit("text "), 5).alias("ocr_text"), F.when(F.col("id") % 4 != 3, F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))).alias("process_name"),
        F.col("vector").alias("title_vector"), F.col("vector").alias("clean_vector"), turned.alias("ocr_vector"),
    )


@query("clu8_anchor_learning")
def anchor_learning(r: Roles) -> DataFrame:
    """All corrections learned in their order, none like an anchor of its category and scope; the stated vectors are anchors before."""
    old = stated(r).select((F.col("id") - (1 << 40)).alias("id"), F.col("label").cast("string").alias("category"), F.lit("global").alias("scope"), F.lit("").alias("process_name"), "vector")
    asked = si.anchor_candidates(feedback(r))
    return si.learned_anchors(old, asked).select("id", "category", "scope", "process_name", "text", "weight", "source")


@query("clu1_density_clusters")
def density_clusters(r: Roles) -> DataFrame:
    """Every vector's density cluster; null is noise."""
    out = dn.clusters(r.vectors().select("id", "vector"), 5, 3, 0.3, steps=3)
    return out.select("id", "cluster", F.round("stability", 6).alias("stability"))


@query("clu2_sampled_clusters")
def sampled_clusters(r: Roles) -> DataFrame:
    """Clusters of a sample by hash; all other vectors go to the nearest cluster's centroid, or to none."""
    vectors = r.vectors().select("id", "vector")
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    found = dn.clusters(sample, 5, 2, 0.28, steps=3).select("id", "cluster")
    centres = v.centroids(vectors.join(found.filter("cluster is not null"), "id"), "cluster")
    rest = v.nearest(vectors.join(sample.select("id"), "id", "left_anti"), centres, "cluster", 0.3)
    return found.unionByName(rest.select("id", F.nullif(F.col("cluster"), F.lit("-1")).alias("cluster")))


@query("clu11_text_neighbours", Q + ", c AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 40) SELECT c.id, round(c.score, 6) AS score, l.quality + c.id / 1e6 AS rescore FROM c LEFT JOIN labels l ON l.doc_id = c.id ORDER BY l.quality + c.id / 1e6 DESC NULLS LAST, c.score DESC, c.id LIMIT 10")
def text_neighbours(r: Roles) -> DataFrame:
    """The query's 40 nearest by exact score, ordered anew by another score, 10 of them."""
    scores = r.table("labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("doc_id") / 1e6).alias("rescore"))
    return v.rescored(vb.top_k(stored_blocks(r), [first_vector(r)], 40, normalize=False).drop("query"), scores, 10).select("id", F.round("score", 6).alias("score"), "rescore")


@query("clu12_image_neighbours", f"WITH {SQL_VECTORS}, q AS (SELECT id AS query_id, vector AS qv FROM vectors WHERE id IN (SELECT item_id FROM benchmark)), s AS (SELECT query_id, id, list_dot_product(vector, qv) AS score FROM vectors, q) SELECT query_id, id, round(1 - score, 6) + 0.0 AS distance, round(score, 6) AS similarity FROM s WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def image_neighbours(r: Roles) -> DataFrame:
    """The ten nearest vectors of each that the benchmark names, none under the floor: one scan for all."""
    asked = sorted((x["id"], [float(c) for c in x["vector"]]) for x in stated(r).collect())
    hits = vb.top_k(stored_blocks(r), [q for _, q in asked], 10, 0.15, normalize=False)
    number = F.element_at(F.array(*[F.lit(i).cast("long") for i, _ in asked]), F.col("query") + 1) if asked else F.lit(None).cast("long")
    return hits.select(number.alias("query_id"), "id", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"), F.round("score", 6).alias("similarity"))
