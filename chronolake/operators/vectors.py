"""Vector search, centroids and anchor-based classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, literal, normalized


def check_dimensions(vectors: DataFrame, query: list[float]) -> None:
    """A query of another width than a non-empty store is an error."""
    row = vectors.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    if row["lo"] is not None and (row["lo"] != len(query) or row["hi"] != len(query)):
        raise ValueError(f"query has {len(query)} dimensions, the store {row['lo']} to {row['hi']}")


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``vectors`` with ``score``, the dot product with an L2-normalized query."""
    return vectors.withColumn("score", dot(F.col("vector"), literal(query)))


def top_k(vectors: DataFrame, query: list[float], k: int, floor: float | None = None, key: str = "id") -> DataFrame:
    """The ``k`` best by exact score, ties by key: each task keeps k rows."""
    if not query:
        raise ValueError("an empty query has no neighbours")
    s = scored(vectors, query)
    s = s if floor is None else s.filter(F.col("score") >= floor)
    return s.orderBy(F.desc("score"), key).limit(k)


def overfetch_page(hits: DataFrame, keep: Column, offset: int, limit: int, key: str = "id") -> DataFrame:
    """max(2t, t + 20) best hits, t = offset + limit; then the filter; then the page."""
    t = offset + limit
    best = hits.orderBy(F.desc("score"), key).limit(max(2 * t, t + 20))
    return best.filter(keep).orderBy(F.desc("score"), key).offset(offset).limit(limit)


def rescored(hits: DataFrame, scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Candidates in the order of another score, missing ones last, cut to ``k``."""
    return hits.join(scores, key, "left").orderBy(F.desc_nulls_last("rescore"), F.desc("score"), key).limit(k)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid, n): unit mean of each label's vectors, by dimension so that any size adds up."""
    each = vectors.select(label, F.posexplode("vector").alias("d", "x"))
    mean = each.groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    whole = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("o"), F.max("n").alias("n"))
    return whole.select(label, normalized(F.col("o.m")).alias("centroid"), "n")


#: Points that one row holds: what is broadcast is at most so many vectors.
POINTS_A_ROW = 4096


def packed_rows(points: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """(rows of ``_points``, arrays of at most some ``POINTS_A_ROW`` values of the column; whether it is one row): a stated set that meets each row of a table in that row."""
    n = points.count()
    pack = F.pmod(F.xxhash64(column), F.lit(-(-n // POINTS_A_ROW) or 1))
    return points.groupBy(pack.alias("_pack")).agg(F.collect_list(column).alias("_points")).drop("_pack"), n <= POINTS_A_ROW


def nearest(vectors: DataFrame, points: DataFrame, name: str, least: float) -> DataFrame:
    """(id, name, score): the best of ``points`` (name, centroid) for each vector, if at least ``least``, else -1.

    Points travel as arrays of at most ``POINTS_A_ROW``; a vector is scored
    against an array in its own row, so up to that many points nothing is
    shuffled, and beyond it a row for each array. Ties go to the smallest
    name. No points: no rows.
    """
    packs, few = packed_rows(points.select(F.struct(F.col(name).alias("name"), "centroid").alias("p")), "p")
    score = F.array_min(F.transform("_points", lambda p: F.struct((-dot(F.col("vector"), p["centroid"])).alias("s"), p["name"].alias("name"))))
    best = vectors.join(F.broadcast(packs) if few else packs).select("id", score.alias("b"))
    if not few:
        best = best.groupBy("id").agg(F.min("b").alias("b"))
    none = F.lit(-1).cast(points.schema[name].dataType)
    return best.select("id", F.when(-F.col("b.s") >= least, F.col("b.name")).otherwise(none).alias(name), (-F.col("b.s")).alias("score"))


def category_scores(queries: DataFrame, anchors: DataFrame, channel: str = "all", floor: float = 0.3, top: int = 3) -> DataFrame:
    """(id, category, score, hits): best cosine of each category plus 0.05 (weight - 1).

    ``anchors`` (category, vector, weight, scope, process_name) is the stated
    query set. Cosines under ``floor`` are dropped and ``top`` kept a category.
    Global anchors count everywhere, local ones for their own process.
    """
    a = F.struct("category", "weight", (F.col("scope") == "local").alias("local"), F.lower(F.trim("process_name")).alias("process"), F.col("vector").alias("anchor"))
    process = F.lower(F.trim("process_name"))
    mine = lambda x: x["local"] & (x["process"] != "") & (x["process"] == process)
    fits = {"all": lambda x: ~x["local"] | mine(x), "global": lambda x: ~x["local"], "local": mine}[channel]
    packs, few = packed_rows(anchors.select(a.alias("a")), "a")
    near = lambda x: F.coalesce(fits(x), F.lit(False))
    scored = F.transform(F.filter("_points", near), lambda x: F.struct(x["category"].alias("category"), x["weight"].alias("weight"), dot(F.col("vector"), x["anchor"]).alias("cos")))
    p = queries.join(F.broadcast(packs) if few else packs).select("id", F.explode(F.filter(scored, lambda x: x["cos"] >= floor)).alias("h")).select("id", "h.*")
    rank = F.row_number().over(Window.partitionBy("id", "category").orderBy(F.desc("cos"), F.desc("weight")))
    best = p.withColumn("_r", rank).filter(F.col("_r") <= top)
    return best.groupBy("id", "category").agg(F.max("cos").alias("cos"), F.max_by("weight", F.struct("cos", "weight")).alias("w"), F.count("*").alias("hits")).select("id", "category", (F.col("cos") + 0.05 * (F.col("w") - 1)).alias("score"), "hits")


def blended(local: DataFrame, everywhere: DataFrame) -> DataFrame:
    """global + boost * local, the boost 0, 0.15, 0.30 or 0.50 by 0, 1, 2-3 or 4 local categories with a score."""
    kinds = local.groupBy("id").agg(F.count_if(F.col("score") > 0).alias("kinds"))
    boost = F.when(F.col("kinds") >= 4, 0.5).when(F.col("kinds") >= 2, 0.3).when(F.col("kinds") == 1, 0.15).otherwise(0.0)
    both = everywhere.select("id", "category", F.col("score").alias("g")).join(local.select("id", "category", F.col("score").alias("l")), ["id", "category"], "full_outer").join(kinds, "id", "left")
    return both.select("id", "category", (F.coalesce("g", F.lit(0.0)) + F.coalesce(boost, F.lit(0.0)) * F.coalesce("l", F.lit(0.0))).alias("score"))


def classified(scores: DataFrame, least: float = 0.38) -> DataFrame:
    """(id, category, score): the best category, ties by name; under ``least``: unclassified."""
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b"))
    return best.select("id", F.when(-F.col("b.s") >= least, F.col("b.category")).otherwise("unclassified").alias("category"), (-F.col("b.s")).alias("score"))


#: Fixed values of the classification rule: a title below the first is helped by the text, unless a local hit of the second says the same; bonus of a process.
SURE_TITLE, LOCAL_VETO, PRIOR_BONUS, TITLE_SHARE = 0.55, 0.5, 0.12, 0.8


def _best(scores: DataFrame, category: str, score: str) -> DataFrame:
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b"))
    return best.select("id", F.col("b.category").alias(category), (-F.col("b.s")).alias(score))


def classification(queries: DataFrame, anchors: DataFrame, prior: dict[str, str], least: float = 0.38, title_share: float = TITLE_SHARE) -> DataFrame:
    """Each query's category and how it came about, one row a query.

    ``queries``: id, process_name, title_vector and text_vector, which may be
    null. The title's local and global scores are blended. Where the best of
    them is under ``SURE_TITLE``, no local hit of ``LOCAL_VETO`` or more agrees
    with it, and there is a text, the text's blend counts for the rest of
    ``title_share``. Then the category that goes with the process (``prior``,
    by lower-cased name) gets its bonus. Ties go to the first name; under
    ``least`` a query is unclassified and keeps its score.

    (id, category, score, title_category, title_score, local_category,
    local_score, vetoed, text_used, prior_category)
    """
    channel = lambda v, c: category_scores(queries.filter(F.col(v).isNotNull()).select("id", "process_name", F.col(v).alias("vector")), anchors, c)
    local = channel("title_vector", "local")
    title, text = blended(local, channel("title_vector", "global")), blended(channel("text_vector", "local"), channel("text_vector", "global"))
    process, goes = F.lower(F.trim("process_name")), F.lit(None).cast("string")
    for name, category in prior.items():
        goes = F.when(process == name, category).otherwise(goes)
    q = queries.select("id", F.col("text_vector").isNotNull().alias("_text"), goes.alias("prior_category"))
    q = q.join(_best(title, "title_category", "title_score"), "id", "left").join(_best(local, "local_category", "local_score"), "id", "left")
    q = q.withColumn("title_score", F.coalesce("title_score", F.lit(0.0)))
    unsure = F.col("title_score") < SURE_TITLE
    agrees = F.coalesce((F.col("local_score") >= LOCAL_VETO) & F.col("local_category").eqNullSafe(F.col("title_category")), F.lit(False))
    q = q.withColumns({"vetoed": unsure & F.col("_text") & agrees, "text_used": unsure & F.col("_text") & ~agrees})
    both = title.select("id", "category", F.col("score").alias("_t")).join(text.select("id", "category", F.col("score").alias("_o")), ["id", "category"], "full_outer")
    # The prior's category counts even where no anchor of it was hit.
    both = both.unionByName(q.filter("prior_category is not null").select("id", F.col("prior_category").alias("category")), allowMissingColumns=True)
    both = both.groupBy("id", "category").agg(F.max("_t").alias("_t"), F.max("_o").alias("_o"))
    j = both.join(q.select("id", "text_used", "prior_category"), "id")
    t, o = F.coalesce("_t", F.lit(0.0)), F.coalesce("_o", F.lit(0.0))
    score = F.when(F.col("text_used"), title_share * t + (1 - title_share) * o).otherwise(t) + F.when(F.col("category") == F.col("prior_category"), PRIOR_BONUS).otherwise(0.0)
    out = q.drop("_text").join(_best(j.select("id", "category", score.alias("score")), "_c", "_s"), "id", "left").withColumn("score", F.coalesce("_s", F.lit(0.0)))
    names = ("title_category", "title_score", "local_category", "local_score", "vetoed", "text_used", "prior_category")
    return out.select("id", F.when(F.col("score") >= least, F.col("_c")).otherwise("unclassified").alias("category"), "score", *names)


def cluster_summary(members: DataFrame) -> DataFrame:
    """(label, n, first, last, process_name): members (label, created_at, process_name, id) of each label, noise (-1) apart.

    The process is the most frequent non-empty one, ties by first id.
    """
    from .relations import first_wins_mode

    m = members.filter("label <> -1")
    base = m.groupBy("label").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return base.join(first_wins_mode(m, "label", "process_name", "id").drop("n"), "label", "left")
