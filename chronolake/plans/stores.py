"""Queries over stores that change by fenced commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators.changes import ChangeLog, deleted_range, finalized
from ..operators.fenced import CONTRACT, KEY, DerivedIndex
from ..operators.ledger import pending_insert
from ..operators.scoring import ScoringQueue, enabled_pairs
from ..functions.rules import member
from ..sources import line_files
from ..sources.checkpoints import folder
from ..sources.roles import SQL_CAPTURES, SQL_CHILDREN, SQL_PARENTS, Roles
from ..sources.snapshots import Snapshots
from ..streaming import frames, queue
from .registry import query
from ..operators.relations import expired_subjects
from .relations import CUTOFF, NOW, SQL_LEDGER, ledger

DUE = f"status IN ('pending', 'failed', 'waiting_for_auth') AND (next_retry_at IS NULL OR next_retry_at <= {NOW})"
KIND = "CAST(subject_key AS BIGINT) % 4"
RETRY = 60


def vectors(docs: DataFrame, last: float) -> DataFrame:
    """A vector for each document: its length and a mark of who wrote it."""
    return docs.select(*KEY, *CONTRACT, F.array(F.col("n_chars").cast("double"), F.lit(last)).alias("vector"))


def claimed(r: Roles) -> tuple[DerivedIndex, DataFrame, int]:
    """A store of the documents' vectors and the labels' jobs, whose due ones are claimed; documents; the token."""
    docs, jobs = ledger(r)
    index = DerivedIndex(Snapshots(r.spark, f"{folder(r.spark)}/derived-{uuid.uuid4().hex}"))
    index.seed(jobs, vectors(docs, 0.0))
    return index, docs, index.claim(F.timestamp_seconds(F.lit(NOW)))


def completed(r: Roles) -> DerivedIndex:
    """The same with the vectors of every third claimed job written."""
    index, docs, token = claimed(r)
    mine = index.jobs().filter((F.col("lease_token") == token) & (F.col("subject_key").cast("long") % 3 == 0)).select(*KEY, *CONTRACT, F.lit(token).cast("long").alias("token"))
    index.complete(mine.join(vectors(docs, 1.0).select(*KEY, "vector"), KEY), docs.select(*KEY))
    return index


@query("stm2_claim", SQL_LEDGER + f"SELECT subject_key, CASE WHEN {DUE} THEN 'processing' ELSE status END AS status, CASE WHEN {DUE} THEN 1 END AS lease_token, CASE WHEN NOT ({DUE}) THEN next_retry_at END AS retry_at FROM jobs")
def claim(r: Roles) -> DataFrame:
    return claimed(r)[0].jobs().select("subject_key", "status", "lease_token", F.unix_timestamp("next_retry_at").alias("retry_at"))


@query("stm3_settle", SQL_LEDGER + f""", c AS (SELECT *, {DUE} AS mine, {KIND} AS n FROM jobs)
 SELECT subject_key, CASE WHEN mine THEN CASE n WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' WHEN 2 THEN 'waiting_for_auth' ELSE 'discarded' END ELSE status END AS status,
   attempts + CASE WHEN mine AND n = 1 THEN 1 ELSE 0 END AS attempts, CASE WHEN mine AND n = 0 THEN 1 END AS lease_token,
   CASE WHEN mine THEN CASE WHEN n IN (1, 2) THEN {NOW + RETRY} END ELSE next_retry_at END AS retry_at FROM c""")
def settle(r: Roles) -> DataFrame:
    index, _, token = claimed(r)
    n = F.col("subject_key").cast("long") % 4
    mine = index.jobs().filter((F.col("lease_token") == token) & (n != 0))
    new = F.when(n == 1, "failed").when(n == 2, "waiting_for_auth").otherwise("discarded")
    retry = F.when(n != 3, F.timestamp_seconds(F.lit(NOW + RETRY)))
    index.settle(mine.select(*KEY, *CONTRACT, F.lit(token).cast("long").alias("token"), new.alias("new_status"), retry.alias("retry_at")))
    return index.jobs().select("subject_key", "status", "attempts", "lease_token", F.unix_timestamp("next_retry_at").alias("retry_at"))


WRITTEN = SQL_LEDGER + f", s AS (SELECT *, {DUE} AS mine, CAST(subject_key AS BIGINT) % 3 = 0 AS third FROM jobs), w AS (SELECT subject_key, fp, CASE WHEN mine AND third THEN 'completed' WHEN mine THEN 'processing' ELSE status END AS status, mine AND third AS new FROM s) "


@query("snk17_guarded_upsert", WRITTEN + "SELECT d.subject_key, w.status, n_chars, CASE WHEN w.new THEN w.fp ELSE d.fp END AS fp, CASE WHEN w.new THEN 1 ELSE 0 END AS mark FROM docs d LEFT JOIN w ON w.subject_key = d.subject_key")
def guarded_upsert(r: Roles) -> DataFrame:
    index = completed(r)
    rows = index.vectors().join(index.jobs().select(*KEY, "status"), KEY, "left")
    return rows.select("subject_key", "status", F.col("vector")[0].cast("long").alias("n_chars"), F.col("source_fingerprint").alias("fp"), F.col("vector")[1].cast("int").alias("mark"))


@query("snk18_publish_generation", WRITTEN + """, v AS (SELECT d.subject_key, sha256('[' || n_chars || '.0, ' || CASE WHEN w.new THEN '1.0]' ELSE '0.0]' END) AS payload FROM docs d JOIN w ON w.subject_key = d.subject_key AND (w.new OR w.fp = d.fp) WHERE w.status = 'completed'),
 a AS (SELECT substr(sha256(subject_key), 1, 4) AS node, sha256(subject_key || chr(0) || payload) AS d FROM v), b AS (SELECT substr(node, 1, 2) AS node, sha256(string_agg(d, '' ORDER BY d)) AS d FROM a GROUP BY a.node),
 c AS (SELECT node, sha256(string_agg(d, '' ORDER BY d)) AS d FROM b GROUP BY node)
 SELECT 'text' AS index_kind, (SELECT count(*) FROM v) AS n, 2 AS dims, 'm1' AS model_id, 1 AS epoch, (SELECT sha256(coalesce(string_agg(d, '' ORDER BY d), '')) FROM c) AS checksum""")
def publish_generation(r: Roles) -> DataFrame:
    index = completed(r)
    index.publish("text")
    return index.store.table("generations").select("index_kind", "n", "dims", "model_id", "epoch", "checksum")


PAGES = 3


@query("stm14_import_pages", SQL_LEDGER + ", p AS (SELECT subject_key, fp, CAST(subject_key AS BIGINT) % 5 = 0 AS old FROM docs) SELECT p.subject_key, CASE WHEN p.old THEN 'legacy_unverified' ELSE 'migrated' END AS outcome, 'completed' AS status, 2 AS mark FROM p")
def import_pages(r: Roles) -> DataFrame:
    docs, jobs = ledger(r)
    index = DerivedIndex(Snapshots(r.spark, f"{folder(r.spark)}/derived-{uuid.uuid4().hex}"))
    index.seed(jobs, vectors(docs, 0.0))
    rows = vectors(docs, 2.0).withColumn("outcome", F.when(F.col("subject_key").cast("long") % 5 == 0, "legacy_unverified").otherwise("migrated"))
    for k in range(PAGES):
        page = rows.filter(F.pmod(F.xxhash64("subject_key"), F.lit(PAGES)) == k)
        index.import_page("run-1", "text", page, docs.select(*KEY), k, k + 1)
    seen = index.store.table("imports").select("subject_key", "outcome")
    state = index.jobs().join(index.vectors().select(*KEY, F.col("vector")[1].cast("int").alias("mark")), KEY)
    return seen.join(state.select("subject_key", "status", "mark"), "subject_key")


def screen_frames(r: Roles) -> DataFrame:
    """Captures as frames: the owner's screen, the event type as window, deep values as excluded windows."""
    c = r.captures().withColumns({"stream": F.col("owner"), "window": F.col("process_name"), "excluded": F.col("k") >= 95})
    look = F.array(F.xxhash64(F.floor(F.col("value") / 40)), F.col("k").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return frames.frame_rows(c.withColumn("hash", look), F.col("created_at"))


@query("stm13_capture_loop")
def capture_loop(r: Roles) -> DataFrame:
    """Every frame through exclusion, focus and interval, look-alikes and equal images, to pending rows."""
    kept = frames.captured_frames(screen_frames(r), 3_600_000)
    none = kept.select("id", "image_hash").limit(0).withColumn("is_deleted", F.lit(False))
    return kept.join(pending_insert(none, kept.select("id", "image_hash")), "id").select("stream", "id", "at_ms", "reason", "status", "duplicate_of")


@query("stm10_retry_steps")
def retry_steps(r: Roles) -> DataFrame:
    """Each owner's job: views queue it, errors fail it, purchases finish it; 30 days after the last event all have ended."""
    c = r.captures().withColumn("at_ms", F.unix_millis("created_at"))
    what = F.when(F.col("process_name") == "error", "fail").when(F.col("process_name") == "purchase", "done").otherwise("enqueue")
    last = c.agg(F.max("at_ms")).first()[0] or 0
    return queue.queue_steps(c.select(F.col("owner").alias("subject"), what.alias("what"), F.col("created_at").alias("at"), "at_ms", F.col("id").alias("seq")), last + queue.KEEP_MS)


@query("clu9_batch_scoring", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT item_id AS cluster_id, e AS a, item_id % 7 / 10.0 AS threshold FROM benchmark JOIN v ON id = item_id WHERE item_id % 3 <> 0)
 SELECT cluster_id, v.id, (v.id * 7 + cluster_id * 13) % 100 / 100.0 AS score FROM v, c WHERE list_dot_product(v.e, c.a) >= 0.4 AND (v.id * 7 + cluster_id * 13) % 100 / 100.0 >= threshold""")
def batch_scoring(r: Roles) -> DataFrame:
    """All vectors queued and scored in batches against the clusters that the benchmark names; the score is an input."""
    vectors = r.vectors().select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = r.table("benchmark").select(F.col("item_id").alias("cluster_id")).distinct()
    clusters = n.join(vectors.withColumnRenamed("id", "cluster_id"), "cluster_id").select("cluster_id", "vector", (F.col("cluster_id") % 7 / 10).alias("threshold"), (F.col("cluster_id") % 3 != 0).alias("enabled"))
    queued = ScoringQueue(Snapshots(r.spark, f"{folder(r.spark)}/scoring-{uuid.uuid4().hex}"))
    queued.put(vectors.select("id", F.col("id").alias("queued_ms")))
    pairs = enabled_pairs(vectors, clusters).select("id", "cluster_id", ((F.col("id") * 7 + F.col("cluster_id") * 13) % 100 / 100).alias("score"))
    queued.run(vectors, clusters, pairs, rows=max(1, vectors.count() // 3))
    return queued.assignments()


@query("src18_event_csv", "SELECT event_type AS process, CAST(event_id AS VARCHAR) AS event, CAST(user_id AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS path FROM events")
def event_csv(r: Roles) -> DataFrame:
    """The events as logs with a delimiter and column names of their own, found and read back."""
    where = f"{folder(r.spark)}/logs-{uuid.uuid4().hex}"
    c = r.captures().select(F.col("process_name").alias("Process Name"), F.col("id").alias("Event ID"), F.col("owner").alias("Owner (user)"))
    c.write.option("header", True).option("sep", ";").csv(where)
    return line_files.read_event_csv(r.spark, where, {"process": ["processname"], "event": ["eventid"], "owner": [], "path": ["filepath"]})


@query("src19_jsonl", "SELECT event_id AS id, event_type AS process_name, user_id AS owner FROM events")
def jsonl(r: Roles) -> DataFrame:
    """The events appended as lines of JSON in two commits, and read back."""
    where = f"{folder(r.spark)}/lines-{uuid.uuid4().hex}"
    c = r.captures().select("id", "process_name", "owner")
    for rest in (0, 1):
        line_files.append_jsonl(c.filter(F.col("id") % 2 == rest), where)
    return line_files.read_jsonl(r.spark, where, "id long, process_name string, owner long")


CAPS = f"WITH {SQL_CAPTURES} "
BOTH = f"WITH {SQL_PARENTS}, {SQL_CHILDREN} "


@query("stm7_change_upkeep", CAPS + """, l AS (SELECT id, CASE WHEN k BETWEEN 60 AND 79 THEN 'again' ELSE image_hash END AS image_hash, process_name FROM captures WHERE k < 50 OR k >= 60 AND k < 80),
 h AS (SELECT DISTINCT image_hash FROM captures WHERE image_hash NOT IN (SELECT image_hash FROM l))
 SELECT 'image' AS what, image_hash AS subject_key, CAST(NULL AS BIGINT) AS n FROM h UNION ALL SELECT 'text', CAST(id AS VARCHAR), NULL FROM captures WHERE id NOT IN (SELECT id FROM l)
 UNION ALL SELECT 'hash', image_hash, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'kind', process_name, count(*) FROM l GROUP BY 2""")
def change_upkeep(r: Roles) -> DataFrame:
    """All captures put, the later half deleted, some of those put again with another image: what is left, and what to clean up."""
    c = r.captures().select("id", F.col("id").alias("seq"), F.lit("put").alias("op"), "image_hash", F.col("process_name").alias("kind"), "k")
    log = ChangeLog(Snapshots(r.spark, f"{folder(r.spark)}/changes-{uuid.uuid4().hex}"))
    log.apply(c)
    log.apply(c.filter("k >= 50").withColumn("op", F.lit("delete")))
    log.apply(c.filter("k >= 60 AND k < 80").withColumn("image_hash", F.lit("again")))
    none = F.lit(None).cast("long").alias("n")
    counts = log.hash_counts().select(F.lit("hash").alias("what"), F.col("image_hash").alias("subject_key"), "n").unionAll(log.kind_counts().select(F.lit("kind"), "kind", "n"))
    return log.cleanup().select("what", "subject_key", none).unionByName(counts)


@query("stm18_expire", BOTH + f", s AS (SELECT CAST(doc_id AS VARCHAR) AS subject_key FROM labels UNION SELECT CAST(vec_id * 40 AS VARCHAR) FROM embeddings) SELECT s.subject_key FROM s JOIN parents p ON CAST(p.id AS VARCHAR) = s.subject_key WHERE p.created_at >= TIMESTAMP '{CUTOFF}'")
def expire(r: Roles) -> DataFrame:
    """Subjects of vectors and jobs that are left when those without a live parent, or with an old one, are deleted."""
    subjects = r.table("labels").select(F.col("doc_id").cast("string").alias("subject_key")).union(r.vectors().select((F.col("id") * 40).cast("string"))).distinct()
    return subjects.join(expired_subjects(subjects, r.parents(), F.lit(CUTOFF).cast("timestamp")), "subject_key", "left_anti")


RANGE = "created_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'"


@query("snk6_delete_range", BOTH + f", g AS (SELECT id FROM parents WHERE {RANGE}) SELECT (SELECT count(*) FROM g) AS parents, (SELECT count(*) FROM children WHERE parent_id IN (SELECT id FROM g)) AS children, (SELECT count(*) FROM parents WHERE id NOT IN (SELECT id FROM g)) AS parents_left, (SELECT count(*) FROM children WHERE parent_id NOT IN (SELECT id FROM g)) AS children_left")
def delete_range(r: Roles) -> DataFrame:
    p, c, counts = deleted_range(r.parents(), r.children(), F.expr(RANGE))
    return counts.join(p.agg(F.count("*").alias("parents_left"))).join(c.agg(F.count("*").alias("children_left")))


@query("snk8_soft_delete_ids", BOTH + ", g AS (SELECT DISTINCT doc_id AS id FROM labels) SELECT (SELECT count(*) FROM g) AS requested, (SELECT count(*) FROM parents WHERE status <> 'P' AND id IN (SELECT id FROM g)) AS parents, (SELECT count(*) FROM children JOIN parents p ON p.id = parent_id WHERE p.status <> 'P' AND p.id IN (SELECT id FROM g)) AS children")
def soft_delete_ids(r: Roles) -> DataFrame:
    p = r.parents().withColumn("is_deleted", F.col("status") == "P")
    return lc.soft_delete_ids(p, r.children().select("parent_id", "position", "is_deleted"), r.table("labels").select(F.col("doc_id").alias("id")))[2]


@query("snk11_finalize_deletes", BOTH + ", q AS (SELECT id FROM parents WHERE status <> 'O'), k AS (SELECT parent_id FROM children WHERE NOT is_deleted), g AS (SELECT id FROM q WHERE id NOT IN (SELECT parent_id FROM k)) SELECT 'parent' AS what, id FROM parents WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'queued', id FROM q WHERE id NOT IN (SELECT id FROM g)")
def finalize_deletes(r: Roles) -> DataFrame:
    """Closed orders are queued; those whose children are all gone leave both the table and the queue."""
    p = r.parents()
    left, queued = finalized(p, r.children().filter("NOT is_deleted"), p.filter("status <> 'O'").select("id"))
    return left.select(F.lit("parent").alias("what"), "id").unionByName(queued.select(F.lit("queued").alias("what"), "id"))


@query("snk26_vector_upsert", "SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT CAST(doc_id AS VARCHAR), 2 FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_upsert(r: Roles) -> DataFrame:
    """Vectors keyed by the id as text; those of labelled documents are written again, or anew."""
    old = r.vectors().select(F.col("id").cast("string").alias("key"), F.lit(1).alias("version"), F.col("vector").cast("array<double>").alias("vector"))
    new = r.table("labels").select(F.col("doc_id").cast("string").alias("key"), F.lit(2).alias("version"), F.array(F.col("quality").cast("double")).alias("vector"))
    return lc.latest_wins(old, new, ["key"], "version").select("key", "version")


@query("fil7_system_windows", "SELECT event_id AS id, lower(event_type) IN ('error', 'signup') AS system FROM events")
def system_windows(r: Roles) -> DataFrame:
    return r.captures().select("id", member(F.upper("process_name"), ["Error", "SignUp"]).alias("system"))
