"""The job ledger, published generations and keyed replaces, as functions from one state to the next.

A state is a table; a job is known by ``subject_key``. Each function is one
join or one projection, so that a state of any size moves in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import normalized
from ..sources.checkpoints import written
from .similarity import dealt, pairs_of

#: What a job is known by, and what its vector must have been made with.
KEY, CONTRACT = ["index_kind", "subject_key"], ["model_id", "model_revision", "embedding_version", "source_fingerprint"]
QUEUEABLE = ("pending", "failed", "waiting_for_auth")


def due(now: Column) -> Column:
    """A job that may be claimed at ``now``."""
    return F.col("status").isin(*QUEUEABLE) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))


def claimed(jobs: DataFrame, now: Column, token: int) -> DataFrame:
    """Jobs with what is due processing under the claim's token, its errand's last retry time gone; others keep theirs."""
    take = due(now)
    return jobs.withColumns({
        "lease_token": F.when(take, F.lit(token).cast("long")).otherwise(F.col("lease_token")),
        "next_retry_at": F.when(~take, F.col("next_retry_at")),
        "status": F.when(take, "processing").otherwise(F.col("status")),
    })


def _leased(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "processing").select(*KEY, *CONTRACT, F.col("lease_token").alias("token"))


def unleased(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates (key, contract, token) that no processing job of that contract has a lease for."""
    return updates.join(_leased(jobs), [*KEY, *CONTRACT, "token"], "left_anti")


def settled(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after ``updates`` (key, contract, token, new_status, retry_at): a processing job under that token and contract moves.

    A failure uses up an attempt; waiting, queueing again, discarding and
    completing don't. The lease ends, and the job is due again at ``retry_at``.
    """
    good = updates.join(_leased(jobs), [*KEY, *CONTRACT, "token"], "left_semi").select(*KEY, "new_status", "retry_at", F.lit(True).alias("_move"))
    move = F.coalesce("_move", F.lit(False))
    return jobs.join(good, KEY, "left").withColumns({
        "attempts": F.col("attempts") + F.when(move & (F.col("new_status") == "failed"), 1).otherwise(0),
        "lease_token": F.when(~move, F.col("lease_token")),
        "next_retry_at": F.when(move, F.col("retry_at")).otherwise(F.col("next_retry_at")),
        "status": F.when(move, F.col("new_status")).otherwise(F.col("status")),
    }).select(*jobs.columns)


def excluded(jobs: DataFrame, subjects: DataFrame, version: str = "v1") -> DataFrame:
    """Jobs with the given subjects (subject_key) excluded for good, fingerprinted on an empty source."""
    s = subjects.select("subject_key", F.lit(True).alias("_x"))
    empty = F.sha2(F.lit(version + "\0"), 256)
    j = jobs.join(s, "subject_key", "full_outer")
    return j.withColumns({"status": F.when(F.col("_x"), "excluded").otherwise(F.col("status")), "source_fingerprint": F.when(F.col("_x"), empty).otherwise(F.col("source_fingerprint"))}).drop("_x")


def cascade(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, hashes) to clean up after the rows of ``gone`` (id) go: every id, and each hash that no live row has.

    A row that is soft-deleted (``is_deleted``) already keeps no hash alive.
    """
    ids = rows.join(gone, "id", "left_semi")
    live = rows.filter(~F.coalesce("is_deleted", F.lit(False))).join(gone, "id", "left_anti").select("image_hash")
    return ids.select("id"), ids.select("image_hash").distinct().join(live, "image_hash", "left_anti")


def next_epochs(epochs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Epochs (kind, epoch), one more where the visible set (kind, subject_key, fingerprint) differs."""
    key = ["kind", "subject_key", "fingerprint"]
    a = before.select(*key, F.lit(1).alias("_n")).unionByName(after.select(*key, F.lit(-1).alias("_n")))
    moved = a.groupBy(*key).agg(F.sum("_n").alias("_n")).filter("_n <> 0").select("kind").distinct().withColumn("_m", F.lit(1))
    return epochs.join(moved, "kind", "left").select("kind", (F.col("epoch") + F.coalesce("_m", F.lit(0))).alias("epoch"))


def current_generations(manifest: DataFrame, epochs: DataFrame) -> DataFrame:
    """Published generations whose epoch is the kind's present one (0 without a row); stale ones give none."""
    e = epochs.select(F.col("kind").alias("_k"), F.col("epoch").alias("_e"))
    j = manifest.join(e, F.col("kind") == F.col("_k"), "left")
    return j.filter(F.col("epoch") == F.coalesce("_e", F.lit(0))).select(*manifest.columns)


def tree_checksum(rows: DataFrame, key: str, payload: str, levels: int = 2) -> DataFrame:
    """One row, ``checksum``: the SHA-256 at the root of a tree over all rows.

    A row's digest is that of its key and payload. Rows stand under the first
    two hexadecimal digits a level of their key's hash; a node's digest is
    that of its children's, sorted and joined. So no task holds more than a
    node's children, whatever the order of the rows, and two states differ in
    the root if any row does. No rows: the digest of nothing.
    """
    at = F.sha2(F.col(key), 256)
    leaf = F.sha2(F.concat(F.col(key), F.lit("\0"), F.col(payload)), 256)
    node = rows.select(F.substring(at, 1, 2 * levels).alias("at"), leaf.alias("d"))
    for level in range(levels, -1, -1):
        up = F.substring("at", 1, max(2 * (level - 1), 0)) if level else F.lit("")
        joined = F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d")
        node = node.groupBy("at").agg(joined).select(up.alias("at"), "d") if level else node.agg(joined)
    return node.withColumnRenamed("d", "checksum")


def generation(visible: DataFrame, epoch: int, levels: int = 2) -> DataFrame:
    """One manifest row of visible vectors (subject_key, dims, model_id, payload): count, dims, model, checksum, epoch.

    Mixed widths or models are an error.
    """
    one = visible.agg(F.count("*").alias("n"), F.min("dims").alias("dims"), F.max("dims").alias("_d"), F.min("model_id").alias("model_id"), F.max("model_id").alias("_m"))
    same = F.coalesce((F.col("dims") == F.col("_d")) & (F.col("model_id") == F.col("_m")), F.lit(True))
    dims = F.when(same, F.col("dims")).otherwise(F.raise_error(F.lit("mixed widths or models")).cast("int"))
    # Both sides are one row.
    return one.join(tree_checksum(visible, "subject_key", "payload", levels)).select("n", dims.alias("dims"), "model_id", "checksum", F.lit(epoch).alias("epoch"))


def reconciled(texts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(subject_key, outcome) of texts (subject_key, index_text) without a job: enqueue, or exclude where the text is blank."""
    blank = F.coalesce(F.trim("index_text"), F.lit("")) == ""
    return texts.join(jobs.select("subject_key"), "subject_key", "left_anti").select("subject_key", F.when(blank, "exclude").otherwise("enqueue").alias("outcome"))


def replaced(existing: DataFrame, incoming: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """All rows of the given groups replaced by the incoming ones of these groups, possibly none."""
    return existing.join(groups, key, "left_anti").unionByName(incoming.join(groups, key, "left_semi").select(*existing.columns))


def pending_insert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, status, duplicate_of) of incoming captures: duplicate of the oldest live row with that hash, or pending.

    Of several incoming rows with one hash the first, by id, is pending and the
    others are its duplicates. Soft-deleted rows (``is_deleted``) have no duplicates.
    """
    old = existing.filter(~F.coalesce("is_deleted", F.lit(False))).groupBy("image_hash").agg(F.min("id").alias("_old"))
    new = incoming.groupBy("image_hash").agg(F.min("id").alias("_new"))
    j = incoming.join(new, "image_hash", "left").join(old, "image_hash", "left")
    of = F.coalesce("_old", F.when(F.col("_new") != F.col("id"), F.col("_new")))
    return j.select("id", F.when(of.isNull(), "pending").otherwise("duplicate").alias("status"), of.alias("duplicate_of"))


def aborted(rows: DataFrame, chosen: Column) -> DataFrame:
    """Chosen rows that are pending become aborted; committed ones stay."""
    return rows.withColumn("status", F.when(chosen & (F.col("status") == "pending"), "aborted").otherwise(F.col("status")))


def upserted_summaries(existing: DataFrame, incoming: DataFrame, clusters: DataFrame) -> DataFrame:
    """Summaries (id, title, summary, ocr_summary): incoming ones replace those of their id.

    An incoming row counts if one of its three texts is not blank and its cluster (id) exists.
    """
    said = F.lit(False)
    for c in ("title", "summary", "ocr_summary"):
        said = said | (F.coalesce(F.trim(c), F.lit("")) != "")
    good = incoming.filter(said).join(clusters, "id", "left_semi")
    return existing.join(good, "id", "left_anti").unionByName(good.select(*existing.columns))


def migrated_anchors(raw: DataFrame) -> DataFrame:
    """(category, text, weight, scope, process_name) of anchors (category, anchors: JSON array): a bare string gets the defaults."""
    each = raw.select("category", F.explode(F.from_json("anchors", "array<string>")).alias("a"))
    s = F.from_json("a", "text string, weight double, scope string, process_name string")
    old = ~F.ltrim("a").startswith("{")
    return each.select("category", F.when(old, F.col("a")).otherwise(s["text"]).alias("text"), *[F.coalesce(F.when(~old, s[c]), F.lit(d)).alias(c) for c, d in (("weight", 1.0), ("scope", "global"), ("process_name", ""))])


def anchor_index(anchors: DataFrame) -> DataFrame:
    """Anchors that have a text."""
    return anchors.filter(F.trim("text") != "")


def with_prior(scores: DataFrame, processes: DataFrame, prior: dict[str, str], bonus: float = 0.12) -> DataFrame:
    """Scores (id, category, score), the category that goes with the row's process (id, process_name) raised by ``bonus``."""
    p, goes = F.lower(F.trim("process_name")), F.lit(None).cast("string")
    for process, category in prior.items():
        goes = F.when(p == process, category).otherwise(goes)
    j = scores.join(processes.select("id", goes.alias("_c")), "id", "left")
    return j.select("id", "category", (F.col("score") + F.when(F.col("_c") == F.col("category"), bonus).otherwise(0.0)).alias("score"))


def batch_size(forced: Column, clusters: Column) -> Column:
    """4096 / clusters, at least 1, at most 32, or 128 if forced."""
    return F.least(F.when(forced, 128).otherwise(32), F.greatest(F.lit(1), F.floor(F.lit(4096) / F.greatest(clusters, F.lit(1))).cast("int")))


def first_parsed(attempts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, errors): the first source of each key, in order, that gave a value, and how many failed before it."""
    best = attempts.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("b"), F.min(F.when(F.col(value).isNotNull(), F.col(order))).alias("_o"), F.collect_list(F.when(F.col(value).isNull(), F.col(order))).alias("e"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.size(F.filter("e", lambda x: F.col("_o").isNull() | (x < F.col("_o")))).cast("long").alias("errors"))


def without_anchors(anchors: DataFrame, removals: DataFrame) -> DataFrame:
    """Anchors without those of a removal's (category, text), its scope and process too where they are given."""
    a, x = anchors.alias("a"), removals.alias("x")
    same = (F.col("a.category") == F.col("x.category")) & (F.col("a.text") == F.col("x.text"))
    for c in ("scope", "process_name"):
        same = same & (F.col(f"x.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"x.{c}")))
    return a.join(x, same, "left_anti")


def contract_range(visible: DataFrame) -> DataFrame:
    """One row: count, least and largest width, model, revision and version, and whether each is one value."""
    names = {"dims": "dims", "model": "model_id", "revision": "model_revision", "version": "embedding_version"}
    ends = [f(c).alias(f"{n}_{e}") for n, c in names.items() for e, f in (("low", F.min), ("high", F.max))]
    one = visible.agg(F.count("*").alias("n"), *ends)
    uniform = F.lit(True)
    for n in names:
        uniform = uniform & F.col(f"{n}_low").eqNullSafe(F.col(f"{n}_high"))
    return one.withColumn("uniform", uniform)


def in_scope(queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Queries (id, process_name) with each anchor (anchor, scope, process_name) that counts for them.

    Local anchors join by process; global ones are a stated set that every row
    gets, so they travel as arrays of a checked size and nothing is shuffled.
    """
    from .vectors import packed_rows

    name = F.lower(F.trim("process_name"))
    local = anchors.filter("scope = 'local'").select("anchor", name.alias("_p")).filter("_p <> ''")
    packs, few = packed_rows(anchors.filter("scope <> 'local'").select("anchor"), "anchor")
    q = queries.select("id", name.alias("_p"))
    mine = q.join(local, "_p").select("id", "anchor")
    return mine.unionByName(q.join(F.broadcast(packs) if few else packs).select("id", F.explode("_points").alias("anchor")))


def semantic_duplicates(vectors: DataFrame, anchors: DataFrame, above: float = 0.95) -> DataFrame:
    """(id, duplicate): whether an anchor of the same category and scope, another row, has a cosine above the bound.

    Both sides are (id, category, scope, vector); ``anchors`` is the stated set.
    Rows of a category, scope and width are compared in the groups of ``dealt``;
    a group sends the ids that are like an anchor, not the pairs.
    """
    rows = vectors.withColumn("anchor", F.lit(False)).select("id", "category", "scope", "vector", "anchor").unionByName(anchors.select("id", "category", "scope", "vector", F.lit(True).alias("anchor")))
    sound = "category is not null and scope is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x)) and exists(vector, x -> x <> 0)"
    rows = rows.filter(sound).select("id", "anchor", normalized(F.col("vector").cast("array<double>")).alias("vector"), F.to_json(F.struct("category", "scope", F.size("vector").alias("width"))).alias("grp"))
    # Shorter vectors of other groups are filled up with zeros, which change no cosine.
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = written(rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))))

    def like(t: pa.Table) -> pa.Table:
        ids, anchor = t.column("id").to_numpy(), t.column("anchor").to_numpy(zero_copy_only=False)
        out = np.zeros(len(ids), bool)
        for u, v, _ in pairs_of(t, above):
            use = (anchor[u] != anchor[v]) & (ids[u] != ids[v])
            out[np.where(anchor[u], v, u)[use]] = True
        return pa.table({"id": pa.array(ids[out])})

    hit = dealt(rows, above).groupBy("grp", "cell", "low", "high").applyInArrow(like, "id long")
    return vectors.join(hit.select("id").distinct().withColumn("_h", F.lit(True)), "id", "left").select("id", F.coalesce("_h", F.lit(False)).alias("duplicate"))
