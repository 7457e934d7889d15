"""The job ledger and the vectors it guards, changed by fenced commits.

Jobs, vectors, published generations and the subjects of imports are tables of
one store (``sources.snapshots``), so that a job's status and its vector change
in one commit. A claim hands out a token that no claim had before; whoever
comes back with an older one is refused, and so is a generation whose data has
moved since it was read. The states themselves are made by the joins of
``ledger``; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Conflict, Snapshots, Stale
from . import ledger

KEY, CONTRACT = ledger.KEY, ledger.CONTRACT


class DerivedIndex:
    def __init__(self, store: Snapshots):
        self.store = store

    def seed(self, jobs: DataFrame, vectors: DataFrame | None = None) -> None:
        """The first state: jobs (key, contract, status, attempts, next_retry_at, updated_at), none of them leased."""
        tables = {"jobs": self.store.stage(jobs.withColumn("lease_token", F.lit(None).cast("long")))}
        if vectors is not None:
            tables["vectors"] = self.store.stage(vectors)
        self.store.commit(replace=tables)

    def jobs(self) -> DataFrame:
        return self.store.table("jobs")

    def vectors(self) -> DataFrame | None:
        return self.store.table("vectors")

    def claim(self, now: Column) -> int:
        """Put every job that is due under a token of its own claim, and return it.

        Another writer that comes between makes this one start from what it left.
        """
        token = self.store.claim("lease")
        while True:
            try:
                self.store.replace("jobs", lambda jobs: ledger.claimed(jobs, now, token))
            except Conflict:
                continue
            return token

    def settle(self, updates: DataFrame) -> None:
        """Move processing jobs to the states of ``updates`` (key, contract, token, new_status, retry_at), all or none.

        ``Stale`` if one of them names a lease or a contract that is not the job's.
        """
        base = self.store.read()
        jobs = self.store.table("jobs", base)
        self._refuse_stale(jobs, updates)
        self.store.commit(replace={"jobs": self.store.stage(ledger.settled(jobs, updates))}, base=base)

    def complete(self, done: DataFrame, live: DataFrame) -> None:
        """Write the vectors of ``done`` (key, contract, token, vector) and complete their jobs, all or none.

        Refused: a lease or contract that is not the job's (``Stale``), and a
        subject that is not in ``live`` (key). A vector takes the place of the
        one its key had. The epoch of each kind moves on in the same commit.
        """
        base = self.store.read()
        jobs, have = self.store.table("jobs", base), self.store.table("vectors", base)
        self._refuse_stale(jobs, done)
        if n := done.join(live, KEY, "left_anti").count():
            raise ValueError(f"{n} subjects are not active")
        written = done.select(*KEY, *CONTRACT, "vector")
        kept = have.join(written, KEY, "left_anti").unionByName(written) if have is not None else written
        # One row a kind.
        kinds = [r[0] for r in done.select("index_kind").distinct().collect()]
        moved = ledger.settled(jobs, done.select(*KEY, *CONTRACT, "token", F.lit("completed").alias("new_status"), F.lit(None).cast("timestamp").alias("retry_at")))
        epochs = {f"epoch/{k}": base["guards"].get(f"epoch/{k}", 0) for k in kinds}
        self.store.commit(
            replace={"jobs": self.store.stage(moved), "vectors": self.store.stage(kept)},
            base=base, expect=epochs, guards={k: v + 1 for k, v in epochs.items()},
        )

    @staticmethod
    def _refuse_stale(jobs: DataFrame, updates: DataFrame) -> None:
        if n := ledger.unleased(jobs, updates).count():
            raise Stale(f"{n} leases are stale, or their jobs are no longer processing")

    def visible(self, kind: str, manifest: dict | None = None) -> DataFrame:
        """Vectors of a kind whose job is completed under the same contract."""
        done = self.store.table("jobs", manifest).filter(F.col("status") == "completed").select(*KEY, *CONTRACT)
        return self.store.table("vectors", manifest).filter(F.col("index_kind") == kind).join(done, [*KEY, *CONTRACT], "left_semi")

    def publish(self, kind: str) -> dict:
        """Write the visible vectors of a kind as its generation and record it: rows, widths, model, checksum and epoch.

        The checksum is that of the files as they are read back. Mixed widths
        or models are an error, and ``Stale`` is raised if the kind's epoch
        moved while the generation was written: it is not recorded then.
        """
        base = self.store.read()
        epoch = base["guards"].get(f"epoch/{kind}", 0)
        staged = self.store.stage(self.visible(kind, base))
        written = self.store.spark.read.parquet(*[f"{self.store.path}/data/{p}" for p in staged["parts"]])
        rows = written.select("subject_key", F.size("vector").alias("dims"), "model_id", F.sha2(F.col("vector").cast("string"), 256).alias("payload"))
        record = ledger.generation(rows, epoch).withColumn("index_kind", F.lit(kind))
        kept = self.store.table("generations", base)
        kept = record if kept is None else kept.filter(F.col("index_kind") != kind).unionByName(record)
        table = {"parts": [], "schema": staged["schema"]} if not staged["parts"] else staged
        self.store.commit(replace={f"generation/{kind}": table, "generations": self.store.stage(kept)}, base=base, expect={f"epoch/{kind}": epoch})
        return self.store.table("generations").filter(F.col("index_kind") == kind).first().asDict()

    def import_page(self, run: str, kind: str, rows: DataFrame, live: DataFrame, expected: int, following: int) -> dict:
        """Import a page (key, contract, vector, outcome) and move the run's cursor from ``expected`` to ``following``, in one commit.

        Refused as a whole: a cursor that is elsewhere (``Stale``) or goes
        back, a row of another kind, an inactive subject. Returns how many rows
        were migrated, already current, or left unverified.
        """
        if following < expected:
            raise ValueError("the cursor moved backwards")
        base, cursor = self.store.read(), f"cursor/{run}"
        if base["guards"].get(cursor, 0) != expected:
            raise Stale(f"the run is at {base['guards'].get(cursor, 0)}, not at {expected}")
        bad = rows.join(live.withColumn("_live", F.lit(True)), KEY, "left").agg(
            F.count(F.when(F.col("index_kind") != kind, 1)).alias("foreign"), F.count(F.when(F.col("_live").isNull(), 1)).alias("inactive")).first()
        if bad["foreign"] or bad["inactive"]:
            raise ValueError(f"{bad['foreign']} rows of another kind, {bad['inactive']} inactive subjects")
        jobs, vectors = self.store.table("jobs", base), self.store.table("vectors", base)
        current = jobs.filter(F.col("status") == "completed").select(*KEY, *CONTRACT, F.lit(True).alias("_current"))
        judged = rows.join(current, [*KEY, *CONTRACT], "left")
        unverified = F.col("outcome") == "legacy_unverified"
        result = judged.agg(
            F.count(F.when(~unverified & F.col("_current").isNull(), 1)).alias("migrated"),
            F.count(F.when(~unverified & F.col("_current").isNotNull(), 1)).alias("already_current"),
            F.count(F.when(unverified, 1)).alias("legacy_unverified"),
        ).first().asDict()
        new = rows.select(*KEY, *CONTRACT, "vector")
        done = rows.select(*KEY, *CONTRACT, F.lit("completed").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("next_retry_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("long").alias("lease_token"))
        seen = rows.select(F.lit(run).alias("run"), "subject_key", "outcome", "source_fingerprint")
        before = self.store.table("imports", base)
        if before is not None:
            seen = before.join(seen, ["run", "subject_key"], "left_anti").unionByName(seen)
        tables = {
            "vectors": new if vectors is None else vectors.join(new, KEY, "left_anti").unionByName(new),
            "jobs": jobs.join(done, KEY, "left_anti").unionByName(done.select(*[F.col(c).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns])),
            "imports": seen,
        }
        epoch = f"epoch/{kind}"
        guards = {cursor: following} | ({epoch: base["guards"].get(epoch, 0) + 1} if following > expected else {})
        self.store.commit(replace={k: self.store.stage(v) for k, v in tables.items()}, base=base, expect={cursor: expected}, guards=guards)
        return result
