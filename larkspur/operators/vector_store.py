"""A store of vectors pinned to one model and size, with re-embedding and migration.

A version of the store is a folder of files and a manifest that names it and the pin; writing
another version and publishing its manifest switches both at once.  Long jobs write batches to a
staging folder, each by one rename, which is their ledger: a job that was killed finds its batches
there and does the rest.  Nothing is visible before all batches are written and verified.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.manifests import Manifests, hadoop_path, rename_new


class Refused(ValueError):
    """The store does not take what was asked of it; nothing was changed."""


@dataclass(frozen=True)
class Report:
    total: int
    written: int
    skipped: int  #: batches that an earlier run had written
    orphans: int
    failed: int
    switched: bool


VECTORS = "id long, vector array<float>"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)

    def _newest(self) -> dict:
        return self.manifests.newest() or {"version": 0, "data": None, "pin": None}

    def pin(self) -> dict | None:
        """{model, size} that all vectors are of; None for a store that never held any."""
        return self._newest()["pin"]

    def check(self, model: str, size: int) -> None:
        """Refuse another model or size than the pinned one."""
        pin = self.pin()
        if pin is not None and (pin["model"], pin["size"]) != (model, size):
            raise Refused(f"the store holds vectors of {pin['model']} with {pin['size']} dimensions, not of {model} with {size}: re-embed it first")

    def read(self) -> DataFrame:
        data = self._newest()["data"]
        return self.spark.read.schema(VECTORS).parquet(data) if data else self.spark.createDataFrame([], VECTORS)

    def _publish(self, before: dict, data: str, model: str, size: int) -> None:
        self.manifests.publish(before["version"] + 1, {"data": data, "pin": {"model": model, "size": size}})

    def upsert(self, vectors: DataFrame, model: str, size: int) -> int:
        """Add or replace rows (id, vector); refused if the pin differs, an id or vector is missing or
        stands twice, or a vector is of another length.  The first upsert sets the pin."""
        self.check(model, size)
        before, path = self._newest(), f"{self.path}/version-{uuid.uuid4().hex}"
        new = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        bad = new.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("vector") != size, F.lit(True)) | F.col("vector").isNull()).alias("sizes"), F.count_if(F.col("id").isNull()).alias("ids"), F.countDistinct("id").alias("distinct")).first()
        if bad.sizes or bad.ids or bad.distinct != bad.n:
            raise Refused(f"of {bad.n} rows {bad.sizes} have no vector of {size} dimensions, {bad.ids} no id, and {bad.n - bad.ids - bad.distinct} repeat one")
        self.read().join(new.select("id"), "id", "left_anti").unionByName(new).write.parquet(path)
        self._publish(before, path, model, size)
        return bad.n

    def delete(self, ids: DataFrame) -> None:
        before, path = self._newest(), f"{self.path}/version-{uuid.uuid4().hex}"
        if before["data"]:
            self.read().join(ids.select("id"), "id", "left_anti").write.parquet(path)
            self._publish(before, path, before["pin"]["model"], before["pin"]["size"])

    # Jobs ---------------------------------------------------------------------------------

    def _done(self, job: str) -> set[int]:
        fs, home = hadoop_path(self.spark, f"{self.path}/staging/{job}")
        if not fs.exists(home):
            return set()
        return {int(n[6:]) for n in (s.getPath().getName() for s in fs.listStatus(home)) if n.startswith("batch=")}

    def _run(self, job: str, rows: Callable[[int], DataFrame], batches: int, size: int) -> tuple[int, int, int]:
        """Write what ``rows`` gives for every batch not yet staged: (written rows, skipped batches,
        failed batches).  A batch whose vectors are not all of ``size`` fails."""
        done = self._done(job)
        fs, home = hadoop_path(self.spark, f"{self.path}/staging/{job}")
        fs.mkdirs(home)
        written = failed = 0
        for i in (i for i in range(batches) if i not in done):
            draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
            try:
                rows(i).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).write.parquet(draft)
                made = self.spark.read.schema(VECTORS).parquet(draft)
                n = made.count()
                if made.where(F.col("vector").isNull() | (F.size("vector") != size)).isEmpty():
                    rename_new(self.spark, draft, f"{self.path}/staging/{job}/batch={i}")
                    written += n
                    continue
            except KeyboardInterrupt:
                raise
            except Exception as error:  # one batch fails; the others and a later run go on
                print(f"batch {i} of {job}: {type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}")
            failed += 1
            draft_fs, at = hadoop_path(self.spark, draft)
            draft_fs.delete(at, True)
        return written, len(done), failed

    def _staged(self, job: str) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(f"{self.path}/staging/{job}/batch=*")

    def _switch(self, job: str, before: dict, model: str, size: int) -> None:
        data = f"{self.path}/version-{uuid.uuid4().hex}"
        if not rename_new(self.spark, f"{self.path}/staging/{job}", data):
            raise Refused(f"{data} exists")
        self._publish(before, f"{data}/batch=*", model, size)

    def reembed(self, memories: DataFrame, embed: Callable[[Column], Column], model: str, size: int, batches: int = 16) -> Report:
        """Vectors of another model for all ``memories`` (id, content).  Store and pin change only
        when every batch is there and holds each id once; a run after a failed or killed one, with
        the same model and number of batches, does what is missing."""
        before, job = self._newest(), f"reembed-{model}-{size}-{batches}".replace("/", "_").replace(":", "_")
        total = memories.count()
        of = F.pmod(F.xxhash64("id"), F.lit(batches))
        written, skipped, failed = self._run(job, lambda i: memories.where(of == i).select("id", embed(F.col("content")).alias("vector")), batches, size)
        if failed or not total:
            return Report(total, written, skipped, 0, failed, False)
        same = self._staged(job).join(memories.select("id"), "id", "left_semi").agg(F.count("*"), F.countDistinct("id")).first()
        if same[0] != total or same[1] != total or self._staged(job).count() != total:
            raise Refused(f"{same[0]} of {total} memories are staged: the memories changed during the job; delete {self.path}/staging/{job} and run it again")
        self._switch(job, before, model, size)
        return Report(total, written, skipped, 0, 0, True)

    def migrate_from(self, source: VectorStore, memories: DataFrame, batches: int = 16, dry_run: bool = False, force: bool = False) -> Report:
        """Copy another store's vectors of ``memories`` (id) and its pin; the source is not touched.
        Vectors without a memory are left behind and counted.  A store that holds rows refuses,
        unless ``force`` lets copied rows replace its own of the same ids.  A dry run only counts."""
        before, pin = self._newest(), source.pin()
        if pin is None:
            return Report(0, 0, 0, 0, 0, False)
        here = self.read().count()
        points = source.read()
        known = points.join(memories.select("id").distinct(), "id", "left_semi")
        total, orphans = known.count(), points.count() - known.count()
        if dry_run:
            return Report(total, 0, 0, orphans, 0, False)
        if here and not force:
            raise Refused(f"the destination already contains {here} vectors: force the migration, or choose an empty store")
        if here:
            self.check(pin["model"], pin["size"])
        job = f"migrate-{source._newest()['version']}-{batches}"
        of = F.pmod(F.xxhash64("id"), F.lit(batches))
        written, skipped, failed = self._run(job, lambda i: known.where(of == i), batches, pin["size"])
        if failed:
            return Report(total, written, skipped, orphans, failed, False)
        digest = [df.agg(F.count("*"), F.sum(F.xxhash64("id", "vector").cast("decimal(38,0)"))).first() for df in (self._staged(job), known)]
        if digest[0] != digest[1]:
            raise Refused("the copy differs from its source, which changed during the job")
        if here:
            rest = self.read().join(self._staged(job).select("id"), "id", "left_anti")
            rest.write.parquet(f"{self.path}/staging/{job}/batch={batches}")
        self._switch(job, before, pin["model"], pin["size"])
        return Report(total, written, skipped, orphans, 0, True)
