"""Vectors and versions kept up to date as pages change, in tables that survive restarts and replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cache, snapshot
from lodestone.operators.section import inputs, with_section
from lodestone.sources import pages

#: So many batches are read beside the last base before they become one.
COMPACT_BATCHES = 16


class BatchLog:
    """Tables that grow by batches; what a batch adds to any of them counts once the batch is committed.

    A batch is one folder for each table and, last of all, an empty file that names it; a base is what all batches up to its
    number come to. The files are listed anew for each read, so a restarted stream goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _named(self, kind: str) -> list[int]:
        folder = self._at("commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-"))

    def base(self) -> int | None:
        return max(self._named("base"), default=None)

    def batches(self) -> list[int]:
        """Committed batches that the base doesn't hold yet."""
        base = self.base()
        return [b for b in self._named("batch") if base is None or b > base]

    def committed(self, batch: int) -> bool:
        base = self.base()
        return (base is not None and batch <= base) or batch in self._named("batch")

    def read(self, table: str, batches: list[int] | None = None) -> DataFrame:
        base = self.base()
        folders = [f"batch-{b}" for b in (self.batches() if batches is None else batches)]
        if base is not None and batches is None:
            folders.insert(0, f"base-{base}")
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.path}/{table}/{f}" for f in folders))

    def put(self, table: str, rows: DataFrame, batch: int, kind: str = "batch") -> None:
        """Writes a part, over what a batch that failed has left there."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{kind}-{batch}")

    def commit(self, batch: int, kind: str = "batch") -> None:
        self._fs.create(self._at("commits", f"{kind}-{batch}"), True).close()

    def forget(self, upto: int) -> None:
        """Deletes batches up to that number, and older bases."""
        for kind, last in (("batch", upto), ("base", upto - 1)):
            for n in self._named(kind):
                if n <= last:
                    self._fs.delete(self._at("commits", f"{kind}-{n}"), False)
                    for table in self.schemas:
                        self._fs.delete(self._at(table, f"{kind}-{n}"), True)


SCHEMAS = {
    "versions": "snapshot_id long, version int, content_hash string, batch long",
    "live": "section string, text string, snapshot_id long, batch long",
    "vectors": "section string, text string, w_no int, vector array<double>, start int, end int",
}


class PageRefresher:
    """For foreachBatch: takes changed pages, keeps versions, and makes vectors of new texts only.

    A batch adds its pages' rows and leaves all others as they are; of a page the rows of its last batch are live. A batch
    that comes again after its commit is passed over. Each COMPACT_BATCHES batches become a base, without the rows of older
    batches and without the vectors of texts that no live page has.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame], compact: int = COMPACT_BATCHES):
        self.log, self.embed, self.compact = BatchLog(spark, path, SCHEMAS), embed, compact
        #: Texts that the last batch had vectors made for.
        self.embedded = 0

    def versions(self) -> DataFrame:
        """snapshot_id, version, content_hash, batch of each page, as of its last batch."""
        rows = self.log.read("versions")
        last = rows.groupBy("snapshot_id").agg(F.max_by(F.struct("version", "content_hash", "batch"), "batch").alias("v"))
        return last.select("snapshot_id", "v.*")

    def live(self) -> DataFrame:
        """section, text, snapshot_id, batch of the pages' passages."""
        return self.log.read("live").join(self.versions().select("snapshot_id", "batch"), ["snapshot_id", "batch"], "left_semi").select("section", "text", "snapshot_id", "batch")

    def vectors(self) -> DataFrame:
        """Vectors of the live passages' texts."""
        return cache.retained(self.log.read("vectors"), inputs(self.live()), ["section", "text"])

    def __call__(self, batch: DataFrame, batch_id: int, newest: str | None = None) -> None:
        """batch: page_id, html, and a column newest, if it is named; of a page that occurs more than once, its row with the
        largest value there counts, and of equal ones the one with the largest html. A page without passages has version,
        too: the rows it had are no longer live. Rows without page_id are left out."""
        if self.log.committed(batch_id):
            return
        order = F.struct(*([newest] if newest else []), "html")
        changed = batch.filter("page_id is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max_by("html", order).alias("html"))
        extracted = pages.extract(changed).persist()
        try:
            passages = with_section(pages.passages(extracted))
            hashes = extracted.select("snapshot_id").join(snapshot.content_hash(passages), "snapshot_id", "left").withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
            following = snapshot.next_versions(self.versions(), hashes).select("snapshot_id", F.col("version").cast("int").alias("version"), "content_hash", F.lit(batch_id).cast("long").alias("batch"))
            self.log.put("versions", following, batch_id)
            self.log.put("live", passages.select("section", "text", "snapshot_id", F.lit(batch_id).cast("long").alias("batch")), batch_id)
            wanted = cache.missing(inputs(self.log.read("live", [batch_id])), self.log.read("vectors"), ["section", "text"])
            self.log.put("vectors", self.embed(wanted), batch_id)
            self.embedded = self.log.read("vectors", [batch_id]).select("section", "text").distinct().count()
            self.log.commit(batch_id)
        finally:
            extracted.unpersist()
        if len(self.log.batches()) >= self.compact:
            self._compact(batch_id)

    def _compact(self, batch_id: int) -> None:
        for table, rows in (("versions", self.versions()), ("live", self.live()), ("vectors", self.vectors())):
            self.log.put(table, rows, batch_id, "base")
        self.log.commit(batch_id, "base")
        self.log.forget(batch_id)
