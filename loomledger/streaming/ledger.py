"""A ledger that grows with a stream of evidence: late and repeated rows change nothing but what they must.

Evidence rows (claim_id, chunk, independence_group, stance, at) arrive in any order, some twice and some weeks late. Each batch's different rows are merged into a table of
distinct evidence, bucketed by claim; only the buckets of the batch's claims are written again. Merging a set is idempotent, so a batch that is delivered again after a
failure leaves the same table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.functions.text import fold_group
from loomledger.operators.ledger import classify
from loomledger.sources.files import files_of

_EVIDENCE = "claim_id string, chunk string, independence_group string, stance string"


class LedgerTable:
    """Distinct evidence by bucket of claim id. A merge writes the buckets it touches in one job, and a manifest then says which folder holds each bucket.

    Whoever reads while a batch is merged reads the tables of the manifest before it. The number of buckets is chosen when the table is made, for its expected size: a bucket is what one
    task rewrites (a few hundred MB).
    """

    def __init__(self, root: str, buckets: int = 64):
        self.root, self.files = str(root).rstrip("/"), files_of(str(root))
        known = self._manifest()
        self.buckets = known["buckets"] if known else buckets

    def _manifest(self) -> dict:
        at = f"{self.root}/manifest.json"
        return json.loads(self.files.read_text(at)) if self.files.exists(at) else {}

    def _folders(self, buckets: set[int] | None = None) -> list[str]:
        held = self._manifest().get("held", {})
        return [f"{self.root}/{v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or int(b) in buckets]

    def read(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame:
        parts = self._folders(buckets)
        return spark.read.schema(_EVIDENCE).parquet(*parts) if parts else spark.createDataFrame([], _EVIDENCE)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select("claim_id", "chunk", fold_group("independence_group").alias("independence_group"), "stance").where("claim_id is not null and stance in ('supports', 'contradicts')").distinct()
        number = F.pmod(F.xxhash64("claim_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        new = new.select("*", number).persist()
        try:
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most ``buckets`` rows
            if not touched:
                return
            whole = new.unionByName(self.read(spark, touched).select("*", number)).distinct()
            version = f"v-{epoch}-{uuid.uuid4().hex[:12]}"
            whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{version}")
            before = self._folders(touched)
            held = self._manifest().get("held", {}) | {str(b): version for b in touched}
            self.files.write_text(f"{self.root}/manifest.json", json.dumps({"buckets": self.buckets, "held": held}))
            for folder in before:
                self.files.delete(folder)
        finally:
            new.unpersist()

    def ledger(self, spark: SparkSession) -> DataFrame:
        """claim_id and status of every claim; groups are counted, evidence is not gathered."""
        g = self.read(spark).groupBy("claim_id").agg(F.count_distinct(F.when(F.col("stance") == "supports", F.col("independence_group"))).alias("s"), F.count_distinct(F.when(F.col("stance") == "contradicts", F.col("independence_group"))).alias("c"))
        return g.select("claim_id", F.when(F.col("c") > 0, "contested").when(F.col("s") > 1, "corroborated").when(F.col("s") == 1, "single_source").otherwise("unsupported").alias("status"))


def follow(stream: DataFrame, table: LedgerTable, checkpoint: str):
    """The running query that merges a stream into the table, batch by batch."""
    return stream.writeStream.foreachBatch(lambda df, epoch: table.merge(df, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, late: str = "30 days", every: str = "1 day") -> DataFrame:
    """Evidence by day and stance, with rows later than ``late`` left to the ledger alone."""
    return stream.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "stance").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "stance", "n")


def flatten(claims: DataFrame) -> DataFrame:
    """Evidence rows of nested claims, as a stream would bring them."""
    return claims.select("claim_id", F.explode("evidence").alias("e")).select("claim_id", "e.chunk", "e.independence_group", "e.stance")


def batch_status(claims: DataFrame) -> DataFrame:
    return classify(claims.select("claim_id", "evidence")).select("claim_id", "status")
