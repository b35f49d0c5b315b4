"""The indicator store and the graph as bucketed tables that ingest cycles fold into.

A table is dealt into buckets by a hash of its key. An epoch (one ingest cycle)
reads only the buckets its rows fall in, folds, and writes new versions of just
these buckets; a commit names the version of every bucket and is written last.
State before epoch e is what commits before e name, so a cycle that is run again
reads the same state, writes the same versions and counts nothing twice, and
readers never see half of a cycle.

Tables: ``iocs`` (by ioc_id); ``mentions`` (by indicator) with ``nodes`` and
``edges``, folded from the touched buckets' mentions; ``contexts`` (by context)
with ``context_nodes`` and ``pairs`` (the indicators that ``graph`` pairs when it is
read, so what is stored grows with the mentions and not with the pairs). Reports may come late, again, or in pieces:
each fold is the batch operator on whole buckets, so the tables equal the batch
result over all reports so far.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators import graph as G
from beaconry.operators import store as S

KEYS = {"iocs": "ioc_id", "mentions": "ioc", "nodes": "id", "edges": "src", "contexts": "context_id", "context_nodes": "id", "pairs": "context_id"}


class Tables:
    """Versioned bucketed tables in ``root``, a folder that all executors share. Up to
    ``split`` tasks write one bucket, so a bucket with a hot key is not one task's work.
    Contexts with more than ``max_paired`` indicators form no pairs (None: all do)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, split: int = 8, max_paired: int | None = G.MAX_PAIRED):
        self.spark, self.root, self.buckets, self.split, self.max_paired = spark, root, buckets, split, max_paired

    # --- versions -----------------------------------------------------------
    def versions(self, before: int | None = None) -> dict[str, dict[int, int]]:
        """table -> bucket -> epoch as of the last commit (before an epoch). At most
        tables x buckets entries, whatever the data."""
        try:
            commits = self.spark.read.parquet(f"{self.root}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            commits = commits.where(F.col("epoch") < before)
        last = commits.agg(F.max("epoch")).first()[0]
        found: dict[str, dict[int, int]] = {}
        if last is not None:
            for row in commits.where(F.col("epoch") == last).collect():
                found.setdefault(row.table, {})[row.bucket] = row.version
        return found

    def commit(self, epoch: int, versions: dict[str, dict[int, int]]) -> None:
        rows = [(t, b, v) for t, of in versions.items() for b, v in of.items()]
        made = self.spark.createDataFrame(rows, "table string, bucket int, version int").coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.root}/commits/epoch={epoch}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete bucket versions that none of the last ``keep`` commits names; returns how many."""
        commits = self.spark.read.parquet(f"{self.root}/commits")
        epochs = sorted((r.epoch for r in commits.select("epoch").distinct().collect()), reverse=True)[:keep]
        named = {(r.table, r.bucket, r.version) for r in commits.where(F.col("epoch").isin(epochs)).select("table", "bucket", "version").distinct().collect()}
        old = {(r.table, r.bucket, r.version) for r in commits.select("table", "bucket", "version").distinct().collect()} - named
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for table, bucket, version in old:
            path = jvm.Path(f"{self.root}/{table}/epoch={version}/bucket={bucket}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)

    # --- rows ---------------------------------------------------------------
    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        return sorted(r.bucket for r in rows.select(self.bucket(key).alias("bucket")).distinct().collect())

    def read(self, table: str, versions: dict[str, dict[int, int]], buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of the named buckets (all if None); None where nothing was written."""
        of = versions.get(table, {})
        paths = [f"{self.root}/{table}/epoch={v}/bucket={b}" for b, v in sorted(of.items()) if buckets is None or b in buckets]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths).drop("epoch", "bucket")

    def write(self, table: str, rows: DataFrame, epoch: int, touched: list[int], versions: dict[str, dict[int, int]], spread: str) -> None:
        """New versions of the touched buckets; a bucket left without rows is dropped from ``versions``."""
        path = f"{self.root}/{table}/epoch={epoch}"
        dealt = rows.withColumn("bucket", self.bucket(KEYS[table])).repartition("bucket", F.pmod(F.xxhash64(spread), F.lit(self.split)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        try:
            there = {r.bucket for r in self.spark.read.parquet(path).select("bucket").distinct().collect()}
        except AnalysisException as empty:
            if empty.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            there = set()
        of = versions.setdefault(table, {})
        for b in touched:
            of.pop(b, None)
        of.update({b: epoch for b in there})

    # --- folds --------------------------------------------------------------
    def fold(self, rows: DataFrame, mentions: DataFrame, epoch: int, as_of: Column) -> None:
        """One ingest cycle: normalized ``rows`` into the store, ``mentions`` into the graph."""
        versions = self.versions(before=epoch)
        with ThreadPoolExecutor(3) as side_by_side:  # they write different tables
            folds = [
                side_by_side.submit(self._fold_iocs, rows, epoch, as_of, versions),
                side_by_side.submit(self._fold_indicators, mentions, epoch, versions),
                side_by_side.submit(self._fold_contexts, mentions, epoch, versions),
            ]
        for fold in folds:
            fold.result()
        self.commit(epoch, versions)

    def _fold_iocs(self, rows: DataFrame, epoch: int, as_of: Column, versions: dict) -> None:
        batch = rows.withColumn("ioc_id", S.ioc_id(F.col("type"), F.col("ioc")))
        touched = self.touched(batch, "ioc_id")
        self.write("iocs", S.upsert_iocs(self.read("iocs", versions, touched), rows, as_of), epoch, touched, versions, "ioc_id")

    def _merged(self, table: str, mentions: DataFrame, epoch: int, versions: dict, spread: str) -> tuple[DataFrame | None, list[int]]:
        """All mentions of the touched buckets, old and new, each once; written, then read back."""
        touched = self.touched(mentions, KEYS[table])
        old = self.read(table, versions, touched)
        merged = G._once(mentions if old is None else old.unionByName(mentions))
        self.write(table, merged, epoch, touched, versions, spread)
        return self.read(table, versions, touched), touched

    def _fold_indicators(self, mentions: DataFrame, epoch: int, versions: dict) -> None:
        now, touched = self._merged("mentions", mentions, epoch, versions, "context_id")
        if now is not None:
            self.write("nodes", G.fold_nodes(now), epoch, touched, versions, "id")
            self.write("edges", G.mention_edges(now), epoch, touched, versions, "dst")

    def _fold_contexts(self, mentions: DataFrame, epoch: int, versions: dict) -> None:
        now, touched = self._merged("contexts", mentions.select("context_id", "ioc", "place", "seen_at"), epoch, versions, "ioc")
        if now is not None:
            self.write("context_nodes", G.context_nodes(now), epoch, touched, versions, "id")
            self.write("pairs", G.pair_groups(now, self.max_paired), epoch, touched, versions, "context_id")

    # --- reads --------------------------------------------------------------
    def iocs(self) -> DataFrame | None:
        return self.read("iocs", self.versions())

    def graph(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Nodes (without reviewed flags) and edges."""
        versions = self.versions()
        both = []
        for names in (("nodes", "context_nodes"), ("edges", "pairs")):
            parts = [G.paired(p) if name == "pairs" else p for name in names if (p := self.read(name, versions)) is not None]
            both.append(parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None)
        return both[0], both[1]
