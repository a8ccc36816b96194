"""A keyed table that writes touch in part: Parquet files of one time bucket or a few adjacent ones each, and a manifest for each version.

A write of few buckets makes a file of each.  One of many makes files of adjacent whole buckets, so that their number goes with the rows and not with the buckets.
A manifest names the files of its version with their rows, the first and last bucket and the least and greatest time.  A write adds files and drops files; all
others stay as they are, by name.  A version appears by one rename that fails where the version is there already, so a failed write is never
seen and of two writers one wins.  Leases are published in the same way; their numbers fence off whoever held an earlier one.

What the driver holds is a record a file, not a row.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.tables import materialize, scratch

#: Rows of a file at most, files of a bucket from which it is written anew, and versions whose files are kept.
FILE_ROWS, BUCKET_FILES, KEEP = 1_000_000, 16, 2
#: A write of many buckets makes about so many files, and more where a file would have more rows than so many.
WRITE_FILES, SPAN_ROWS = 64, 50_000


class Conflict(RuntimeError):
    """Another writer was first, or the lease is another's."""


class _Folder:
    """Small records under one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self._conf)

    def at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        there = self.at(self.path)
        return sorted(str(s.getPath().getName()) for s in self.fs.listStatus(there)) if self.fs.exists(there) else []

    def changed(self, name: str) -> int:
        return self.fs.getFileStatus(self.at(f"{self.path}/{name}")).getModificationTime()

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, record: dict) -> None:
        """``record`` appears whole, or not at all where ``name`` is taken."""
        draft, target = self.at(f"{self.path}/_draft-{uuid.uuid4().hex}"), self.at(f"{self.path}/{name}")
        stream = self.fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), none)
        except Exception as taken:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                raise Conflict(f"{name} is there already") from taken
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.path}/{name}"), True)


def _last(file: dict) -> int:
    """A file's last bucket; earlier manifests name files of one only."""
    return file.get("last", file["bucket"])


class KeyedTable:
    """Versions of a table with ``id``, ``published_at`` (milliseconds) and ``day_bucket`` among its ``columns`` (DDL)."""

    def __init__(self, spark: SparkSession, path: str, columns: str, keep: int = KEEP, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.columns, self.keep, self.file_rows = spark, path.rstrip("/"), columns, keep, file_rows
        self.names = [c.strip().split()[0] for c in columns.split(", ")]
        self._manifests, self._leases = _Folder(spark, f"{self.path}/manifest"), _Folder(spark, f"{self.path}/lease")
        self.fence: int | None = None

    # -- versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._manifests.names() if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """version, operation, files (by name), added, removed."""
        if version is None:
            done = self.versions()
            if not done:
                return {"version": 0, "operation": "", "files": {}, "added": [], "removed": []}
            version = done[-1]
        return self._manifests.read(f"v{version:08d}.json")

    def files(self, version: int | None = None) -> dict[str, dict]:
        return self.manifest(version)["files"]

    def read(self, files: dict | list | None = None) -> DataFrame:
        """The rows of some files, of the last version's by default."""
        files = self.files() if files is None else files
        if not files:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).option("recursiveFileLookup", True).parquet(*[f"{self.path}/data/{f}" for f in sorted(files)])

    def read_buckets(self, lowest: int, highest: int) -> DataFrame:
        return self.read({f: s for f, s in self.files().items() if lowest <= _last(s) and s["bucket"] <= highest}).where(F.col("day_bucket").between(lowest, highest))

    def _spans(self, rows: DataFrame, instead: list[dict] | None) -> DataFrame:
        """(_bucket, span), a row a bucket: adjacent buckets are a span while they are less than a file's rows.  Where the files stand
        ``instead`` of others, what these held together stays together, and what comes from elsewhere is by itself."""
        counts = rows.groupBy(F.col("day_bucket").alias("_bucket")).agg(F.count("*").alias("n"))
        part, most = F.lit(0), F.lit(SPAN_ROWS)
        if instead is None:
            counts = counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))), F.lit(True))  # one row
            most = F.least(F.ceil(F.col("total") / WRITE_FILES), most)
        else:
            islands: list[list[int]] = []
            for s in sorted(instead, key=lambda s: s["bucket"]):
                if islands and s["bucket"] <= islands[-1][1]:
                    islands[-1][1] = max(islands[-1][1], _last(s))
                else:
                    islands.append([s["bucket"], _last(s)])
            held = self.spark.createDataFrame(islands, "_bucket long, last long").withColumn("n", F.lit(0).cast("long"))
            along = Window.orderBy("_bucket", "n")
            counts = counts.withColumn("last", F.lit(None).cast("long")).unionByName(held)
            counts = counts.withColumn("first", F.last(F.when(F.col("last").isNotNull(), F.col("_bucket")), ignorenulls=True).over(along)).withColumn("until", F.last("last", ignorenulls=True).over(along)).where("n > 0")
            part = F.when(F.col("_bucket") <= F.col("until"), F.col("first")).otherwise(F.col("_bucket"))
        before = F.sum("n").over(Window.partitionBy("part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumn("part", part).select("_bucket", F.concat_ws("-", "part", F.floor(F.coalesce(before, F.lit(0)) / most)).alias("span"))

    def write_files(self, rows: DataFrame, instead: list[dict] | None = None) -> dict[str, dict]:
        """New files of ``rows`` (read twice), not yet part of any version.  Adaptive execution parts a span that is much larger than others."""
        folder = uuid.uuid4().hex
        out = rows.select(*self.names).join(F.broadcast(self._spans(rows, instead)), F.col("day_bucket").eqNullSafe(F.col("_bucket")), "left").drop("_bucket")
        out = out.hint("rebalance", "span").sortWithinPartitions("span", "published_at", "id")
        out.write.partitionBy("span").option("maxRecordsPerFile", self.file_rows).parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(self.columns).option("recursiveFileLookup", True).parquet(f"{self.path}/data/{folder}")
        found = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min("day_bucket").alias("bucket"), F.max("day_bucket").alias("last"), F.count("*").alias("rows"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest")).collect()
        return {r["file"][r["file"].index(folder):]: {"bucket": r["bucket"], "last": r["last"], "rows": r["rows"], "oldest": r["oldest"], "newest": r["newest"]} for r in found}

    def commit(self, operation: str, added: dict[str, dict], removed: list[str], base: dict) -> int:
        """The version after ``base``; raises ``Conflict`` if there is one, or if a later lease was given."""
        if self.fence is not None and self._last_lease()[0] != self.fence:
            raise Conflict("the lease is another's")
        gone = set(removed)
        files = {f: s for f, s in base["files"].items() if f not in gone} | added
        version = base["version"] + 1
        self._manifests.publish(f"v{version:08d}.json", {"version": version, "operation": operation, "added": sorted(added), "removed": sorted(gone), "fence": self.fence, "files": files})
        self._forget()
        return version

    def _forget(self) -> None:
        """Manifests before the last ``keep`` go, with the files that none of the others names."""
        done = self.versions()
        old, kept = done[:-self.keep], done[-self.keep:]
        if not old:
            return
        used = {f for v in kept for f in self.files(v)}
        # a file leaves with the manifest after the last that names it
        data = _Folder(self.spark, f"{self.path}/data")
        for v in old:
            for f in set(self.files(v)) - used:
                data.delete(f)
            self._manifests.delete(f"v{v:08d}.json")

    def vacuum(self, older_ms: int, now_ms: int | None = None) -> int:
        """Deletes folders that no manifest names and that are older than ``older_ms``: what failed writes left.  Returns how many."""
        data = _Folder(self.spark, f"{self.path}/data")
        used = {f.split("/")[0] for v in self.versions() for f in self.files(v)}
        until = (int(time.time() * 1000) if now_ms is None else now_ms) - older_ms
        gone = [n for n in data.names() if n not in used and data.changed(n) < until]
        for n in gone:
            data.delete(n)
        return len(gone)

    # -- writes

    def append(self, rows: DataFrame, base: dict, operation: str = "insert") -> int:
        added = self.write_files(rows)
        return self.commit(operation, added, [], base) if added else base["version"]

    def rewrite(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame], operation: str) -> int:
        """Writes anew the files that hold any of ``ids``, changed; others are not touched."""
        base = self.manifest()
        if not base["files"]:
            return base["version"]
        held = self.read(base["files"]).select("id", F.col("_metadata.file_path").alias("file")).join(ids.select("id"), "id", "left_semi")
        hit = sorted(r["file"].rsplit("/data/", 1)[1] for r in held.select("file").distinct().collect())
        if not hit:
            return base["version"]
        with scratch(self.spark):
            return self.commit(operation, self.write_files(materialize(change(self.read(hit)), operation), [base["files"][f] for f in hit]), hit, base)

    def prune(self, cutoff_ms: int) -> int:
        """Drops what was published before the cutoff; files that lie before it are not read.  Returns how many rows went."""
        base = self.manifest()
        whole = [f for f, s in base["files"].items() if s["newest"] < cutoff_ms]
        cut = [f for f, s in base["files"].items() if s["oldest"] < cutoff_ms <= s["newest"]]
        if not whole and not cut:
            return 0
        added = self.write_files(self.read(cut).where(F.col("published_at") >= cutoff_ms), [base["files"][f] for f in cut]) if cut else {}
        before = sum(base["files"][f]["rows"] for f in whole + cut)
        self.commit("prune", added, whole + cut, base)
        return before - sum(s["rows"] for s in added.values())

    def compact(self, most: int = BUCKET_FILES) -> int:
        """Writes anew the buckets of more than ``most`` files; returns how many there were (of those that files begin with)."""
        base = self.manifest()
        by_bucket: dict[int, list[str]] = {}
        reach: list[str] = []
        for f in sorted(base["files"], key=lambda f: base["files"][f]["bucket"]):
            bucket = base["files"][f]["bucket"]
            reach = [g for g in reach if _last(base["files"][g]) >= bucket] + [f]
            by_bucket[bucket] = reach
        crowded = {b: fs for b, fs in by_bucket.items() if len(fs) > most and sum(base["files"][f]["rows"] for f in fs) < len(fs) * self.file_rows // 2}
        if crowded:
            files = sorted({f for fs in crowded.values() for f in fs})
            self.commit("compact", self.write_files(self.read(files), [base["files"][f] for f in files]), files, base)
        return len(crowded)

    def clear(self) -> None:
        base = self.manifest()
        if base["files"]:
            self.commit("clear", {}, sorted(base["files"]), base)

    # -- reads by time

    def newest_files(self, n: int, before: tuple[int, str] | None = None) -> list[str]:
        """The files that are sure to hold the newest ``n`` rows (before a (published_at, id)), by their times alone."""
        files = self.files()
        if before is not None:
            files = {f: s for f, s in files.items() if s["oldest"] <= before[0]}
        sure, floor = 0, None
        for s in sorted(files.values(), key=lambda s: -s["oldest"]):
            if before is None or s["newest"] < before[0]:
                sure, floor = sure + s["rows"], s["oldest"]
                if sure >= n:
                    break
        return sorted(f for f, s in files.items() if sure < n or s["newest"] >= floor)

    def changes(self, version: int) -> DataFrame:
        """Rows with ``_change`` (insert, delete) of one version: what its new files hold and its dropped ones did not, and the other way round."""
        m = self.manifest(version)
        new, old = self.read(m["added"]), self.read(m["removed"])
        if m["operation"] == "insert":
            return new.withColumn("_change", F.lit("insert"))
        if m["operation"] == "compact":
            return new.limit(0).withColumn("_change", F.lit("insert"))
        return new.exceptAll(old).withColumn("_change", F.lit("insert")).unionByName(old.exceptAll(new).withColumn("_change", F.lit("delete")))

    # -- leases

    def _last_lease(self) -> tuple[int, dict]:
        names = [n for n in self._leases.names() if n.startswith("n")]
        return (int(names[-1][1:-5]), self._leases.read(names[-1])) if names else (0, {"owner": None, "until": 0})

    def acquire(self, owner: str, ttl_ms: int, now_ms: int | None = None) -> bool:
        """Takes the lease if it is free, run out or the owner's own; writes are fenced by its number from then on."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        number, last = self._last_lease()
        if last["owner"] not in (None, owner) and last["until"] > now_ms:
            return False
        try:
            self._leases.publish(f"n{number + 1:08d}.json", {"owner": owner, "until": now_ms + ttl_ms})
        except Conflict:
            return False
        self.fence = number + 1
        if number:
            self._leases.delete(f"n{number:08d}.json")
        return True

    def release(self) -> None:
        """Gives the lease back, if it is still held."""
        number, last = self._last_lease()
        if self.fence is not None and number == self.fence:
            self._leases.publish(f"n{number + 1:08d}.json", {"owner": None, "until": 0})
            self._leases.delete(f"n{number:08d}.json")
        self.fence = None
