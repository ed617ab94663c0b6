"""The structure store on parquet: append-only tables, latest-wins views, small rewritten dimensions.

Tables under one folder: snapshots, files, symbols, refs (facts, partitioned by
repo_id, appended only), touches (a reindex run that found nothing new), repos and
contracts (small, latest row of a key wins; a contract row without path is a
tombstone). Appends by one writer at a time; a rewrite goes to a new folder that
is then swapped in.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.operators.structure import latest_by, prunable, root_hash
from codestrata.session import materialise

#: Version of the layout; readers refuse newer ones and fill columns that older ones lack.
VERSION = 9
SCHEMAS = {
    "repos": "repo_id long, name string, path string, source_root string, common_dir string, file_cap int, enrolled_at timestamp, last_indexed timestamp, parse_errors int, supported_seen int, written_at timestamp",
    "snapshots": "snapshot_id long, repo_id long, session_id string, label string, timestamp timestamp, root string, root_hash string, version int",
    "touches": "snapshot_id long, repo_id long, session_id string, timestamp timestamp",
    "files": "file_id long, snapshot_id long, repo_id long, path string, content_hash string",
    "symbols": "file_id long, repo_id long, name string, kind string, sig_hash string",
    "refs": "file_id long, repo_id long, name string",
    "contracts": "repo_id long, session_id string, name string, path string, content_hash string, activated_at timestamp",
}
_PARTITIONED = ("snapshots", "files", "symbols", "refs", "touches")


@dataclass
class Store:
    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        """A table with all columns of the current version; an absent table is empty."""
        schema = T.StructType.fromDDL(SCHEMAS[name])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*schema.names)

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows that have the columns of a table's current layout."""
        self._append(name, rows)

    def _append(self, name: str, rows: DataFrame) -> None:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        writer = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append")
        (writer.partitionBy("repo_id") if name in _PARTITIONED else writer).parquet(f"{self.folder}/{name}")

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        """Write beside the table, then swap; readers see the old or the new one."""
        new, old = f"{self.folder}/.{name}-{uuid.uuid4().hex}", f"{self.folder}/.{name}-old-{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy("repo_id") if name in _PARTITIONED else writer).parquet(new)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(new).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.rename(hadoop.Path(f"{self.folder}/{name}"), hadoop.Path(old))
        fs.rename(hadoop.Path(new), hadoop.Path(f"{self.folder}/{name}"))
        fs.delete(hadoop.Path(old), True)

    # -- snapshots

    def snapshots(self) -> DataFrame:
        """Snapshots with their last touch: a touched snapshot moves forward in time."""
        last = self.read("touches").groupBy("snapshot_id").agg(F.max(F.struct("timestamp", "session_id")).alias("t"))
        s = self.read("snapshots").filter(F.coalesce("version", F.lit(0)) <= VERSION)
        return s.join(last, "snapshot_id", "left").select(
            "snapshot_id", "repo_id", F.coalesce("t.session_id", "session_id").alias("session_id"), "label",
            F.greatest("timestamp", F.coalesce("t.timestamp", "timestamp")).alias("timestamp"), "root", "root_hash",
        )

    def save(self, repo_id: int, session_id: str, label: str, root: str, at: str, files: DataFrame, symbols: DataFrame, refs: DataFrame) -> int:
        """Append a labelled snapshot. files(path, content_hash), symbols(path, name, kind, sig_hash), refs(path, name)."""
        if label == "auto":
            raise ValueError("the label auto is reserved")
        return self._write(repo_id, session_id, label, root, at, files, symbols, refs)

    def roll_auto(self, repo_id: int, session_id: str, root: str, at: str, files: DataFrame, symbols: DataFrame, refs: DataFrame) -> int:
        """Append the rolling snapshot; views take the newest of the label."""
        return self._write(repo_id, session_id, "auto", root, at, files, symbols, refs)

    def reindex(self, repo_id: int, session_id: str, root: str, at: str, files: DataFrame, symbols: DataFrame, refs: DataFrame) -> tuple[int, bool]:
        """(id, written): where the newest reindex snapshot has the same root hash it is only touched."""
        found = self._root_hash(files)
        newest = latest_by(self.snapshots().filter((F.col("label") == "reindex") & (F.col("repo_id") == repo_id)), ["repo_id"]).first()
        if newest is not None and newest["root_hash"] == found:
            row = [(newest["snapshot_id"], repo_id, session_id)]
            touch = self.spark.createDataFrame(row, "snapshot_id long, repo_id long, session_id string")
            self._append("touches", touch.withColumn("timestamp", F.lit(at).cast("timestamp")))
            return newest["snapshot_id"], False
        return self._write(repo_id, session_id, "reindex", root, at, files, symbols, refs), True

    def _root_hash(self, files: DataFrame) -> str:
        row = root_hash(files.select(F.lit(0).alias("snapshot_id"), "path", "content_hash")).first()
        return row["root_hash"] if row else self.spark.range(1).select(F.sha2(F.lit(""), 256).alias("h")).first()["h"]

    def _write(self, repo_id, session_id, label, root, at, files, symbols, refs) -> int:
        digest = self._root_hash(files)
        head = self.spark.range(1).select(F.xxhash64(F.lit(repo_id), F.lit(session_id), F.lit(label), F.lit(at), F.lit(digest)).alias("id"))
        sid = head.first()["id"] & ((1 << 62) - 1)
        file_id = (F.xxhash64(F.lit(sid), F.col("path")).bitwiseAND(F.lit((1 << 62) - 1))).alias("file_id")
        repo = F.lit(repo_id).cast("bigint").alias("repo_id")
        # facts first: a snapshot row is only there once all it lists is
        self._append("files", files.select(file_id, F.lit(sid).alias("snapshot_id"), repo, "path", "content_hash"))
        self._append("symbols", symbols.select(file_id, repo, "name", "kind", F.coalesce("sig_hash", F.lit("")).alias("sig_hash")))
        self._append("refs", refs.select(file_id, repo, "name").dropDuplicates(["file_id", "name"]))
        row = [(sid, repo_id, session_id, label, root, digest, VERSION)]
        snapshot = self.spark.createDataFrame(row, "snapshot_id long, repo_id long, session_id string, label string, root string, root_hash string, version int")
        self._append("snapshots", snapshot.withColumn("timestamp", F.lit(at).cast("timestamp")))
        return sid

    def prune(self, keep: int) -> int:
        """Drop reindex snapshots beyond the newest ones and, child first, all they hold; the number dropped."""
        gone = prunable(self.snapshots(), keep).select("snapshot_id")
        gone = materialise(gone, "prunable")  # the tables it is derived from are rewritten below
        n = gone.count()
        if n:
            files = self.read("files")
            dead = materialise(files.join(gone, "snapshot_id", "left_semi").select("file_id"), "prunable-files")
            for name in ("refs", "symbols"):
                self._rewrite(name, self.read(name).join(dead, "file_id", "left_anti"))
            kept = self.read("snapshots").join(gone, "snapshot_id", "left_anti")
            self._rewrite("files", files.join(kept.select("snapshot_id"), "snapshot_id", "left_semi"))
            self._rewrite("snapshots", kept)
        return n

    # -- dimensions

    def repos(self) -> DataFrame:
        """The latest row of each repository."""
        rest = [c for c in T.StructType.fromDDL(SCHEMAS["repos"]).names if c not in ("repo_id", "written_at")]
        last = self.read("repos").groupBy("repo_id").agg(F.max(F.struct("written_at", *rest)).alias("r"))
        return last.select("repo_id", *[F.col(f"r.{c}").alias(c) for c in rest]).filter("name is not null")

    def put_repo(self, at: str, **columns: object) -> None:
        """Enroll or update a repository; names and paths stay unique."""
        clash = self.repos().filter((F.col("repo_id") != columns["repo_id"]) & ((F.col("name") == columns["name"]) | (F.col("path") == columns["path"])))
        if not clash.isEmpty():
            raise ValueError("name or path is taken")
        names = T.StructType.fromDDL(SCHEMAS["repos"]).names
        row = [tuple(columns.get(c) for c in names if c not in ("enrolled_at", "last_indexed", "written_at"))]
        typed = T.StructType([f for f in T.StructType.fromDDL(SCHEMAS["repos"]) if f.name not in ("enrolled_at", "last_indexed", "written_at")])
        df = self.spark.createDataFrame(row, typed)
        for c, v in (("enrolled_at", columns.get("enrolled_at", at)), ("last_indexed", columns.get("last_indexed")), ("written_at", at)):
            df = df.withColumn(c, F.lit(v).cast("timestamp"))
        self._append("repos", df)

    def remove_repo(self, repo_id: int) -> None:
        """Refused while snapshots exist."""
        if not self.read("snapshots").filter(F.col("repo_id") == repo_id).isEmpty():
            raise ValueError("the repository has snapshots")
        self._rewrite("repos", self.read("repos").filter(F.col("repo_id") != repo_id))

    def purge_repo(self, repo_id: int) -> None:
        """Drop a repository with all it holds."""
        for name in ("refs", "symbols", "files", "touches", "snapshots", "contracts", "repos"):
            rows = self.read(name)
            if not rows.isEmpty():
                self._rewrite(name, rows.filter(~F.col("repo_id").eqNullSafe(F.lit(repo_id))))

    def activate(self, repo_id: int, session_id: str, name: str, path: str | None, content_hash: str | None, at: str) -> None:
        """Set the contract of a session; a null path takes it away."""
        row = self.spark.createDataFrame([(repo_id, session_id, name, path, content_hash)], "repo_id long, session_id string, name string, path string, content_hash string")
        self._append("contracts", row.withColumn("activated_at", F.lit(at).cast("timestamp")))

    def contracts(self) -> DataFrame:
        """Active contracts: the latest row of (repo, session), without tombstones."""
        last = self.read("contracts").groupBy("repo_id", "session_id").agg(F.max(F.struct("activated_at", "name", "path", "content_hash")).alias("c"))
        return last.select("repo_id", "session_id", "c.name", "c.path", "c.content_hash").filter("path is not null")

    def backup(self, folder: str) -> None:
        """Copy every table; the target must not exist."""
        for name in SCHEMAS:
            self.read(name).write.mode("errorifexists").parquet(f"{folder}/{name}")
