"""Structure facts: latest snapshots, lookups, root hashes, listings, coverage.

Inputs are the store's relations: snapshots(snapshot_id, repo_id, session_id,
label, timestamp, root, root_hash), files(file_id, snapshot_id, path,
content_hash), symbols(file key, name, kind, sig_hash), refs(file key, name).
Latest-per-group reads use aggregates that combine before the shuffle, so a
repository with a third of all snapshots sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directory names that are never indexed.
IGNORED_DIRS = (
    "node_modules", "dist", ".git", ".cursor", ".vscode", "testdata", ".venv", "venv", "__pycache__", "site-packages",
    ".tox", "vendor",
)
#: Kinds that are kept in the store but not shown.
INTERNAL_KINDS = ("unexported", "field")
#: Names a kind may be asked by.
KIND_ALIASES = {
    "func": "function", "function": "function", "class": "class", "cls": "class", "export": "export", "exp": "export",
    "import": "import", "imp": "import",
}


def distinct_snapshots(snapshots: DataFrame) -> DataFrame:
    """Repeated rows once; of rows with one id the latest timestamp counts."""
    rest = [c for c in snapshots.columns if c != "snapshot_id"]
    return (
        snapshots.groupBy("snapshot_id").agg(F.max(F.struct("timestamp", *[c for c in rest if c != "timestamp"])).alias("s"))
        .select("snapshot_id", *[F.col(f"s.{c}").alias(c) for c in rest])
    )


def latest_by(snapshots: DataFrame, by: list[str]) -> DataFrame:
    """Newest snapshot of each group by timestamp, then id; groups with a null key are left out."""
    rest = [c for c in snapshots.columns if c not in (*by, "timestamp", "snapshot_id")]
    newest = F.max(F.struct("timestamp", "snapshot_id", *rest)).alias("s")
    return snapshots.dropna(subset=by).groupBy(*by).agg(newest).select(
        *by, *[F.col(f"s.{c}").alias(c) for c in ("timestamp", "snapshot_id", *rest)]
    )


def with_file_count(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_count, 0 where a snapshot lists no file."""
    counts = files.groupBy("snapshot_id").agg(F.count("*").alias("file_count"))
    return snapshots.join(counts, "snapshot_id", "left").fillna(0, ["file_count"])


def newest_n(snapshots: DataFrame, n: int) -> DataFrame:
    """The n newest of all, -1 for all (a top-k over partitions, no global sort)."""
    ordered = snapshots.orderBy(F.col("timestamp").desc(), F.col("snapshot_id").desc())
    return ordered if n < 0 else ordered.limit(n)


def prunable(snapshots: DataFrame, keep: int, label: str = "reindex") -> DataFrame:
    """Snapshots of ``label`` beyond the ``keep`` newest of their repository; null repositories are never pruned.

    The keep-th newest of each group is found by a limited ranking that each task
    cuts before the shuffle; rows older than it are candidates.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    rows = snapshots.filter((F.col("label") == label) & F.col("repo_id").isNotNull())
    order = Window.partitionBy("repo_id").orderBy(F.col("timestamp").desc(), F.col("snapshot_id").desc())
    edge = (
        rows.select("repo_id", "timestamp", "snapshot_id").withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= keep).groupBy("repo_id")
        .agg(F.min(F.struct("timestamp", "snapshot_id")).alias("edge"), F.count("*").alias("held"))
        .filter(F.col("held") == keep)
    )
    return rows.join(edge, "repo_id").filter(F.struct("timestamp", "snapshot_id") < F.col("edge")).drop("edge", "held")


def root_hash(files: DataFrame) -> DataFrame:
    """(snapshot_id, root_hash): SHA-256 over the path-sorted lines ``path:hash``, joined by line ends."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat(x["path"], F.lit(":"), x["content_hash"]))
    return files.groupBy("snapshot_id").agg(F.sha2(F.array_join(line, "\n"), 256).alias("root_hash"))


def known_set(latest: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, name): every symbol name of each repository's latest snapshot."""
    return latest.join(files, "snapshot_id").join(symbols, "file_id").select("repo_id", "name").distinct()


def expanded(names: DataFrame, column: str = "name") -> DataFrame:
    """Names and their last dotted segments."""
    both = F.array(F.col(column), F.substring_index(column, ".", -1))
    return names.select(F.explode(F.array_distinct(both)).alias("name")).distinct()


def callers_of(refs: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """(snapshot_id, name, path) of the files that refer to a name."""
    return refs.filter(F.col("name").isin(names)).join(files, "file_id").select("snapshot_id", "name", "path").distinct()


def definers_of(symbols: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """(snapshot_id, name, path) of the files that define a name as function or class."""
    mine = symbols.filter(F.col("name").isin(names) & F.col("kind").isin("function", "class"))
    return mine.join(files, "file_id").select("snapshot_id", "name", "path").distinct()


def visible(path: Column) -> Column:
    """No directory of the path is an ignored one."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRS)))


def top_directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise(path)


def locate_matches(name: Column, query: str) -> Column:
    """Equal, prefix, or last dotted segment equal."""
    return (name == query) | name.startswith(query) | ((F.instr(name, ".") > 0) & (F.substring_index(name, ".", -1) == query))


def normal_kind(asked: Column) -> Column:
    """The kind that a name asks for, '' for the empty name (any kind), null for an unknown one."""
    kind = F.when(asked == "", F.lit(""))
    for alias, name in KIND_ALIASES.items():
        kind = kind.when(asked == alias, name)
    return kind


def containing(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(file_id, repo_id): the repository whose root is the path or a directory above it, the innermost, then the lowest id.

    Every directory of a path joins by equality, so there is no range or cross join.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    roots = repos.select(F.regexp_replace("root", "/+$", "").alias("head"), "repo_id")
    met = files.select("file_id", F.explode(heads).alias("head")).filter("head <> ''").join(roots, "head")
    return met.groupBy("file_id").agg(F.max_by("repo_id", F.struct(F.length("head"), -F.col("repo_id"))).alias("repo_id"))


def resolve_repos(dirs: DataFrame, repos: DataFrame) -> DataFrame:
    """(dir, repo_id) of (dir, top, common_dir, worktrees), null where nothing is enrolled.

    First by common directory: one enrolment counts at once; of several the one whose path is
    the top level, else the lowest id. Then by the top level's path, then by the paths of the
    worktrees in their order.
    """
    trimmed = lambda c: F.regexp_replace(c, "/+$", "")
    known = repos.filter("coalesce(common_dir, '') <> ''").select("common_dir", trimmed("path").alias("path"), "repo_id")
    shared = known.groupBy("common_dir").agg(F.min("repo_id").alias("first"), F.count("*").alias("n"))
    own = known.groupBy("common_dir", F.col("path").alias("own_path")).agg(F.min("repo_id").alias("own"))
    paths = repos.groupBy("path").agg(F.min("repo_id").alias("repo_id"))
    rows = dirs.join(shared, "common_dir", "left").join(own, (dirs.common_dir == own.common_dir) & (trimmed(dirs.top) == own.own_path), "left").drop(own.common_dir)
    rows = rows.join(paths.select(F.col("path").alias("top"), F.col("repo_id").alias("at_top")), "top", "left")
    trees = dirs.select("dir", F.posexplode("worktrees").alias("k", "path")).join(paths, "path")
    trees = trees.groupBy("dir").agg(F.min_by("repo_id", "k").alias("at_tree"))
    found = F.when(F.col("n") == 1, F.col("first")).when(F.col("n") > 1, F.coalesce("own", "first")).otherwise(F.coalesce("at_top", "at_tree"))
    return rows.join(trees, "dir", "left").select("dir", found.alias("repo_id"))


def upserted(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows after single-row changes: a change with null values deletes its key, any other replaces or adds it."""
    rest = [c for c in changes.columns if c not in key]
    written = changes.dropna(how="all", subset=rest)
    return rows.join(changes.select(*key), key, "left_anti").select(*key, *rest).unionByName(written.select(*key, *rest))


def live_symbol_changes(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(path, kind, name, status) of a stored state against a live one, both (path, kind, name, sig_hash) once each.

    Kinds that are not shown are left out of the live side, as they are when a live tree is
    compared; a stored one therefore comes out as removed. Changed needs a hash on both sides.
    """
    shown = live.filter(~F.col("kind").isin(*INTERNAL_KINDS))
    key = ["path", "kind", "name"]
    both = stored.select(*key, F.col("sig_hash").alias("a")).join(shown.select(*key, F.col("sig_hash").alias("b")), key, "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")), "modified")
    return both.select(*key, status.alias("status")).filter("status is not null")


def one_repository(snapshots: DataFrame, before_id: int, after_id: int) -> None:
    """Raises unless both snapshots are of one repository: states of different ones are not compared."""
    found = snapshots.filter(F.col("snapshot_id").isin(before_id, after_id)).select("repo_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("the snapshots are of different repositories")


def coverage_percent(indexed: Column, supported: Column) -> Column:
    """Share in percent with one decimal; 0 where nothing is supported."""
    return F.when(supported == 0, F.lit(0.0)).otherwise(F.round(indexed * F.lit(1000.0) / supported) / 10)


def capped(files: DataFrame, cap: Column, group: str) -> DataFrame:
    """Walk order (component-wise, directories by name) with the first ``cap`` parsed files of each group marked indexed.

    The limit on the rank is applied before the rows of a group meet, so a group with a third
    of all files sends ``cap`` rows a task. ``file_id`` is unique.
    """
    order = Window.partitionBy(group).orderBy(F.split("path", "/"), "file_id")
    first = files.filter("parse_ok").select(group, "path", "file_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)
    marked = files.join(first.select("file_id", F.lit(True).alias("indexed")), "file_id", "left")
    return marked.withColumn("indexed", F.coalesce("indexed", F.lit(False)))
