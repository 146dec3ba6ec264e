"""Versions of models as tables in one folder: objects, manifests, commits and references; a single writer."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import compare, dedup, deltas, history, merge, remotes, store
from weftline.operators.lineage import cut


class RepositoryError(RuntimeError):
    pass


class MergeConflict(RepositoryError):
    def __init__(self, names: list):
        super().__init__(f"conflicting tensors: {names}")
        self.names = names


_COMMITS = "commit string, parents array<string>, author string, message string, at timestamp, tags array<string>"
_REFS = "name string, commit string, kind string, version long"
_VERSIONS = "version_id string, commit string, name string, description string, metrics map<string,double>"
STRATEGIES = ("ours", "theirs", "fail", "average", "weighted", "soup")


class Repository:
    """`models` have `name` and `values`. Manifests name objects by the sha256 of their values."""

    def __init__(self, spark: SparkSession, path: str, init: bool | None = None, delta_kind: str | None = None):
        """`init` True: the folder must not be a repository yet; False: it must be one; None: either. `delta_kind`: how changed tensors are stored (whole without one)."""
        self.spark, self.path, self.delta_kind = spark, path, delta_kind
        self.objects = store.ObjectStore(spark, f"{path}/objects")
        self.deltas = deltas.DeltaStore(spark, f"{path}/deltas")
        self.branch: str | None = "main"
        self.detached: str | None = None
        marker = store.ObjectStore(spark, f"{path}/format")
        exists = marker.read() is not None
        if init is True and exists or init is False and not exists:
            raise RepositoryError(f"{path} is {'already' if exists else 'not'} a repository")
        if not exists and init is not False:
            spark.createDataFrame([(1,)], "format int").write.mode("overwrite").parquet(marker.path)

    def _table(self, name: str, schema: str) -> DataFrame:
        have = store.ObjectStore(self.spark, f"{self.path}/{name}").read()
        return self.spark.createDataFrame([], schema) if have is None else have

    def commits(self) -> DataFrame:
        return self._table("commits", _COMMITS)

    def refs(self) -> DataFrame:
        """The newest entry of every reference; entries without a commit are deletions."""
        rows = self._table("refs", _REFS)
        return store.newest_refs(rows.filter("kind in ('branch', 'tag')"))

    def _point(self, name: str, commit: str | None, kind: str) -> None:
        row = self._table("refs", _REFS).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()
        self.spark.createDataFrame([(name, commit, kind, row["v"] + 1)], _REFS).write.mode("append").parquet(f"{self.path}/refs")

    def tip(self, branch: str) -> str | None:
        row = self.refs().filter((F.col("name") == branch) & (F.col("kind") == "branch")).first()
        return row["commit"] if row else None

    def commit(self, model: DataFrame, message: str, author: str = "", tags: tuple[str, ...] = (), parents: list[str] | None = None) -> str:
        """Stores what is new and appends a full snapshot; the branch moves to it."""
        if self.branch is None:
            raise RepositoryError("no branch is checked out")
        rows = model.select("name", F.col("values").cast("array<double>").alias("values")).withColumn("hash", deltas.content_hash(F.col("values"))).persist()
        tip = self.tip(self.branch)
        parents = parents if parents is not None else [tip] if tip else []
        summary = rows.agg(F.count("hash").alias("n"), F.bit_xor(F.xxhash64("name", "hash")).alias("x")).first()
        if not summary["n"]:
            rows.unpersist()
            raise RepositoryError("nothing to commit")
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        identity = json.dumps([parents, message, author, at.isoformat(), summary["n"], summary["x"]])
        name = hashlib.sha256(identity.encode()).hexdigest()[:32]
        whole, manifest = rows, rows.select("name", "hash").withColumn("delta_hash", F.lit(None).cast("string"))
        if self.delta_kind and parents:
            old = self._manifest(parents[0]).join(self._stored(), "hash").select("name", "hash", "values")
            made = deltas.against_parent(rows, old, self.delta_kind)
            self.deltas.add(made.drop("name"))
            manifest = rows.select("name", "hash").join(made.select("name", "delta_hash"), "name", "left")
            whole = rows.join(made.select("name"), "name", "left_anti")
        self.objects.add(whole.select("hash", "values"))
        manifest.select(F.lit(name).alias("commit"), "name", "hash", "delta_hash").write.mode("append").partitionBy("commit").parquet(f"{self.path}/manifests")
        self.spark.createDataFrame([(name, parents, author, message, at, list(tags))], _COMMITS).write.mode("append").parquet(f"{self.path}/commits")
        rows.unpersist()
        self._point(self.branch, name, "branch")
        return name

    def manifest(self, ref: str) -> DataFrame:
        """`name, hash, delta_hash` of a commit, branch, tag or beginning of a commit."""
        return self._manifest(self.resolve(ref))

    def _manifest(self, commit: str) -> DataFrame:
        rows = self._table("manifests", "commit string, name string, hash string, delta_hash string")
        return rows.filter(F.col("commit") == commit).select("name", "hash", "delta_hash")

    def model(self, ref: str, names: list[str] | None = None, strict: bool = True) -> DataFrame:
        """`name, values` at a reference, deltas decoded. With `strict`, tensors that can't be put together raise; else they are left out."""
        manifest = self.manifest(ref)
        if names is not None:
            manifest = manifest.filter(F.col("name").isin(names))
        out = deltas.reconstructed(manifest, self._stored(), self.deltas.table()).select("name", "values")
        if strict:
            lost = manifest.select("name").join(out.select("name"), "name", "left_anti").first()
            if lost is not None:
                raise RepositoryError(f"tensor {lost['name']} of {ref} isn't stored")
        return out

    def weight(self, name: str, ref: str) -> list[float] | None:
        row = self.model(ref, [name], False).first()
        return None if row is None else list(row["values"])

    def _stored(self) -> DataFrame:
        rows = self.objects.read()
        return self.spark.createDataFrame([], "hash string, values array<double>") if rows is None else rows

    def stage(self, model: DataFrame) -> DataFrame:
        """Writes a model to be committed, in place of what was staged before; `name, kind, ref` says which tensors are copies of which."""
        path = f"{self.path}/staging"
        model.select("name", F.col("values").cast("array<double>").alias("values")).write.mode("overwrite").parquet(path)
        staged = self.spark.read.parquet(path)
        return dedup.assign_all(staged).select("name", "kind", "ref")

    def staged(self) -> DataFrame | None:
        return store.ObjectStore(self.spark, f"{self.path}/staging").read()

    def commit_staged(self, message: str, author: str = "", tags: tuple[str, ...] = ()) -> str:
        rows = self.staged()
        if rows is None:
            raise RepositoryError("nothing is staged")
        name = self.commit(rows, message, author, tags)
        files, where = store.ObjectStore(self.spark, f"{self.path}/staging")._files()
        files.delete(where, True)
        return name

    def log(self, ref: str | None = None, most: int = 10) -> DataFrame:
        """`commit, depth, message, author, at` along first parents, newest first."""
        tip = self.resolve(ref) if ref else self.head()
        if tip is None:
            return self.commits().select("commit", F.lit(0).alias("depth"), "message", "author", "at").limit(0)
        chain = history.log(self.edges(), self.spark.createDataFrame([(tip,)], "src string"), most)
        return chain.join(self.commits(), F.col("node") == F.col("commit")).select("commit", "depth", "message", "author", "at").orderBy("depth")

    def create_branch(self, name: str, ref: str | None = None) -> None:
        """A new branch at a commit, branch, tag or beginning of a commit; the current commit without one."""
        if self.tip(name) is not None:
            raise RepositoryError(f"branch {name} exists")
        start = self.resolve(ref) if ref else self.head()
        if start is None:
            raise RepositoryError("there is no commit yet")
        self._point(name, start, "branch")

    def delete_branch(self, name: str) -> None:
        if name == self.branch:
            raise RepositoryError("the current branch can't be deleted")
        if self.tip(name) is None:
            raise RepositoryError(f"no branch {name}")
        self._point(name, None, "branch")

    def branches(self) -> DataFrame:
        """`name, commit, current` of all branches."""
        return self.refs().filter("kind = 'branch'").select("name", "commit", F.col("name").eqNullSafe(F.lit(self.branch)).alias("current"))

    def move_branch(self, name: str, ref: str) -> None:
        if self.tip(name) is None:
            raise RepositoryError(f"no branch {name}")
        self._point(name, self.resolve(ref), "branch")

    def checkout(self, target: str) -> None:
        """To a branch, or to a commit by itself (no branch is current then, and nothing can be committed)."""
        if self.tip(target) is not None:
            self.branch, self.detached = target, None
        else:
            self.branch, self.detached = None, self.resolve(target)

    def head(self) -> str | None:
        """The current commit."""
        return self.detached if self.branch is None else self.tip(self.branch)

    def keep_head(self) -> None:
        """Writes which branch or commit is current, for `open_head` of a later session."""
        self._point("HEAD", self.branch or self.detached, "branch-head" if self.branch else "commit-head")

    def open_head(self) -> None:
        rows = self._table("refs", _REFS).filter("name = 'HEAD'")
        row = rows.orderBy(F.desc("version")).first()
        if row is not None:
            self.branch, self.detached = (row["commit"], None) if row["kind"] == "branch-head" else (None, row["commit"])

    def resolve(self, ref: str) -> str:
        """The commit of an exact hash, branch, tag or beginning of a hash, in this order."""
        commits = self.commits().select(F.col("commit").alias("name"), "commit", F.lit("commit").alias("kind"))
        refs = self.refs().select("name", "commit", "kind").unionByName(commits)
        row = store.resolve(refs, self.spark.createDataFrame([(ref,)], "ref string")).first()
        if row is None:
            raise RepositoryError(f"unknown reference {ref}")
        return row["commit"]

    def tag(self, name: str, ref: str | None = None, description: str | None = None, metrics: dict[str, float] | None = None) -> str:
        """A named version of a commit; returns its id."""
        commit = self.resolve(ref) if ref else self.head()
        if commit is None:
            raise RepositoryError("there is no commit yet")
        self._point(name, commit, "tag")
        version = hashlib.sha256(f"{name}:{commit}".encode()).hexdigest()[:16]
        values = {k: float(v) for k, v in (metrics or {}).items()}
        self.spark.createDataFrame([(version, commit, name, description, values)], _VERSIONS).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def versions(self) -> DataFrame:
        return self._table("versions", _VERSIONS)

    def edges(self) -> DataFrame:
        return self.commits().select(F.col("commit").alias("child"), F.posexplode("parents").alias("place", "parent"))

    def diff(self, old: str, new: str) -> DataFrame:
        return compare.diff(self.manifest(old), self.manifest(new))

    def common_ancestor(self, a: str, b: str) -> str | None:
        """The latest commit that both references descend from, selves included."""
        one, two = self.resolve(a), self.resolve(b)
        if one == two:
            return one
        row = history.common_ancestor(self.edges(), self.spark.createDataFrame([(one, two)], "a string, b string")).first()
        return None if row is None else row["ancestor"]

    def merge(self, branch: str, base: str | None = None, strategy: str = "ours", alpha: float = 0.5, config: merge.SoupConfig | None = None) -> str:
        """Merges a branch into the current one and returns the commit that is current then.

        The base is the common ancestor unless given. A branch that is already in the current one changes nothing; if the
        current one is the ancestor it moves ahead without a new commit. Strategies: ours, theirs, fail, average and
        weighted decide conflicts only; soup merges all tensors of both sides as `config` says.
        """
        if strategy not in STRATEGIES:
            raise RepositoryError(f"unknown strategy {strategy}")
        if self.branch is None:
            raise RepositoryError("no branch is checked out")
        mine, other = self.tip(self.branch), self.tip(branch)
        if mine is None or other is None:
            raise RepositoryError(f"no branch {branch if other is None else self.branch}")
        if mine == other:
            raise RepositoryError("both branches are at the same commit")
        found = self.resolve(base) if base else self.common_ancestor(self.branch, branch)
        if base is None and found == other:
            return mine
        if base is None and found == mine:
            self._point(self.branch, other, "branch")
            return other
        if strategy == "soup":
            model = self._soup(branch, found, config or merge.SoupConfig())
        else:
            model = self._three_way(branch, found, strategy, alpha)
        return self.commit(model, f"merge {branch}", tags=("merge",), parents=[mine, other])

    def _three_way(self, branch: str, base: str | None, strategy: str, alpha: float) -> DataFrame:
        ours, theirs = self.manifest(self.branch), self.manifest(branch)
        pair = (theirs, ours) if strategy == "theirs" else (ours, theirs)
        merged = compare.three_way(ours.limit(0) if base is None else self._manifest(base), *pair)
        if strategy == "fail":
            names = [r["name"] for r in merged.filter("conflict").select("name").orderBy("name").limit(100).collect()]
            if names:
                raise MergeConflict(names)
        # a merged hash is one of either side's, so its values are found there, deltas decoded
        known = None
        for ref in (self.branch, branch):
            rows = self.manifest(ref).select("name", "hash").join(self.model(ref), "name").select("hash", "values")
            known = rows if known is None else known.unionByName(rows)
        model = merged.join(known.dropDuplicates(["hash"]), "hash").select("name", "values", "conflict")
        if strategy in ("weighted", "average"):
            mixed = merge.interpolate(self._cells(self.branch), self._cells(branch), 0.5 if strategy == "average" else alpha)
            sizes = self.model(self.branch).select("name", F.size("values").alias("n")).join(self.model(branch).select("name", F.size("values").alias("m")), "name").filter("n = m").select("name")
            arrays = _arrays(mixed, "mixed").join(sizes, "name", "left_semi")  # tensors of another shape stay ours
            model = model.join(arrays, "name", "left").select("name", F.when(F.col("conflict"), F.coalesce("mixed", "values")).otherwise(F.col("values")).alias("values"))
        return model.select("name", "values")

    def _soup(self, branch: str, base: str | None, config: merge.SoupConfig) -> DataFrame:
        return _arrays(merge.soup([self._cells(self.branch), self._cells(branch)], config, None if base is None else self._cells(base)), "values")

    def _cells(self, ref: str) -> DataFrame:
        return self.model(ref).select("name", F.posexplode("values").alias("pos", "x"))

    def collect_garbage(self, remove: bool = False) -> DataFrame:
        """Objects that no manifest and no delta names, and (with `remove`) away with them and with deltas that no manifest names."""
        manifests, made = self._table("manifests", "commit string, name string, hash string, delta_hash string"), self.deltas.table()
        loose = store.garbage(self._stored().select("hash"), manifests, made.select(F.col("reference").alias("hash")))
        if remove:
            loose = cut(loose)  # before the files it is read from change
            self.deltas.delete(made.select(F.col("delta_hash").alias("hash")).join(manifests.select(F.col("delta_hash").alias("hash")), "hash", "left_anti"))
            self.objects.delete(loose)
        return loose

    def push(self, remote: str, force: bool = False) -> DataFrame:
        """Copies objects, deltas, manifests, commits and references that the repository at another path lacks; result per action."""
        other = Repository(self.spark, remote)
        have = other._stored().select("hash")
        planned = remotes.plan(self._stored().select("hash"), have, "push", force)
        sizes = self._stored().select("hash", (F.size("values") * 8).cast("long").alias("bytes"))
        out = [tuple(r) for r in remotes.result(planned, sizes).collect()]
        other.objects.add(self._stored())
        other.deltas.add(self.deltas.table())
        for table, key, schema in (("commits", "commit", _COMMITS), ("manifests", "commit", "commit string, name string, hash string, delta_hash string"), ("versions", "version_id", _VERSIONS)):
            new = self._table(table, schema).join(other._table(table, schema).select(key).distinct(), key, "left_anti")
            writer = new.write.mode("append")
            (writer.partitionBy("commit") if table == "manifests" else writer).parquet(f"{remote}/{table}")
        there = other.refs().withColumnRenamed("commit", "old")
        moved = self.refs().join(there, ["name", "kind"], "left").filter("old is null or old <> commit")
        for r in moved.collect():  # references are few: one row for each branch and tag
            other._point(r["name"], r["commit"], r["kind"])
        return self.spark.createDataFrame(out, "action string, moved long, bytes long, errors long, success boolean")

    def pull(self, remote: str, force: bool = False) -> DataFrame:
        return Repository(self.spark, remote).push(self.path, force)

    def sync_status(self, remote: str) -> DataFrame:
        return store.sync_status(self._stored().select("hash"), Repository(self.spark, remote)._stored().select("hash"))


def clone(spark: SparkSession, remote: str, path: str) -> Repository:
    """A new repository with all that the one at `remote` has, commits and references included."""
    out = Repository(spark, path, init=True)
    Repository(spark, remote, init=False).push(path)
    return out


def _arrays(cells: DataFrame, name: str) -> DataFrame:
    return cells.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(name))
