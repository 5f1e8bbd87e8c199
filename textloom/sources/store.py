"""Versioned Parquet tables: snapshots that can be restored, retention with a sweep, export guards."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables as ``<root>/<table>/v=<n>``; ``<root>/published.json`` names each one's published version.

    Versions are written whole before the one pointer is replaced, in a single
    rename, so a reader sees the old tables or the new ones, and several tables
    can be published together.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(f"{path}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(self._path(f"{path}.new")), self._fs.makeQualified(self._path(path)), how)

    def _get(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path).collect())

    def versions(self, table: str) -> list[int]:
        at = self._path(f"{self.root}/{table}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def _state(self) -> dict:
        at = f"{self.root}/published.json"
        return json.loads(self._get(at)) if self._fs.exists(self._path(at)) else {}

    def published(self) -> dict[str, int]:
        return {t: v for t, v in self._state().items() if t != "_done"}

    def done(self, name: str) -> int:
        """The last step of a numbered job that is published; -1: none."""
        return self._state().get("_done", {}).get(name, -1)

    def current(self, table: str) -> int | None:
        return self.published().get(table)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.current(table) if version is None else version
        if v is None:
            raise ValueError(f"no published version of {table}")
        return self.spark.read.parquet(f"{self.root}/{table}/v={v}")

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None, sort_by: list[str] | None = None, publish: bool = True) -> int:
        v = max(self.versions(table), default=0) + 1
        df = df.sortWithinPartitions(*sort_by) if sort_by else df
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.root}/{table}/v={v}")
        if publish:
            self.publish(table, v)
        return v

    def publish(self, table: str, version: int) -> None:
        self._publish({table: version})

    def _publish(self, versions: dict[str, int], step: tuple[str, int] | None = None) -> None:
        state = self._state()
        if step:
            state["_done"] = state.get("_done", {}) | {step[0]: step[1]}
        self._put(f"{self.root}/published.json", json.dumps(state | versions, sort_keys=True))

    def commit(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, step: tuple[str, int] | None = None) -> dict[str, int]:
        """Replace some tables, append to others, and publish them all at once.

        ``step``: name and number of a step of a job that may be run again after a
        crash; the number is published with the tables, and a step that is not
        beyond the last one changes nothing.
        """
        if step and step[1] <= self.done(step[0]):
            return {}
        new = dict(replaced) | {t: self.read(t).unionByName(d) if self.current(t) else d for t, d in (appended or {}).items()}
        versions = {t: self.write(t, d, publish=False) for t, d in new.items()}
        self._publish(versions, step)
        return versions

    def append(self, table: str, df: DataFrame) -> int:
        old = self.read(table).unionByName(df) if self.current(table) else df
        return self.write(table, old)

    def _counts(self, pinned: dict[str, int], canaries: dict[str, tuple[str, str]]) -> dict[str, dict]:
        """Rows and a digest of each table, in any order of rows, and what the canaries count: one job over all."""
        parts = []
        for t, v in pinned.items():
            df = self.read(t, v)
            counts = {n: F.count_if(F.expr(p)) for n, (of, p) in canaries.items() if of == t}
            kept = F.to_json(F.struct(*[c.alias(n) for n, c in counts.items()])) if counts else F.lit("{}")
            row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
            digest = F.concat_ws("-", F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)))
            parts.append(df.agg(F.lit(t).alias("table"), F.count("*").alias("rows"), digest.alias("digest"), kept.alias("canaries")))
        return {r["table"]: {"version": pinned[r["table"]], "rows": r["rows"], "digest": r["digest"], "canaries": json.loads(r["canaries"])} for r in reduce(DataFrame.unionByName, parts).collect()}

    def snapshot(self, tables: list[str], name: str | None = None, canaries: dict[str, tuple[str, str]] | None = None) -> dict:
        """Pin the published versions of tables under a name, with their rows, digests and ``canaries``
        (name: table and predicate, whose rows are counted), kept as JSON."""
        name = name or time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
        if not tables:
            raise ValueError("a snapshot of nothing")
        now = self.published()
        if missing := [t for t in tables if t not in now]:
            raise ValueError(f"no published version of {', '.join(missing)}")
        kept = {"tables": self._counts({t: now[t] for t in tables}, canaries or {}), "canaries": canaries or {}}
        self._put(f"{self.root}/_snapshots/{name}.json", json.dumps(kept, sort_keys=True))
        return kept["tables"]

    def _snapshot(self, name: str) -> dict:
        return json.loads(self._get(f"{self.root}/_snapshots/{name}.json"))

    def snapshots(self) -> list[str]:
        """Names, the newest first."""
        at = self._path(f"{self.root}/_snapshots")
        files = self._fs.listStatus(at) if self._fs.exists(at) else []
        files = sorted(files, key=lambda s: (s.getModificationTime(), s.getPath().getName()), reverse=True)
        return [n.removesuffix(".json") for s in files if (n := s.getPath().getName()).endswith(".json")]

    def verify(self, name: str) -> bool:
        """Whether a snapshot's tables are there and hold what they held."""
        kept = self._snapshot(name)
        pinned = {t: p["version"] for t, p in kept["tables"].items()}
        if any(v not in self.versions(t) for t, v in pinned.items()):
            return False
        return self._counts(pinned, {n: tuple(c) for n, c in kept["canaries"].items()}) == kept["tables"]

    def restore(self, name: str) -> dict[str, int]:
        """Publish a snapshot's versions again, all at once, if they are whole; other tables stay as they are."""
        if not self.verify(name):
            raise ValueError(f"snapshot {name} is not whole")
        versions = {t: p["version"] for t, p in self._snapshot(name)["tables"].items()}
        self._publish(versions)
        return versions

    def retain(self, keep: int) -> list[str]:
        """Forget all but the newest snapshots, then delete the versions that nothing names; returns the names that went."""
        gone = self.snapshots()[keep:]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/_snapshots/{n}.json"), False)
        self.sweep()
        return [f"{n}.json" for n in gone]

    def unreachable(self) -> dict[str, list[int]]:
        """Versions that neither the published pointer nor a snapshot names: replaced ones, and those of failed runs."""
        named = [(t, v) for t, v in self.published().items()]
        named += [(t, p["version"]) for n in self.snapshots() for t, p in self._snapshot(n)["tables"].items()]
        root = self._path(self.root)
        dirs = [s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()] if self._fs.exists(root) else []
        out = {t: [v for v in self.versions(t) if (t, v) not in named] for t in sorted(dirs) if not t.startswith("_")}
        return {t: v for t, v in out.items() if v}

    def sweep(self, commit: bool = True) -> dict[str, list[int]]:
        """Delete the unreachable versions (without ``commit``: only name them).  As for all changes, one writer at a time.

        What is reachable is asked anew each time, so that a sweep that was cut off is
        ended by the next, and never goes on with what has been named meanwhile.
        """
        gone = self.unreachable()
        for t, versions in gone.items() if commit else ():
            for v in versions:
                self._remove(t, v)
        return gone

    def _remove(self, table: str, version: int) -> None:
        self._fs.delete(self._path(f"{self.root}/{table}/v={version}"), True)


class ExportRefused(ValueError):
    """A table is not fit to be exported."""


def check_export(summaries: DataFrame, embeddings: DataFrame, runs: DataFrame, edges_changed_at: str | None = None) -> None:
    """Raise unless every summary has an embedding and the last derived run is whole, not empty, and fresh."""
    if not summaries.join(embeddings.select("id"), "id", "left_anti").isEmpty():
        raise ExportRefused("a summary lacks its embedding")
    last = runs.orderBy(F.desc("run_id")).first()
    if last is None or not last["edge_rows"]:
        raise ExportRefused("the last derived run has no rows")
    if last["limit_concepts"] is not None:
        raise ExportRefused("the last derived run is partial")
    if edges_changed_at is not None and last["generated_at"] < edges_changed_at:
        raise ExportRefused("the last derived run is older than the edges")


# The indexes that the exported tables get once their rows are in.
INDEXES = [
    ("chunks_text_id", "chunks", "text_id", "btree"),
    ("chunks_tradition", "chunks", "tradition", "btree"),
    ("chunks_embedding_hnsw", "chunks", "embedding", "hnsw"),
    ("edges_source", "edges", "source", "btree"),
    ("edges_target", "edges", "target", "btree"),
    ("idx_concept_families_parent", "concept_families", "parent_id", "btree"),
    ("idx_concept_primary_family", "concept_family_membership", "concept_id", "primary"),
    ("idx_concept_family_membership_family", "concept_family_membership", "family_id", "btree"),
    ("idx_concept_aliases_alias", "concept_aliases", "alias", "btree"),
    ("idx_family_aliases_alias", "family_aliases", "alias", "btree"),
]


def index_ddl(schema: str, indexes=INDEXES) -> list[str]:
    forms = {
        "btree": "CREATE INDEX {n} ON {s}.{t} ({c});",
        "hnsw": "CREATE INDEX {n} ON {s}.{t} USING hnsw ({c} vector_cosine_ops);",
        "primary": "CREATE UNIQUE INDEX {n} ON {s}.{t} ({c}) WHERE is_primary;",
    }
    return [forms[kind].format(n=n, s=schema, t=t, c=c) for n, t, c, kind in indexes]


def grant_ddl(schema: str, role: str) -> list[str]:
    """Grants on the staging schema: they stay with it when it is renamed."""
    return [f"GRANT USAGE ON SCHEMA {schema} TO {role};", f"GRANT SELECT ON ALL TABLES IN SCHEMA {schema} TO {role};"]
