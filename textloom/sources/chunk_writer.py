"""Chunk files: a writer with staged files, commit and abort, and a body table that rereads changed files alone."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import token_estimate
from . import files
from .shared import stored

STAGING = "_staging"
FIELDS = ["id", "tradition", "text_name", "section", "translator", "source_url", "token_count"]
#: Up to so many changed files are read by Spark's reader, by their names; more are opened in tasks that are dealt their names.
NAMED = 10_000
#: How tables of a row a file are joined: they are small on disk for what they hold, and a broadcast passes through the driver.
SORTED = "merge"
#: Files that are moved at a time when a run is committed.
MOVES = 16


def _quoted(x) -> str:
    """A TOML value: JSON's strings, numbers and arrays are TOML's too, but for one control character."""
    return json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")


def chunk_toml(row: dict) -> str:
    head = [f"{k} = {_quoted(row[k])}" for k in FIELDS if row.get(k) is not None]
    notes = [f"{k} = {_quoted(list(row.get(k) or []))}" for k in ("concepts", "related_chunks")]
    return "\n".join(["[chunk]", *head, "", "[content]", f"body = {_quoted(row.get('body') or '')}", "", "[annotations]", *notes, ""])


def relative_path(chunk_id: str | None) -> str:
    """``<tradition>/<text>/chunks/<seq>.toml`` of a chunk id; it has three parts, none of which leads elsewhere."""
    parts = (chunk_id or "").split(".", 2)
    if len(parts) != 3 or any(not p or "/" in p or "\\" in p or p in (".", "..") for p in parts):
        raise ValueError(f"not the id of a chunk: {chunk_id}")
    return f"{parts[0]}/{parts[1]}/chunks/{parts[2]}.toml"


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    files: int


class _Writer(DataSourceWriter):
    """A task stages its files in a folder of its own; the commit names the folders of the tasks that ended, then moves
    their files into place.  What other attempts have left goes with the staging folder."""

    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def _at(self):
        store, base = fs.FileSystem.from_uri(self.root)
        return store, base, f"{base}/{STAGING}/{self.run}"

    def write(self, rows):
        store, _, at = self._at()
        attempt, n, there = uuid.uuid4().hex, 0, set()
        for row in rows:
            path = f"{at}/{attempt}/{relative_path(row['id'])}"
            _ensure(store, posixpath.dirname(path), there)
            with store.open_output_stream(path) as out:
                out.write(chunk_toml(row.asDict()).encode())
            n += 1
        return Staged(attempt, n)

    def commit(self, messages):
        store, base, at = self._at()
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/commit.json") as out:
            out.write(json.dumps([m.attempt for m in messages if m]).encode())
        _finish(store, base, at)

    def abort(self, messages):
        store, base, at = self._at()
        _remove(store, at)
        _remove_empty(store, f"{base}/{STAGING}")


def _ensure(store, folder: str, there: set[str]) -> None:
    """Create a folder unless it is among those known to be there."""
    if folder not in there:
        store.create_dir(folder, recursive=True)
        there.add(folder)


def _remove(store, at: str) -> None:
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


def _remove_empty(store, at: str) -> None:
    if store.get_file_info(at).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(at)):
        store.delete_dir(at)


def _folders(store, at: str) -> Iterator[tuple[str, list[str]]]:
    """The folders under ``at`` that have files, with their names: only those of one folder of one task are held."""
    todo = [at]
    while todo:
        folder = todo.pop()
        inside = store.get_file_info(fs.FileSelector(folder))
        todo += [x.path for x in inside if x.type == fs.FileType.Directory]
        if names := [x.base_name for x in inside if x.type == fs.FileType.File]:
            yield folder, names


def _finish(store, base: str, at: str) -> None:
    """Move the files of a run whose commit has begun; a file that is in place already is not there to move."""
    with store.open_input_stream(f"{at}/commit.json") as f:
        attempts = json.loads(f.read())
    with ThreadPoolExecutor(MOVES) as pool:
        for a in attempts:
            here = f"{at}/{a}"
            if store.get_file_info(here).type != fs.FileType.Directory:
                continue
            for folder, names in _folders(store, here):
                to = base + folder[len(here) :]
                store.create_dir(to, recursive=True)
                deque(pool.map(lambda n: store.move(f"{folder}/{n}", f"{to}/{n}"), names), maxlen=0)  # noqa: B023 (ends in this round)
    _remove(store, at)
    _remove_empty(store, f"{base}/{STAGING}")


def recover(root: str) -> dict[str, int]:
    """After a crash: runs whose commit had begun are ended, all others are thrown away."""
    store, base = fs.FileSystem.from_uri(root)
    done = {"ended": 0, "thrown away": 0}
    if store.get_file_info(f"{base}/{STAGING}").type == fs.FileType.Directory:
        for x in store.get_file_info(fs.FileSelector(f"{base}/{STAGING}")):
            if store.get_file_info(f"{x.path}/commit.json").type == fs.FileType.File:
                _finish(store, base, x.path)
                done["ended"] += 1
            else:
                _remove(store, x.path)
                done["thrown away"] += 1
        _remove_empty(store, f"{base}/{STAGING}")
    return done


class ChunkFiles(DataSource):
    """``df.write.format("textloom_chunks").mode("append").save(root)``: a TOML file a chunk."""

    @classmethod
    def name(cls):
        return "textloom_chunks"

    def schema(self):
        return files.CHUNK

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("chunk files are replaced one by one: use mode('append')")
        return _Writer(self.options["path"])


def write_chunks(chunks: DataFrame, root: str, commit: bool = False) -> DataFrame:
    """``id, path, action``: what writing these chunks (id, body and other fields of ``read_chunks``) does: create, replace or
    same.  Token counts are made anew from the bodies.  Only with ``commit`` are files written, and only those that differ.
    """
    spark = chunks.sparkSession
    p = F.split("id", r"\.", 3)
    path = F.concat(F.get(p, 0), F.lit("/"), F.get(p, 1), F.lit("/chunks/"), F.get(p, 2), F.lit(".toml"))
    new = chunks.withColumn("token_count", token_estimate(F.col("body")).cast("int"))
    known = [c for c in [*FIELDS, "body", "concepts", "related_chunks"] if c in new.columns]
    try:
        old = files.read_chunks(spark, root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], files.CHUNK)
    same = F.struct(*[F.col(c) for c in known if c != "id"])
    both = new.select("id", same.alias("new")).join(old.select("id", same.alias("old")).hint(SORTED), "id", "left")
    plan = both.select("id", path.alias("path"), F.when(F.col("old").isNull(), "create").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("replace").alias("action"))
    if not commit:
        return plan
    kept = stored(plan, "chunk_plan")  # read before the files change
    spark.dataSource.register(ChunkFiles)
    rows = new.join(kept.filter("action <> 'same'").select("id").hint(SORTED), "id", "left_semi").select(*known)
    rows.repartition(files.many(spark)).write.format("textloom_chunks").mode("append").save(root)
    return kept


def refresh_bodies(spark: SparkSession, store, root: str, table: str = "chunk_bodies") -> dict[str, int]:
    """Bring the store's table of chunk files up to date: a row a file with its time and size, parsed again only where
    these have changed.  Returns the numbers of files ``parsed``, ``kept`` and ``gone``; files that are not there have no row.
    """
    now = stored(files.list_files(spark, root, ".toml").filter(files.CHUNKS), "listed")
    key = ["path", "modified", "size"]
    old = store.read(table) if store.current(table) else None
    changed = stored(now.join(old.select(*key).hint(SORTED), key, "left_anti"), "changed") if old is not None else now
    n = changed.count()
    if n <= NAMED:
        paths = [r["path"] for r in changed.select("path").collect()]
        parsed = files.read_chunk_files(spark, paths) if paths else spark.createDataFrame([], files.CHUNK)
    else:
        parsed = files.open_chunk_files(changed.select("path"), root)
    rows = parsed.join(now.hint(SORTED), "path")
    kept = old.join(now.hint(SORTED), key, "left_semi") if old is not None else None
    counts = {"parsed": n, "kept": kept.count() if kept is not None else 0}
    counts["gone"] = (old.join(now.select("path").hint(SORTED), "path", "left_anti").count()) if old is not None else 0
    if n or counts["gone"]:
        store.write(table, rows if kept is None else kept.select(*rows.columns).unionByName(rows))
    return counts
