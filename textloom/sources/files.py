"""Readers: TOML corpora, raw texts in one or several pages, HTML pages, JSON fixtures."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "path string, id string, tradition string, text_name string, section string, translator string, source_url string, token_count int, body string, concepts array<string>, related_chunks array<string>"
TEXT = "path string, tradition_dir string, tradition string, text_id string, text_name string, translator string, source_url string, sections_format string, chunk_count int"


def many(spark: SparkSession) -> int:
    """Tasks for many small files: a few a core, however many files there are."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_files(spark: SparkSession, root: str | list[str], glob: str) -> DataFrame:
    """Spark's table of files, in few tasks: it would take one for every thirty files or so."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).coalesce(many(spark))


def _seen(name: str) -> bool:
    """Whether Spark's readers look at a file or folder of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _reached(root: str) -> bool:
    """Whether ``root`` is a folder of a store that tasks can list and open themselves."""
    try:
        store, base = fs.FileSystem.from_uri(root)
        return store.get_file_info(base).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def list_files(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """``path, modified, size`` of the files under ``root`` whose names have this ending, as Spark's reader names them.

    Tasks list the folders: two levels in steps whose folders are dealt anew, what is below them folder by folder, so the
    driver holds no name and a task those of one folder.  Only in a store that tasks do not reach does the driver list.
    """
    if not _reached(root):
        return small_files(spark, root, f"*{ending}").select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString()
    shape = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])  # a folder has no size

    def step(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]):
            store, base = fs.FileSystem.from_uri(root)
            base = base.rstrip("/")
            for b in batches:
                yield pa.RecordBatch.from_arrays(b.filter(pc.is_valid(b["size"])).columns, schema=shape)
                todo = b.filter(pc.is_null(b["size"]))["path"].to_pylist()
                while todo:
                    inside = [x for x in store.get_file_info(fs.FileSelector(base + todo.pop()[len(whole) :])) if _seen(x.base_name)]
                    rows = [(whole + x.path[len(base) :], x.mtime_ns // 1_000_000, x.size) for x in inside if x.type == fs.FileType.File and x.base_name.endswith(ending)]
                    folders = [whole + x.path[len(base) :] for x in inside if x.type == fs.FileType.Directory]
                    if deep:
                        todo += folders
                    else:
                        rows += [(f, None, None) for f in folders]
                    for lo in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), shape.types)], schema=shape)

        return run

    found, sql = spark.range(1).select(F.lit(whole).alias("path"), F.lit(None).cast("long").alias("modified"), F.lit(None).cast("long").alias("size")), "path string, modified long, size long"
    for deep in (False, False, True):
        found = found.repartition(many(spark)).mapInArrow(step(deep), sql)
    return found.withColumn("modified", F.timestamp_millis("modified"))


def _toml(files: DataFrame, schema: str, row, contents=None) -> DataFrame:
    """``row(path, content as TOML)`` of files (path, content); or of paths whose ``contents`` gives the second column."""
    names = [x.strip().rpartition(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        kinds = pa.schema([(n, _KINDS[x.strip().rpartition(" ")[2]]) for n, x in zip(names, schema.split(", "), strict=True)])
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                paths = part.column(0).to_pylist()
                texts = contents(paths) if contents else part.column(1).to_pylist()
                rows = [r for p, c in zip(paths, texts, strict=True) if (r := row(p, tomllib.loads(c.decode())))]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.mapInArrow(run, schema)


_KINDS = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _read(spark: SparkSession, root: str, ending: str, schema: str, row, where: str = "true") -> DataFrame:
    """``row`` of each file under ``root`` with this ending."""
    if not _reached(root):
        return _toml(small_files(spark, root, f"*{ending}").select("path", "content").filter(where), schema, row)
    return _opened(list_files(spark, root, ending).filter(where).select("path"), root, schema, row)


def _opened(paths: DataFrame, root: str, schema: str, row) -> DataFrame:
    """``row`` of the files (path) under ``root``, however many: each task opens those that it is dealt."""

    def contents(names: list[str]) -> Iterator[bytes]:
        store, base = fs.FileSystem.from_uri(root)
        for p in names:
            with store.open_input_stream(p[p.index(base) :]) as f:
                yield f.read()

    return _toml(paths.repartition(many(paths.sparkSession)), schema, row, contents)


def _chunk(path: str, t: dict) -> dict | None:
    if "/chunks/" not in path:
        return None
    c = t.get("chunk", {})
    return {"path": path, **{k: c.get(k) for k in ("id", "tradition", "text_name", "section", "translator", "source_url", "token_count")}, "body": t.get("content", {}).get("body"), "concepts": t.get("annotations", {}).get("concepts", []), "related_chunks": t.get("annotations", {}).get("related_chunks", [])}


def _text(path: str, t: dict) -> dict:
    folder = path.rstrip("/").split("/")
    flat = t.get("metadata", t.get("text", t))
    own = {k: flat.get(k) for k in ("tradition", "text_id", "text_name", "translator", "source_url", "sections_format", "chunk_count")}
    own["text_id"] = own["text_id"] or folder[-2]
    own["text_name"] = own["text_name"] or own["text_id"]
    return {"path": path, "tradition_dir": folder[-3], **own}


#: Chunk files among the files of a corpus.
CHUNKS = "path LIKE '%/chunks/%'"


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """A row for each ``<tradition>/<text>/chunks/<seq>.toml``; compact to Parquet once, then read that."""
    return _read(spark, root, ".toml", CHUNK, _chunk, CHUNKS)


def read_chunk_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The chunks of these files alone."""
    return _toml(small_files(spark, paths, "*.toml").select("path", "content"), CHUNK, _chunk)


def open_chunk_files(paths: DataFrame, root: str) -> DataFrame:
    """The chunks of the files (path) under ``root``, however many."""
    return _opened(paths, root, CHUNK, _chunk)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """A row for each ``metadata.toml``; the text's name defaults to its id."""
    return _read(spark, root, "metadata.toml", TEXT, _text, "path LIKE '%/metadata.toml'")


def read_config(text: str) -> dict:
    """A configuration file's content as a dictionary (driver side; a file a text)."""
    return tomllib.loads(text)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, page, text``: whole files; of ``id-01.txt, id-02.txt`` the pages of ``id``, else page 0."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    page = F.regexp_extract("name", r"-(\d+)\.txt$", 1)
    return t.select(F.regexp_replace("name", r"(-\d+)?\.txt$", "").alias("doc_id"), F.when(page != "", page.cast("int")).otherwise(0).alias("page"), "text")


def join_pages(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Pages in order as one text a document."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), separator).alias("text"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The actions of a JSON fixture, in order."""
    rows = spark.read.json(path, multiLine=True).select(F.posexplode("actions").alias("at", "a"))
    return rows.select("at", "a.*").orderBy("at")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The works of a JSON span plan."""
    return spark.read.json(path, multiLine=True).select(F.explode("works").alias("w")).select("w.*")


def downloader(url: Column, form: Column) -> Column:
    """The downloader for a source: by host first, then by format; null if none."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.when(host.rlike(r"(^|\.)gnosis\.org$"), "gnosis_org").when(form == "html_multi", "sacred_texts").when(form == "html", "generic_html").when(form == "sefaria_api", "sefaria")


#: An attribute's address in either kind of quotes or none, up to a fragment.
HREF = r"""(?i)\bhref\s*=\s*("[^"#]+|'[^'#]+|[^\s"'>#]+)"""


def scoped_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, link``: links of an index page into its own folder, resolved."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", "")
    rows = pages.select(url, base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("href"))
    rows = rows.withColumn("href", F.regexp_replace("href", "^[\"']", "")).distinct()
    root = F.regexp_extract("base", r"^[a-z]+://[^/]+", 0)
    link = F.when(F.col("href").rlike("^[a-z]+:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat("base", "href"))
    return rows.withColumn("link", link).filter(F.col("link").startswith(F.col("base")) & ~F.substring_index("link", "/", -1).contains("..") & ~F.col("href").startswith("..")).select(url, "link")


def bodies_for(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bodies of chunk ids; '' where there is none."""
    return ids.join(chunks.select("id", "body"), "id", "left").withColumn("body", F.coalesce("body", F.lit("")))
