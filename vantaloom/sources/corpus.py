"""Corpora from files: documents, Python sources, key=value files, statistics, results."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantaloom.sources.runtime import ship_package, stage


def _suffix(path):
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


HIDDEN_MB = 256
TASK_MB, TASK_FILES, BATCH_MB = 64, 10_000, 8  # what a task reads, and hands on at a time


def underscored(spark: SparkSession, folders: list[str], deepest: int = 32) -> tuple[list[tuple[str, int]], list[str]]:
    """Files (with sizes) and folders whose names begin with ``_``, which Spark's listing hides; byte-code folders are left out.

    Tasks list the folders, level by level, and only hidden names come to the driver; a store that
    pyarrow doesn't know is listed by the driver.
    """
    if not _known([_uri(f) for f in folders]):
        return _globbed(spark, folders, deepest)
    ship_package(spark)
    found = stage(_listed(spark.createDataFrame([(_uri(f),) for f in folders], "folder string")), "level")
    levels = [found]
    for _ in range(deepest):
        inner = found.where("size < 0").select("path")
        n = inner.count()
        if not n:
            break
        tasks = max(1, min(n // 16, 8 * spark.sparkContext.defaultParallelism))
        found = stage(_listed(inner.withColumnRenamed("path", "folder").repartition(tasks)), "level")
        levels.append(found)
    hidden = reduce(DataFrame.unionByName, levels).where("hidden").distinct().select("path", "size").collect()
    return sorted((r["path"], r["size"]) for r in hidden if r["size"] >= 0), sorted(r["path"] for r in hidden if r["size"] < 0)


def _uri(folder: str) -> str:
    return folder.rstrip("/") if ":/" in folder else "file://" + os.path.abspath(folder)


def _known(uris: list[str]) -> bool:
    """Whether pyarrow has the stores."""
    try:
        for uri in uris:
            fs.FileSystem.from_uri(quote(uri, safe=":/"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _roots(spark: SparkSession, folders: list[str]) -> list[str] | None:
    """The folders' URIs; None where one is no folder or a pattern, or its store isn't known, which is left to Spark."""
    jvm, out = spark.sparkContext._jvm, []
    for folder in folders:
        if set("{}[]*?\\") & set(folder):
            return None
        at = jvm.org.apache.hadoop.fs.Path(folder)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(at) or not store.getFileStatus(at).isDirectory():
            return None
        own = store.makeQualified(at).toString()
        out.append("file://" + own[5:] if own.startswith("file:/") and not own.startswith("file://") else own)
    return out if _known(out) else None


_LEVEL = "root int, at string, path string, size long, seen boolean, walked boolean"


def _walked(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, at, path, size) of the files in the folders, listed by tasks level by level: those that Spark would list, and
    those below names that begin with ``_``, byte-code folders left out (as ``underscored`` has them)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = [fs.FileSystem.from_uri(quote(uri, safe=":/"))[0] for uri in roots]
        for batch in batches:
            for root, at, path, _, seen, walked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for entry in stores[root].get_file_info(fs.FileSelector(at, allow_not_found=True)):
                    name, own = entry.base_name, f"{path.rstrip('/')}/{entry.base_name}"
                    under = walked and name.startswith("_") and "__pycache__" not in name
                    hides = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
                    if entry.type == fs.FileType.Directory:
                        shows = seen and (not hides or name.startswith(("_metadata", "_common_metadata")))
                        further = walked and "__pycache__" not in name
                        if shows or under or further:
                            rows.append((root, entry.path, own, -1, shows or under, further))
                    elif entry.type == fs.FileType.File and (under or (seen and not hides and entry.size > 0)):  # Spark skips empty files
                        rows.append((root, entry.path, own, entry.size, True, False))
                for a in range(0, len(rows), TASK_FILES):
                    columns = zip(*rows[a : a + TASK_FILES], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=["root", "at", "path", "size", "seen", "walked"])

    begin = [fs.FileSystem.from_uri(quote(uri, safe=":/"))[1] for uri in roots]
    inner = spark.createDataFrame([(i, at, f"file:{at}" if roots[i].startswith("file:") else roots[i], -1, True, True) for i, at in enumerate(begin)], _LEVEL)
    n, levels = len(roots), []
    while n:
        tasks = max(1, min(n // 16, 8 * spark.sparkContext.defaultParallelism))
        levels.append(stage(inner.repartition(tasks).mapInArrow(run, _LEVEL), "level"))
        inner = levels[-1].where("size < 0")
        n = inner.count()
    found = reduce(DataFrame.unionByName, levels).where("size >= 0").select("root", "at", "path", "size")
    return found.dropDuplicates(["path"]) if len(roots) > 1 else found  # they may lie in one another


def _read(spark: SparkSession, roots: list[str], files: DataFrame) -> DataFrame:
    """(path, length, content) of walked files in order of path, read by tasks that have some ten thousand files or tens of MB each."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // TASK_FILES), -(-size // (TASK_MB << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = [fs.FileSystem.from_uri(quote(uri, safe=":/"))[0] for uri in roots]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])

        for batch in batches:
            for root, at, path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with stores[root].open_input_stream(at, compression=None) as stream:
                    rows.append((path, length, stream.read()))
                held += length
                if held > BATCH_MB << 20:
                    yield flush()
                    rows, held = [], 0
        yield flush()

    # Paths are sorted before the files are read, so no content is shuffled.
    return files.repartitionByRange(int(tasks), "path").sortWithinPartitions("path").mapInArrow(run, "path string, length long, content binary")


def _listed(folders: DataFrame) -> DataFrame:
    """(path, size, hidden): the folders inside each ``folder``, of size -1, and its files whose names begin with ``_``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                scheme = uri[: uri.index(":")]
                store, path = fs.FileSystem.from_uri(quote(uri, safe=":/"))
                rows = []
                for entry in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                    name, is_folder = entry.base_name, entry.type == fs.FileType.Directory
                    if "__pycache__" in name or not (is_folder or name.startswith("_")):
                        continue
                    own = f"{scheme}:{entry.path}" if scheme == "file" else f"{uri}/{name}"
                    rows.append((own, -1 if is_folder else entry.size, name.startswith("_")))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.bool_()))], names=["path", "size", "hidden"])

    return folders.mapInArrow(run, "path string, size long, hidden boolean")


def _globbed(spark: SparkSession, folders: list[str], deepest: int) -> tuple[list[tuple[str, int]], list[str]]:
    jvm, files, inner = spark.sparkContext._jvm, {}, []
    for folder in folders:
        base = folder.rstrip("/")
        store = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for depth in range(deepest):
            level = base + "/*" * depth
            if depth and not store.globStatus(jvm.org.apache.hadoop.fs.Path(level)):
                break
            for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(level + "/_*")) or []:
                path = status.getPath().toString()
                if "__pycache__" in path:
                    continue
                if status.isDirectory():
                    inner.append(path)
                else:
                    files[path] = status.getLen()
    return sorted(files.items()), inner


def _files(spark: SparkSession, folders: list[str], contents: bool = True, wanted: Column | None = None) -> DataFrame:
    """(path, length, content) of all files, or of those whose path is ``wanted``; with contents in order of path. Tasks list and read them, so the driver holds none."""
    wanted = F.lit(True) if wanted is None else wanted
    roots = _roots(spark, folders)
    if roots is None:
        found = _through_spark(spark, folders, contents).where(wanted)
        return stage(found, "files").sort("path") if contents else found  # a sort reads its rows twice
    found = _walked(spark, roots).where(wanted)
    return _read(spark, roots, found) if contents else found.select("path", F.col("size").alias("length"))


def _through_spark(spark: SparkSession, folders: list[str], contents: bool = True) -> DataFrame:
    """The same by Spark's own listing, which the driver holds. Those that Spark hides (``__init__.py``) are few and small, and come through the driver."""
    hidden, inner = underscored(spark, folders)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([*folders, *inner])
    if len(folders) + len(inner) > 1:  # they may lie in one another
        raw = raw.dropDuplicates(["path"])
    if not hidden:
        return raw.select("path", "length", "content") if contents else raw.select("path", "length")
    if not contents:
        return raw.select("path", "length").unionByName(spark.createDataFrame(hidden, "path string, length long"))
    if sum(n for _, n in hidden) > HIDDEN_MB * 1e6:
        raise ValueError(f"files with names that begin with _ hold more than {HIDDEN_MB} MB; give them other names")
    jvm, rows = spark.sparkContext._jvm, []
    for path, n in hidden:
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
        rows.append((path, n, bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
    return raw.select("path", "length", "content").unionByName(spark.createDataFrame(rows, "path string, length long, content binary"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Each row (folder, name, text) as a file of its own, written by the tasks; a task that runs again writes the same files."""
    ship_package(docs.sparkSession)
    root = _uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(quote(root, safe=":/"))
        made = set()
        for batch in batches:
            for folder, name, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if folder not in made:
                    store.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{folder}/{name}", compression=None) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    docs.select("folder", "name", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def load_documents(spark: SparkSession, folders: list[str], extensions: tuple[str, ...] = (".md", ".py", ".txt"), skip: tuple[str, ...] = ("input.txt",)) -> DataFrame:
    """(path, text) of text files under the folders; files that are no UTF-8 are left out.

    Order is by path, so that ids given later do not depend on the listing.
    """
    name = F.substring_index("path", "/", -1)
    kept = _files(spark, folders, wanted=_suffix(F.col("path")).isin(list(extensions)) & ~F.contains("path", F.lit("__pycache__")) & ~name.isin(list(skip)))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return kept.select("path", text.alias("text")).where("text is not null")


def load_python(spark: SparkSession, folders: list[str], root: str, max_files: int | None = None) -> DataFrame:
    """(path relative to ``root``, text) of Python files, each once, the first ``max_files`` by path."""
    files = load_documents(spark, folders, (".py",), ()).dropDuplicates(["path"])
    if max_files is not None:
        files = files.orderBy("path").limit(max_files)
    at = F.call_function("instr", F.col("path"), F.lit(root.rstrip("/") + "/"))
    return files.select(F.when(at > 0, F.substring("path", at + len(root.rstrip("/")) + 1, F.length("path"))).otherwise(F.col("path")).alias("path"), "text")


def folder_statistics(spark: SparkSession, root: str, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Files and bytes by folder, and the largest files of the root; contents are not read."""
    meta = _files(spark, [root], False)
    rel = F.regexp_replace("path", r"^file:(//)?", "")
    own = meta.withColumn("rel", F.substring(rel, F.lit(len(root.rstrip("/")) + 2), F.length(rel)))
    folder = F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1)).otherwise(F.lit("."))
    by_folder = own.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    largest = own.where(~F.contains("rel", F.lit("/"))).orderBy(F.desc("length"), "rel").limit(top).select("rel", "length")
    return by_folder, largest


def parse_env(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, value) of KEY=VALUE lines; blank lines and comments go, the first ``=`` divides, the first key stays."""
    line = F.trim(F.col(value))
    kept = lines.withColumn("__n", F.monotonically_increasing_id()).where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")))
    at = F.call_function("instr", line, F.lit("="))
    pairs = kept.select("__n", F.trim(F.substring(line, F.lit(1), at - 1)).alias("key"), F.trim(F.substring(line, at + 1, F.length(line))).alias("value"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("__n"))
    return pairs.withColumn("__r", first).where("__r = 1").select("key", "value")


def write_results(df: DataFrame, path: str) -> None:
    """Results as JSON lines; nested columns stay nested."""
    df.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """A cache table (key, description), or None where there is none; files of it that can't be read count as empty."""
    try:
        return spark.read.schema("key string, description string").option("ignoreCorruptFiles", "true").parquet(path)
    except Exception:  # a missing cache is an empty one
        return None


def append_cache(fresh: DataFrame, path: str) -> None:
    fresh.write.mode("append").parquet(path)
