"""Files of an archive: Markdown with front matter, JSON lines, binary sniffing, and sinks."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: front-matter keys that become columns
PROMOTED = ("subject", "from", "participants", "title", "speakers", "assignee", "status", "priority", "project", "space")

#: bytes of whole files that are handed on together
BATCH = 16 << 20


def _listed(infos, base: str):
    """Batches of (path, folder, modified) with paths below ``base``."""
    infos = [i for i in infos if i.type != pafs.FileType.NotFound]
    for k in range(0, len(infos), 10_000):
        some = infos[k : k + 10_000]
        columns = [i.path[len(base) :].lstrip("/") for i in some], [i.type == pafs.FileType.Directory for i in some], [i.mtime_ns and i.mtime_ns // 1000 for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["path", "folder", "modified"])


def markdown(spark: SparkSession, root: str, skip: tuple[str, ...] = (), namespace: str = "", globs: tuple[str, ...] = (), source: str = "") -> DataFrame:
    """(file_path, text, modified) of all Markdown files below root, empty ones too; hidden ones, skipped prefixes and names that match a glob are left out.

    ``source``: only files below this folder; ``namespace`` goes in front of the paths, so several roots can be united.
    Spark's own readers leave out files without a byte and names that begin with "_", and list a tree in the driver; so
    tasks list it, a folder of the first level each, and its files are dealt out to be read.
    """

    def first(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for _ in batches:
            yield from _listed(fs.get_file_info(pafs.FileSelector(base)), base)

    def deeper(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            yield batch
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if folder:
                    yield from _listed(fs.get_file_info(pafs.FileSelector(f"{base}/{path}", recursive=True)), base)

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("modified", pa.int64())])
        for batch in batches:
            rows, size = [], 0
            for path, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                    rows.append({"path": path, "content": f.read(), "modified": modified})
                size += len(rows[-1]["content"])
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = spark.range(1, numPartitions=1).mapInArrow(first, "path string, folder boolean, modified long").repartition(n).mapInArrow(deeper, "path string, folder boolean, modified long")
    found = found.where(~F.col("folder") & F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)\."))
    for prefix in skip:
        found = found.where(~F.col("path").startswith(prefix))
    name = F.substring_index("path", "/", -1)
    for glob in globs:
        found = found.where(~name.rlike("^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"))
    if source:
        found = found.where(F.col("path").startswith(source.rstrip("/") + "/"))
    rows = found.select("path", "modified").repartition(n).mapInArrow(read, "path string, content binary, modified long")
    return rows.select(F.concat(F.lit(namespace), "path").alias("file_path"), F.col("content").cast("string").alias("text"), F.timestamp_micros("modified").alias("modified"))


def roots(spark: SparkSession, namespaces: dict[str, str], excluded: dict[str, tuple[str, ...]] | None = None, **how) -> DataFrame:
    """The Markdown files of several roots as one table, each with its namespace in front and without its excluded folders."""
    out = None
    for root, namespace in namespaces.items():
        rows = markdown(spark, root, namespace=namespace, skip=tuple(f"{folder.rstrip('/')}/" for folder in (excluded or {}).get(root, ())), **how)
        out = rows if out is None else out.unionByName(rows)
    return out


def path_parts(path: Column, sources: dict[str, str], channels: dict[str, int]) -> dict[str, Column]:
    """source (by the first two parts, then the first), connector (the first) and channel (the part that the source has it in)."""
    known = F.create_map(*[F.lit(v) for pair in sources.items() for v in pair])
    parts = F.split(path, "/")
    source = F.coalesce(F.try_element_at(known, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))), F.try_element_at(known, F.get(parts, 0)), F.lit("default"))
    channel = F.lit(None).cast("string")
    for name, at in channels.items():
        channel = F.when(source == name, F.when(F.size(parts) > at, F.get(parts, at))).otherwise(channel)
    return {"source": source, "connector": F.get(parts, 0), "channel": channel}


def write_whole(rows: DataFrame, root: str) -> int:
    """Each (file_path, text) as a file below root, and how many: written under a temporary name of its attempt, then renamed, so no reader sees half a file."""

    def put(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(f"{base}/{path}.{attempt}.tmp") as f:
                    f.write((text or "").encode())
                fs.move(f"{base}/{path}.{attempt}.tmp", f"{base}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    pafs.FileSystem.from_uri(root)[0].create_dir(pafs.FileSystem.from_uri(root)[1])  # without rows, too
    return rows.select("file_path", "text").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0  # one row


def fits(path: Column) -> Column:
    """Whether a tree shows a file under just this path: visible names, none of them empty or over 255 bytes."""
    return F.coalesce(path.rlike(r"\A[^/.\x00][^/\x00]*(/[^/.\x00][^/\x00]*)*\z") & ~F.exists(F.split(path, "/"), lambda x: F.octet_length(x) > 255), F.lit(False))


def front_matter(text: Column) -> Column:
    """The leading block as a map of raw strings."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\w-]+:\s*", ""), "^[\"']|[\"']$", "")).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    # of repeated keys the last one counts
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---(\n|\z)", "")


def documents(rows: DataFrame) -> DataFrame:
    """Files as documents: front matter parsed, the usual keys promoted where they are stated."""
    out = rows.withColumn("frontmatter", front_matter(F.col("text"))).withColumn("body", body(F.col("text"))).withColumn("source", F.split("file_path", "/")[0])
    return out.withColumns({k: F.col("frontmatter")[k] for k in PROMOTED})


def parts(text: Column) -> Column:
    """The documents of a file that holds several front-matter blocks."""
    return F.split(text, r"\n(?=---\n)")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; malformed ones are skipped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def is_binary(content: Column) -> Column:
    """A NUL byte, or over 30 % of the first 8192 bytes neither printable ASCII nor one of \\b \\t \\n \\f \\r."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")  # a character a byte
    odd = F.length(F.regexp_replace(head, r"[\x20-\x7e\x08\t\n\f\r]+", ""))
    return F.when(F.length(head) == 0, False).otherwise(head.rlike(r"\x00") | (odd / F.length(head) > 0.3))


def by_day(rows: DataFrame, path: str, at: str) -> None:
    """A sink with one folder a month and day; days written again are replaced whole."""
    day = rows.withColumn("month", F.date_format(at, "yyyy-MM")).withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "day").parquet(path)
