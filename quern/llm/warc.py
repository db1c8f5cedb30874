"""WARC archives: a deterministic sharded writer, and a reader.

Rows are range-sorted by (page_id, digest) into shards of about ``shard_bytes``,
whose bounds are byte quantiles of sampled keys; each shard is one task and rolls to its next file once one holds ``roll_bytes`` compressed.  Headers
and digests are made anew from the payload, gzip members carry no time, and
record ids derive from id and digest, so the same rows always give the same
files.  A file is written under a temporary name of its task attempt and moved
to its own when it is complete; the manifest, which Spark commits last, lists
the files that count.  A retried task writes the same files again.

Of records with equal payloads of ``least`` bytes or more, that of the smallest
page_id holds the payload; the others are revisits that name it.

Cases: a null payload is the empty one; null ids sort first, and among equal
payloads without any id all are responses; rows that repeat the smallest id are
responses too; control characters and spaces in URLs are percent-encoded, a
null URL is left out; an empty table gives no file.  Rows equal in id and
payload stay in one shard.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLED = 20  # keys a shard that bounds are drawn from
MANIFEST = "file string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def order_key(page_id: Column, digest: Column) -> Column:
    """Text that sorts as (page_id, digest), null ids first; the digest counts with its first 16 characters."""
    flipped = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(page_id.isNull(), "0").otherwise(F.concat(F.lit("1"), flipped)), F.substring(digest, 1, 16))


def place_of(key: Column, bounds: list[str], step: int = 256) -> Column:
    """How many of the sorted bounds are not beyond the key, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    up_to = lambda among: F.size(F.filter(among, lambda b: b <= key))
    coarse = up_to(F.lit(bounds[step - 1 :: step]).cast("array<string>")) if len(bounds) >= step else F.lit(0)
    return coarse * step + up_to(F.slice(F.lit(bounds), coarse * step + 1, F.lit(step)))


class Roller:
    """Files of one shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, attempt: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.attempt, self.at, self.out, self.done = shard, roll_bytes, attempt, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.shard:06d}-{self.at:04d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{self.attempt}.tmp"
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
        packed = gzip.compress(data, compresslevel=6, mtime=0)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.at, self.out = self.at + 1, None


def _written(folder: str, roll_bytes: int, date: str):
    def run(batches):
        attempt, roller, told = TaskContext.get().taskAttemptId(), None, (None, None, None)
        done: list[tuple] = []
        for batch in batches:
            for shard, page_id, digest, kind, refers_to, url, html in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = Roller(folder, shard, roll_bytes, attempt)
                if kind == 0:  # what follows with this id and digest is a revisit
                    told = (page_id, digest, refers_to)
                else:
                    roller.add(record(page_id, url, html or b"", digest, told[2] if told[:2] == (page_id, digest) else None, date))
        if roller is not None:
            roller.close()
            done += roller.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes", "sha256"])

    return run


def write(pages: DataFrame, folder: str, least: int = 100, shard_bytes: int = 32 << 20, roll_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of pages (page_id, url, html, ...) in a folder that all machines reach; returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sized = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n"))
    total, count = sized.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    # bounds between shards: byte quantiles over keys (id, digest) of least hash, SAMPLED a shard, so they depend on the rows alone
    key = order_key(F.col("page_id"), F.col("digest"))
    every = max(1, count // (SAMPLED * shards + 20_000))
    drawn = sized.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(every)) == 0).groupBy(key.alias("key")).agg(F.sum("n").alias("n")).orderBy("key").collect() if shards > 1 else []
    upto = np.cumsum([r["n"] for r in drawn])
    bounds = sorted({drawn[int(np.searchsorted(upto, upto[-1] * i / shards))]["key"] for i in range(1, shards)}) if drawn else []
    shards, shard = len(bounds) + 1, place_of(key, bounds)
    large = sized.where(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 and refers_to is not null").select("digest", "refers_to")
    told = large.select("page_id", "digest").join(first, "digest").where("not page_id <=> refers_to").distinct()
    both = told.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html")).union(
        rows.select("page_id", F.sha2("html", 256), F.lit(1), F.lit(None).cast("long"), "url", F.col("html").cast("binary"))
    )
    both = both.select(shard.alias("shard"), "*").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    made, root = pafs.FileSystem.from_uri(folder)
    made.create_dir(root)
    both.mapInArrow(_written(folder, roll_bytes, date), MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def records(stream):
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield head, block


def _read(folder: str, payload: bool):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, count, whole in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    if hashlib.file_digest(f, "sha256").hexdigest() != whole:
                        raise ValueError(f"{name} is not the file of the manifest")
                out, n = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f, gzip.GzipFile(fileobj=f) as g:
                    for head, block in records(g):
                        n += 1
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["warc-block-digest"]:
                            raise ValueError(f"a block of {name} does not match its digest")
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"a payload of {name} does not match its digest")
                        page, to = head.get("x-page-id"), head.get("x-refers-to-page")
                        out.append((page and int(page), head.get("warc-target-uri"), size, digest, head["warc-type"], to and int(to), *([body.decode() if to is None else None] if payload else [])))
                        if len(out) == 500:
                            yield _batch(out, payload)
                            out = []
                if n != count:
                    raise ValueError(f"{name} has {n} records; the manifest says {count}")
                if out:
                    yield _batch(out, payload)

    return run


def _batch(out: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string()] if payload else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each record of the files in the manifest; every digest is checked."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload string" if payload else "")
    files = max(1, manifest.count())  # so many tasks: a file can be large
    return manifest.repartition(files, "file").mapInArrow(_read(folder, payload), shape)
