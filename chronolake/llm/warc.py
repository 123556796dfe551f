"""WARC archives: a deterministic sharded writer with manifests, and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import lean
from .regions import NULL_ID
from .store import shared_folder

#: Bits of the keys that the first count tells apart, and each later one in cells that hold too much.
FIRST_BITS, MORE_BITS = 10, 6
#: Files are closed once they have this many compressed bytes.
ROLL_BYTES = 64 << 20
#: All records carry one date, so that archives that are written again are the same byte for byte.
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, records long, bytes long, sha1 string, first_id long, last_id long"
STAGED = f"attempt string, {MANIFEST}"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{payload_digest}')}>"


def _field(value: str | None) -> str:
    """A header's value in one line of visible characters."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, payload_digest: str, first: int | None, revisit: bool) -> bytes:
    """One record, compressed as a member of its own. Of a revisit only the HTTP header is stored."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, payload_digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_field(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first, payload_digest)}", f"X-Refers-To-Page-Id: {'' if first is None else first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _info(name: str) -> bytes:
    body = b"software: chronolake\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(0, name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + body + b"\r\n\r\n") + pack.flush()


class _Roller:
    """Files of a task's shards, each under a name of this attempt: a file gets its own name when the
    manifest that lists the attempt is saved, so a lost attempt or a twin of one leaves no trace."""

    def __init__(self, folder: str, attempt: str, roll: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.attempt, self.roll = attempt, roll
        self.shard, self.number, self.out, self.done = None, 0, None, []

    def add(self, shard: int, page_id: int | None, raw: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.number:05d}.warc.gz"
            self.store.create_dir(f"{self.folder}/_attempts", recursive=True)
            self.out, self.hash = self.store.open_output_stream(f"{self.folder}/_attempts/{self.attempt}-{self.name}", compression=None), hashlib.sha1()
            self.bytes = self.records = 0
            self.first = page_id
            self._write(_info(self.name))
        self._write(raw)
        self.records += 1
        self.last = page_id
        if self.bytes >= self.roll:
            self.close()

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.hash.update(raw)
        self.bytes += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.attempt}-{self.name}", self.name, self.shard, self.records, self.bytes, self.hash.hexdigest(), self.first, self.last))
            self.out, self.number = None, self.number + 1


def shard_bounds(keys: DataFrame, shards: int) -> list[int]:
    """The first key of each shard but the first, so that shards hold about as many rows. keys: key (long).

    Exact counts decide, so equal tables have equal bounds however they are partitioned. Keys are counted
    by their leading bits; cells that hold more than an eighth of a shard are counted again by more bits.
    The driver gets at most 8 * shards * 2**MORE_BITS counts at a time. A key is never divided.
    """
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if not total or low == high:
        return []
    shift = max(0, (high - low).bit_length() - FIRST_BITS)
    share, cells, todo = total / (8 * shards), {}, keys
    while True:
        got = {r.cell << shift: r.n for r in todo.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
        heavy = [k for k, n in got.items() if n > share] if shift else []
        cells |= {k: n for k, n in got.items() if k not in set(heavy)}
        if not heavy:
            break
        todo = todo.filter(F.shiftright("key", shift).isin([k >> shift for k in heavy]))
        shift = max(0, shift - MORE_BITS)
    bounds, before = [], 0
    for k in sorted(cells):
        if before and before * shards >= (len(bounds) + 1) * total:
            bounds.append(k)
        while before * shards >= (len(bounds) + 1) * total and len(bounds) < shards - 1:
            bounds.append(k)  # a heavy key fills several shards: those between stay empty
        before += cells[k]
    return bounds[: shards - 1]


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest, which is saved when
    all files are in place: readers take only files that it names.

    Records are sorted by page_id into shards by ranges of shard_bounds, a shard's files rolled by compressed
    size, so equal tables and numbers of shards give equal files. Of rows with equal payloads of least_bytes
    or more, that with the smallest page_id is a response, all others revisits of it; rows that repeat this
    page_id are responses as well. A null html is an empty payload; a null page_id counts as the smallest;
    an empty table gives an empty manifest. Rows that share a page_id share a shard.

    Files are written under names of their attempt, which a first manifest lists; they are renamed once
    Spark has committed that, and the manifest proper is saved last.
    """
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    first = rows.groupBy("digest").agg(F.min("key").alias("first"))
    bounds = shard_bounds(rows.select("key"), shards)
    shard = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda x: x <= F.col("key"))) if bounds else F.lit(0)
    # Pages go to their shard once, and what is known about them comes along in rows of its own.
    facts = rows.select("key", "digest", "size").distinct().join(first, "digest")
    facts = facts.select("key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "size", "first")
    both = facts.unionByName(rows.select("key", "digest", F.lit(1).alias("kind"), "url", "html", "size", F.lit(None).cast("long").alias("first")))

    def write(batches):
        context = TaskContext.get()
        roller = _Roller(folder, f"{context.stageId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", roll_bytes)
        lead = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    lead = r["first"]
                    continue
                revisit = r["key"] > lead and r["size"] >= least_bytes
                page, first_page = (None if x == NULL_ID else x for x in (r["key"], lead))
                sha1 = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                roller.add(r["shard"], page, make_record(page, r["url"], r["html"].encode(), r["size"], sha1, first_page, revisit))
        roller.close()
        yield _manifest_rows(roller.done)

    ordered = both.withColumn("shard", shard).repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "digest", "kind", "url")
    ordered.mapInArrow(lean(write), STAGED).write.parquet(f"{folder}/_staged")

    def publish(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                attempt = f"{path}/_attempts/{r['attempt']}"
                if store.get_file_info(attempt).type == fs.FileType.File:
                    store.move(attempt, f"{path}/{r['file']}")
                if store.get_file_info(f"{path}/{r['file']}").size != r["bytes"]:
                    raise ValueError(f"{r['file']} is not as its manifest says")
            yield batch.drop_columns(["attempt"])

    staged = spark.read.schema(STAGED).parquet(f"{folder}/_staged")
    staged.mapInArrow(lean(publish), MANIFEST).write.parquet(f"{folder}/manifest")
    store, path = fs.FileSystem.from_uri(folder)
    for name in ("_attempts", "_staged"):
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{name}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _manifest_rows(done: list[tuple]) -> pa.RecordBatch:
    names = ["attempt", "file", "shard", "records", "bytes", "sha1", "first_id", "last_id"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [[]] * len(names), kinds)], names=names)


def read_records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of compressed members; one record is held at a time."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = stream.read(size)
                if not rest:
                    if parts:
                        raise ValueError("a record is cut off")
                    return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        if len(body) != length + 4:
            raise ValueError("a block's length is not as its header says")
        yield fields, body[:length]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of all files of a manifest. Block digests are verified, and payload digests of
    responses; a wrong one raises ValueError. payload is null for revisits and if payloads is off."""

    def read(batches):
        store, path = fs.FileSystem.from_uri(folder)
        number = lambda s: int(s) if s else None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in read_records(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:])[b"content-length"])
                        if digest(block) != fields["warc-block-digest"].removeprefix("sha1:") or kind == "response" and (digest(payload) != sha1 or len(payload) != size):
                            raise ValueError(f"{name}: wrong digest in {fields['warc-record-id']}")
                        rows.append((number(fields["x-page-id"]), fields["warc-target-uri"], size, sha1, kind, number(fields.get("x-refers-to-page-id")), payload if payloads and kind == "response" else None))
                        held += len(rows[-1][-1] or b"") + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = manifest.select("file")
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(lean(read), RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/chronolake/warc-{uuid.uuid4().hex}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder, payloads=False).drop("payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with d as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from d),
b as (select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 10 * k + 1, 10))::bigint // (32::bigint ** (7 - j))::bigint % 32)::int + 1, 1), '' order by k, j) as digest
      from f, range(0, 4) t(k), range(0, 8) u(j) group by page_id)
select f.page_id, strlen(f.html)::bigint as payload_bytes, b.digest as payload_digest,
  case when f.page_id = first then 'response' else 'revisit' end as record_type, case when f.page_id <> first then first end as refers_to
from f join b using (page_id)
"""
