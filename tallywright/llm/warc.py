"""WARC archives: pages are written as records, archives compressed as one gzip stream are normalised to one member a record.

An archive that is one gzip stream can only be read from its start. `normalise` inflates such a stream once, cuts it into records as
they come, writes each as a gzip member of its own into a new archive, and one line of offset, length and the record's main headers
into a sidecar index beside it; `read_records` then reads any record by its offset alone. Neither holds more than a piece of a stream
at a time, so neither archives nor records need fit in memory. An archive is the unit of work: its stream can't be entered in the middle.

Archives, sidecars and manifests lie in the shared folder. A task writes files under names of its own, and only the names that reach
the stored manifest count, so what a lost or doubled task has left behind is never read.

A record that repeats an equal payload of at least LEAST bytes is a `revisit`: it keeps its HTTP header (with the length of the full
payload) and the payload's digest, and names the record that has the payload. The least identifier among equal payloads has it.

Defined cases: a null payload is empty; a null identifier gives an identifier without number, is read back as null and has no payload of
its own where an equal one has a number; rows with the same identifier and payload are records each, all of them responses if theirs is
the least; a null address is left out; control characters and spaces in it are percent-encoded; an empty table gives no archive and an
empty result; extra columns are ignored. A stream that ends early or holds no record where one should begin gives the records
before the break, and its manifest row says what was wrong; what was written of the broken record stands after the last indexed member.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, shared_folder, stored

LEAST = 100
ARCHIVE = 1 << 26
PIECE = 1 << 18
PREFIX = "urn:page:"
GZIP = 16 + zlib.MAX_WBITS
HEADER_LIMIT = 1 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string, refers_to string"
RECORD = "archive string, offset long, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, intact boolean, payload binary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path)


# --- records ---------------------------------------------------------------

def head(kind: str, record_id: str, date: str, length: int, **more: str | None) -> bytes:
    """The header of a record; `more` holds further fields, underscores for hyphens, None for none."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    fields += [(k.replace("_", "-"), v) for k, v in more.items() if v is not None]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {length}\r\n\r\n").encode()


def record(number: str, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: str | None, date: str) -> tuple[bytes, bytes]:
    """Header and block of a page: a response with its payload, or a revisit of `refers_to` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    told = {"WARC_Target_URI": url and quote(url, safe="%/:=&?~#+!$,;'@()*[]"), "WARC_Payload_Digest": "sha256:" + digest, "Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        told |= {"WARC_Refers_To": f"<{PREFIX}{refers_to}>", "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return head("response" if refers_to is None else "revisit", PREFIX + number, date, len(block), **told), block


def fields_of(header: bytes) -> dict[str, str]:
    """The fields of a record or HTTP header, names in lower case."""
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


class Broken(ValueError):
    """A stream that is no archive from some place on."""


class Inflated:
    """Bytes of a gzip stream (one member or many), read forward in pieces."""

    def __init__(self, source, piece: int = PIECE) -> None:
        self.source, self.piece, self.held, self.zip, self.begun = source, piece, b"", zlib.decompressobj(GZIP), False

    def more(self) -> bool:
        """Take in another piece; False at the end of the stream."""
        rest = self.zip.unconsumed_tail
        if self.zip.eof:
            rest, self.zip, self.begun = self.zip.unused_data, zlib.decompressobj(GZIP), False
        raw = rest or self.source.read(self.piece)
        if not raw and not self.begun:
            return False
        try:
            new = self.zip.decompress(raw, self.piece)
        except zlib.error as wrong:
            raise Broken(f"not a gzip stream: {wrong}") from wrong
        if not raw and not new and not self.zip.eof:
            raise Broken("the stream ends early")
        self.held, self.begun = self.held + new, True
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with `mark`; None where only line ends are left."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > HEADER_LIMIT:
                raise Broken("no record begins here")
            if not self.more():
                if self.held.strip():
                    raise Broken("the stream ends early")
                return None
        out, self.held = self.held[:at + len(mark)], self.held[at + len(mark):]
        return out

    def take(self, length: int) -> Iterator[bytes]:
        """The next `length` bytes, in pieces."""
        while length:
            if not self.held and not self.more():
                raise Broken("the stream ends early")
            out, self.held = self.held[:length], self.held[length:]
            length -= len(out)
            yield out


def records_in(stream: Inflated) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """Header, its fields and block length of each record; the caller takes the block before going on."""
    while (header := stream.until(b"\r\n\r\n")) is not None:
        header = header.lstrip(b"\r\n")
        fields = fields_of(header)
        if not header.startswith(b"WARC/") or not fields.get("content-length", "").isdecimal():
            raise Broken("no record begins here")
        yield header, fields, int(fields["content-length"])
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise Broken("a block is longer than its header says")


# --- writing ---------------------------------------------------------------

def with_firsts(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, refers_to): what each page's record holds, and the page it revisits.

    The table of repeated payloads is stored first, so Spark knows its size: it broadcasts a small one and shuffles by digest beyond
    its own bound, where adaptive execution splits a digest that very many pages share.
    """
    facts = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    facts = facts.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    again = facts.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = facts.join(stored(again.select("digest", "first_id"), "payloads"), "digest", "left")
    return told.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def write_archives(told: DataFrame, folder: str, archive: int = ARCHIVE, date: str | None = None) -> DataFrame:
    """Rows of `with_firsts` as archives in `folder`, each one gzip stream of about `archive` bytes: (archive, records), stored."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = place(folder)
        out = None

        def close() -> pa.RecordBatch:
            out.write(packed.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])

        for b in batches:
            for number, url, payload, n_bytes, digest, refers_to in zip(*b.columns, strict=True):
                if out is None:
                    name, packed, n, filled = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, wbits=GZIP), 0, 0
                    out = system.open_output_stream(f"{at}/{name}", compression=None)
                    block = b"format: WARC File Format 1.1\r\n"
                    out.write(packed.compress(head("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, len(block), Content_Type="application/warc-fields") + block + b"\r\n\r\n"))
                top, block = record(number.as_py() or "", url.as_py(), payload.as_py(), n_bytes.as_py(), digest.as_py(), refers_to.as_py(), date)
                for part in (top, block, b"\r\n\r\n"):
                    out.write(packed.compress(part))
                n, filled = n + 1, filled + len(block)
                if filled >= archive:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    system, at = place(folder)
    system.create_dir(at, recursive=True)
    rows = told.select(F.col("page_id").cast("string"), "url", "payload", "n_bytes", "digest", F.col("refers_to").cast("string"))
    return stored(by_arrow(rows, run, "archive string, records long"), "archives")


# --- normalising -----------------------------------------------------------

def rewritten(source, out, index, name: str) -> Iterator[int]:
    """Write every record of the stream `source` as a member of `out` and its line to `index`; yields once a record."""
    offset, stream = 0, Inflated(source)
    for header, fields, length in records_in(stream):
        packed, size = zlib.compressobj(6, wbits=GZIP), 0
        for part in (header,), stream.take(length), (b"\r\n\r\n",):
            for piece in part:
                size += out.write(packed.compress(piece))
        size += out.write(packed.flush())
        bare = lambda v: v and v.strip("<>")
        line = {"archive": name, "offset": offset, "length": size, "record_id": bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
                "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None, "refers_to": bare(fields.get("warc-refers-to"))}
        index.write(json.dumps(line).encode() + b"\n")
        offset += size
        yield offset


def normalise(archives: DataFrame, folder: str, into: str) -> DataFrame:
    """Archives (column archive, names in `folder`) rewritten in `into`: (source, archive, records, bytes, error), stored.

    The new archive has one member a record, and beside it lies its sidecar `.idx`: one line of JSON a record. `error` is null, or says
    why the rest of the source could not be read.
    """
    spark = archives.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, at), (target, to) = place(folder), place(into)
        for b in batches:
            for source in b.column(0).to_pylist():
                name, n, size, error = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
                with system.open_input_stream(f"{at}/{source}", compression=None) as raw, target.open_output_stream(f"{to}/{name}", compression=None) as out, \
                        target.open_output_stream(f"{to}/{name}.idx", compression=None) as index:
                    try:
                        for size in rewritten(raw, out, index, name):
                            n += 1
                    except Broken as wrong:
                        error = str(wrong)
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([error], pa.string())],
                                                 ["source", "archive", "records", "bytes", "error"])

    target, to = place(into)
    target.create_dir(to, recursive=True)
    # a number of its own: adaptive execution would put a few hundred names into one task
    dealt = archives.select("archive").repartition(tasks(spark), "archive")
    return stored(by_arrow(dealt, run, "source string, archive string, records long, bytes long, error string"), "normalised")


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def offset_index(normalised: DataFrame, into: str) -> DataFrame:
    """The sidecars of the archives in a manifest, as a table."""
    spark = normalised.sparkSession
    lines = spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(into)
    return lines.join(normalised.select("archive"), "archive", "left_semi")


# --- reading ---------------------------------------------------------------

def parsed(member: bytes) -> tuple[dict[str, str], int, str, bool, bytes | None]:
    """Fields, payload length, digest, whether the payload has the digest named, and the payload (None in a revisit) of one member."""
    header, _, rest = zlib.decompress(member, GZIP).partition(b"\r\n\r\n")
    fields = fields_of(header)
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    named, full = fields["warc-payload-digest"].rpartition(":")[2], int(fields_of(http)["content-length"])
    if fields["warc-type"] == "revisit":
        return fields, full, named, True, None
    digest = hashlib.sha256(payload).hexdigest()
    return fields, len(payload), digest, digest == named and len(payload) == full, payload


def read_records(index: DataFrame, into: str) -> DataFrame:
    """The records at the offsets of index rows, whichever and however few, each inflated from its own member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, at), name, source = place(into), None, None
        for b in batches:
            done: list[tuple] = []
            held = 0
            for archive, offset, length, record_id, kind, uri, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, system.open_input_file(f"{at}/{archive}")
                source.seek(offset)
                _, n_bytes, digest, intact, payload = parsed(source.read(length))
                done.append((archive, offset, record_id, kind, uri, n_bytes, digest, refers_to, intact, payload))
                held += n_bytes
                if held > PIECE << 6:
                    yield batch(done)
                    done, held = [], 0
            yield batch(done)
        if source is not None:
            source.close()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], re.findall(r"(\w+) \w+(?:,|$)", RECORD))

    wanted = index.where(F.col("record_type").isin("response", "revisit")).select("archive", "offset", "length", "record_id", "record_type", "target_uri", "refers_to")
    return by_arrow(wanted.repartition(tasks(index.sparkSession), "archive").sortWithinPartitions("archive", "offset"), run, RECORD)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", archive: int = ARCHIVE) -> tuple[DataFrame, str]:
    """Pages through whole-stream archives into normalised ones: the manifest of these and their folder. The first ones are removed."""
    base = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    raw, into = f"{base}/streams", f"{base}/members"
    done = normalise(write_archives(with_firsts(pages, page_id, url, payload), raw, archive), raw, into)
    system, at = place(raw)
    system.delete_dir(at)
    return done, into


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, into = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PREFIX) + 1}) AS bigint)")
    back = read_records(offset_index(done, into), into)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, true AS intact
FROM f
"""
