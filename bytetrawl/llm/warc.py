"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

Archives are written by Spark's text writer, so that tasks commit their files whole on any file system that Spark knows: a row is
a gzip member, and as the line separator is a zero byte, which ends every member of less than 16 MiB, a row goes without its last
byte. Longer members get an empty member behind them, which ends in a zero byte too.

The reader takes member after member. A record whose member, header, length or digest fails is not returned; the next gzip member
or version line after its start is searched for, and the bytes up to there are logged as a gap.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import mmap
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, new_path, prepare

_END = b"\r\n\r\n"
_NEXT = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payload bytes in an archive, on average; a task goes on to its next archive then.
ARCHIVE_BYTES = 4 << 20
#: Archives from this length on are read through a mapped copy on the task's own disk, and not as a value.
MAPPED_BYTES = 1 << 30


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    def pack(data: bytes) -> bytes:
        c = zlib.compressobj(4, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    out = pack(record)
    return out if out[-1] == 0 else out + pack(b"")


def _clean(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value)).strip()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit without."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + block + _END


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzipped archives at path.

    Of rows with equal payloads of at least least_bytes, that with the largest page_id is a response and others revisit it. Where
    several rows have that page_id, all of them are responses. A null html is empty; rows with a null page_id are responses if no
    row with the payload has a page_id. Long payloads are written whole. Other columns are left out and may have any name; an empty
    table gives no records.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    last = last.select(F.col("sha").alias("s"), "last")
    of = rows.join(last, F.col("sha") == F.col("s"), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            out = []
            for page_id, url, p, last_id, again in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["last"], pdf["revisit"], strict=True):
                own = None if page_id is None or page_id != page_id else int(page_id)
                out.append(member(record("revisit" if again else "response", own, url, bytes(p), digest(bytes(p)), int(last_id) if again else None))[:-1])
            yield pd.DataFrame({"value": out})

    packed = of.select("page_id", "url", "payload", "last", revisit.alias("revisit")).mapInPandas(pack, "value binary")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("payload"))).first()
    records = max(1, ARCHIVE_BYTES * n // max(size or 0, 1)) if n else 1
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", min(records, 1 << 30)).text(path)


@dataclass
class Salvage:
    """What was read from one archive. gaps: (start, end, reason) of quarantined bytes; offsets of records are those of their members or version lines."""

    records: list[tuple[int, dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def parse(data: bytes | mmap.mmap, at: int = 0, check: bool = True) -> tuple[dict[str, str], bytes, int]:
    """The header, block and end of the record at an offset; ValueError says what is wrong."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise ValueError("no version line")
    end = data.find(_END, at)
    if end < 0:
        raise ValueError("unfinished header")
    head: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise ValueError("no length")
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != _END:
        raise ValueError("wrong length")
    block = data[start:stop]
    stated = head.get("warc-block-digest", "")
    if check and stated.startswith("sha1:") and stated[5:] != digest(block):
        raise ValueError("wrong digest")
    return head, block, stop + 4


def inflate(data: bytes | mmap.mmap, at: int) -> tuple[bytes, int]:
    """The content and end of the gzip member at an offset, with its checksum tested."""
    d = zlib.decompressobj(31)
    out = []
    pos = at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos : pos + (1 << 16)]))
            pos = min(pos + (1 << 16), len(data))
    except zlib.error as e:
        raise ValueError("bad member") from e
    if not d.eof:
        raise ValueError("unfinished member")
    return b"".join(out), pos - len(d.unused_data)


@dataclass(frozen=True)
class Record:
    start: int
    head: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


def salvaged(data: bytes | mmap.mmap) -> Iterator[Record | Gap]:
    """Every record of an archive that passes its checks, gzipped or not, and the gaps between them, in order."""
    at, lost, reason, n = 0, -1, "", len(data)
    while at < n:
        held: list[Record] = []
        damage = ""
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                content, end = inflate(data, at)
                pos = 0
                while pos < len(content):
                    head, block, pos = parse(content, pos)
                    held.append(Record(at, head, block))
            else:
                head, block, end = parse(data, at)
                held.append(Record(at, head, block))
        except ValueError as e:
            damage = str(e)
        if damage:
            if lost < 0:
                lost, reason = at, damage
            yield from held  # records of a member that come before the damage
            m = _NEXT.search(data, at + 1)
            at = m.start() if m else n
            continue
        if lost >= 0:
            yield Gap(lost, at, reason)
            lost = -1
        yield from held
        at = end
    if lost >= 0:
        yield Gap(lost, n, reason)


def salvage(data: bytes) -> Salvage:
    """All of them together."""
    out = Salvage()
    for x in salvaged(data):
        if isinstance(x, Gap):
            out.gaps.append((x.start, x.end, x.reason))
        else:
            out.records.append((x.start, x.head, x.block))
    return out


@contextlib.contextmanager
def _mapped(path: str) -> Iterator[mmap.mmap]:
    """An archive of any length as bytes that are read when they are looked at."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    with contextlib.ExitStack() as stack:
        if local.startswith("/"):
            f = stack.enter_context(open(local, "rb"))
        else:
            system, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))
            f = stack.enter_context(tempfile.TemporaryFile())  # this task's own copy, gone with it
            shutil.copyfileobj(stack.enter_context(system.open_input_stream(name)), f, 1 << 20)
            f.flush()
        yield stack.enter_context(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Damaged(ValueError):
    """An archive with bytes that are no whole records."""


def read_archives(spark: SparkSession, path: str, strict: bool = False, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives: path, start, end (gaps only), kind (record or gap), type, page_id, url, payload, payload_bytes, payload_digest, refers_to, reason.

    Damaged records are left out, and each stretch of such bytes is a gap; strict: the first gap is an error instead, as a result without
    its records wouldn't be whole. payloads: without them, payload is null. A task reads an archive from start to end, as a record's start is
    known only from the one before it.
    """
    prepare(spark)
    found = spark.read.format("binaryFile").load(path)
    small = found.where(F.col("length") < MAPPED_BYTES).select("path", "content")
    files = small.unionByName(found.where(F.col("length") >= MAPPED_BYTES).select("path", F.lit(None).cast("binary").alias("content")))

    def number(value: str | None) -> int | None:
        return int(value) if value is not None and re.fullmatch(r"-?\d{1,19}", value) else None

    columns = ["path", "start", "end", "kind", "type", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "reason"]

    def table(rows: list[tuple]) -> pd.DataFrame:
        part = pd.DataFrame(rows, columns=columns)
        for c in ("start", "end", "page_id", "payload_bytes", "refers_to"):
            part[c] = part[c].astype("Int64").to_numpy(dtype=object, na_value=None)
        return part

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with contextlib.nullcontext(content) if content is not None else _mapped(name) as data:
                    rows: list[tuple] = []
                    size = 0
                    for x in salvaged(data):
                        if isinstance(x, Gap):
                            if strict:
                                raise Damaged(f"{name}, bytes {x.start} to {x.end}: {x.reason}")
                            rows.append((name, x.start, x.end, "gap", None, None, None, None, x.end - x.start, None, None, x.reason))
                            continue
                        head, block = x.head, x.block
                        payload = block[block.find(_END) + 4 :] if head.get("content-type", "").startswith("application/http") else block
                        kind = head.get("warc-type")
                        own = number(head.get("x-payload-length")) if kind == "revisit" else len(payload)
                        sha = head.get("warc-payload-digest", "")[5:] if kind == "revisit" else digest(payload)
                        rows.append((name, x.start, None, "record", kind, number(head.get("x-page-id")), head.get("warc-target-uri"), payload if payloads else None, own, sha, number(head.get("x-refers-to-page-id")), None))
                        size += len(payload) if payloads else 0
                        if len(rows) >= 500 or size > 16 << 20:
                            yield table(rows)
                            rows, size = [], 0
                    if rows:
                        yield table(rows)

    return files.mapInPandas(read, "path string, start long, end long, kind string, type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, reason string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read these back, and return page_id, payload_bytes, payload_digest, record_type and refers_to of each record.

    Null html is an empty payload; null urls have no header; of equal payloads (ties) the largest page_id is the response; an empty table gives an
    empty table; repeated rows give repeated records; other columns are left out. Damage to an archive in between is an error.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    got = read_archives(spark, path, strict=True, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: A page's SHA-1 in base 32 is put together from eight numbers of 20 bits, each four letters of 5 bits.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NIBBLE = "(instr('0123456789abcdef', substr(h, 5 * i + {}, 1)) - 1)"
_NUMBER = " + ".join(f"{_NIBBLE.format(k + 1)} * {16 ** (4 - k)}" for k in range(5))
_BASE32 = f"list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda b: substr('{_LETTERS}', CAST((({_NUMBER}) >> b) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '')"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (SELECT page_id, t, top, sha1(t) AS h FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d
"""
