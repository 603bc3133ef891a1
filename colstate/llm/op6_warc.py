"""Deterministic sharded WARC writer, and the reader of its archives.

Records are dealt into ranges of page_id of about equal bytes and sorted within each; a task writes a range as a row of
``.warc.gz`` files, one gzip member a record, and rolls to the next file at a compressed size. Names,
headers, digests and dates come from the content alone, so a second run or a task that runs again
writes the same bytes. Files get their names by renaming when complete; ``MANIFEST.json``, written
last, lists them with sizes and digests; only listed files are read, and they must have these sizes and digests.

Of records with equal payloads of at least ``revisit_bytes``, that with the largest page_id is the
response; the others are revisits that refer to it. Smaller payloads are always responses.

Defined cases: a null html is an empty payload; null page_ids come first and lose to any number; if
the same page_id comes with the same payload more than once, the first such row in the order of
url is the response and the others revisit it; a null url gives no target URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.llm import common

PAGE, PAYLOAD_BYTES, REFERS_PAGE = "Colstate-Page-ID", "Colstate-Payload-Length", "Colstate-Refers-To-Page-ID"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, sha1: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{sha1}:{nth}')}>"


def _b32(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def record(page_id, url, payload: bytes, sha1: str, refers_to, nth: int, date: str) -> bytes:
    """The record of a page. refers_to: None for a response, else ``(page_id,)`` of it."""
    raw = bytes.fromhex(sha1)
    http = _HTTP % len(payload)
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, sha1, nth))]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Date", date), ("WARC-Payload-Digest", _b32(raw)), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest()))]
    if refers_to:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha1))]
        fields += [(REFERS_PAGE, "null" if refers_to[0] is None else str(refers_to[0]))]
    fields += [(PAGE, "null" if page_id is None else str(page_id)), (PAYLOAD_BYTES, str(len(payload)))]
    return _record([*fields, ("Content-Type", "application/http; msgtype=response")], block)


class _Files:
    """The files of a range, rolled by compressed size."""

    def __init__(self, root: str, part: int, roll: int, date: str):
        self.root, self.part, self.roll, self.date, self.seq, self.out = root, part, roll, date, 0, None

    def add(self, data: bytes) -> dict | None:
        """Append a record; the row of the file that this has closed, if any."""
        if self.out is None:
            self.name = f"pages-{self.part:05d}-{self.seq:05d}.warc.gz"
            self.fs, self.path = common.filesystem(f"{self.root}/{self.name}")
            self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>")]
            info += [("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._write(_record(info, b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1
        return self.close() if self.size >= self.roll else None

    def _write(self, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temp, self.path)
        self.out, self.seq = None, self.seq + 1
        return {"name": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def write_warc(
    pages: DataFrame,
    root: str,
    *,
    revisit_bytes: int = 1000,
    range_bytes: int = 32 << 20,
    roll_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> dict:
    """Write ``pages (page_id, url, html)``; the manifest."""
    spark = pages.sparkSession
    common.tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    rows = rows.withColumn("at", common.place(F.col("page_id"), common.beginning(F.col("sha1"))))
    ranges = common.ranges_of(rows.select("at", (F.col("n") + 256).alias("nbytes")), range_bytes)

    # which payloads come more than once: no payload is moved for this. For each page with such a
    # payload a mark goes ahead of the page, to the task that writes it.
    light = rows.where(F.col("n") >= revisit_bytes).select("page_id", "sha1")
    tops = light.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1")
    tops = common.written(tops.select("sha1", "top"), f"{root}.work/tops")  # so that the join's hot partitions can be split
    marks = light.distinct().join(tops, "sha1").select(
        common.place(F.col("page_id"), common.beginning(F.col("sha1"))).alias("at"), "page_id", "sha1", F.lit(0).alias("kind"), "top",
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"),
    )
    whole = rows.select("at", "page_id", "sha1", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("top"), "url", "html")
    dealt = marks.unionByName(whole).withColumn("part", ranges.of(F.col("at"))["part"]).repartitionById(len(ranges), "part")
    dealt = dealt.sortWithinPartitions("at.id", "at.tie", "sha1", "kind", F.col("url").asc_nulls_first())
    dealt = dealt.select("part", "page_id", "sha1", "kind", "top", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, part, mark, before, nth = None, None, None, None, 0
        done: list[dict] = []
        for b in batches:
            for p, page_id, sha1, kind, top, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if files is not None:
                        done.append(files.close())
                    files, part = _Files(root, p + 1, roll_bytes, date), p
                if not kind:
                    mark = (page_id, sha1, top)
                    continue
                nth = nth + 1 if before == (part, page_id, sha1) else 0
                before = (part, page_id, sha1)
                refers = None
                if mark is not None and mark[:2] == (page_id, sha1) and (nth or page_id != mark[2]):
                    refers = (mark[2],)
                done.append(files.add(record(page_id, url, html.encode(), sha1, refers, nth, date)))
            done = [x for x in done if x]
            if done:
                yield pa.RecordBatch.from_pylist(done)
                done = []
        if files is not None and (last := files.close()):
            yield pa.RecordBatch.from_pylist([last])

    kind = "name string, records bigint, bytes bigint, sha256 string"
    files = sorted((r.asDict() for r in dealt.mapInArrow(write, kind).collect()), key=lambda r: r["name"])  # a row a file
    manifest = {"format": "WARC/1.1", "date": date, "files": files}
    common.commit_bytes(f"{root}/MANIFEST.json", json.dumps(manifest, indent=1).encode())
    common._quiet(f"{root}.work")
    return manifest


# reading --------------------------------------------------------------------------------------


def members(blocks: Iterable[bytes], step: int = 1 << 14) -> Iterator[bytes]:
    """The members of a gzip stream, one by one. What follows a member is copied when it ends, so blocks are fed in small steps."""
    z, parts, fed = zlib.decompressobj(31), [], False
    for block in blocks:
        view, at = memoryview(block), 0
        while at < len(view):
            piece = view[at : at + step]
            parts.append(z.decompress(piece))
            at, fed = at + len(piece), True
            if z.eof:
                at -= len(z.unused_data)
                yield b"".join(parts)
                z, parts, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends within a record")


class _Checked:
    """A file's blocks, and their length and digest when all are read."""

    def __init__(self, f):
        self.f, self.size, self.sha = f, 0, hashlib.sha256()

    def __iter__(self) -> Iterator[bytes]:
        while data := self.f.read(1 << 20):
            self.size += len(data)
            self.sha.update(data)
            yield data


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    return fields, rest[:n]


READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def row_of(fields: dict[str, str], block: bytes) -> tuple | None:
    """A page's row, its digests checked; None for other records."""
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    if _b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    number = lambda x: None if x in (None, "null") else int(x)
    raw = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    size = int(fields[PAYLOAD_BYTES])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).digest() != raw or len(payload) != size:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    return number(fields[PAGE]), size, raw.hex(), kind, number(fields.get(REFERS_PAGE))


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """Per page record of the archives that the manifest lists."""
    files = json.loads(common.read_bytes(f"{root}/MANIFEST.json"))["files"]
    if not files:
        return spark.createDataFrame([], READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for b in batches:
            for entry in b.to_pylist():
                fs, path = common.filesystem(f"{root}/{entry['name']}")
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    blocks = _Checked(f)
                    for data in members(blocks):
                        if (r := row_of(*parse(data))) is not None:
                            rows.append(r)
                if (blocks.size, blocks.sha.hexdigest()) != (entry["bytes"], entry["sha256"]):
                    raise ValueError(f"{entry['name']} isn't the file that the manifest lists")
                if len(rows) != entry["records"]:
                    raise ValueError(f"{entry['name']}: {entry['records']} records expected, {len(rows)} found")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    entries = [(x["name"], x["records"], x["bytes"], x["sha256"]) for x in files]
    todo = spark.createDataFrame(entries, "name string, records bigint, bytes bigint, sha256 string")
    return todo.repartition(len(files)).mapInArrow(read, READ_SCHEMA)


def written_pages(pages: DataFrame, root: str, **options) -> DataFrame:
    write_warc(pages, root, **options)
    return read_warc(pages.sparkSession, root)


def text_of_record(data: bytes) -> str:
    """A response's html, for users of single records."""
    _, block = parse(gzip.GzipFile(fileobj=io.BytesIO(data)).read())
    return block.partition(b"\r\n\r\n")[2].decode()


#: DuckDB SQL for the query's result over ``pages``.
ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), t AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""
