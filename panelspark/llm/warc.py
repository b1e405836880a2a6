"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: a record is one string whose terminator is the line separator of the text
writer, so files are ordinary job output (committed by task, on any Hadoop file system,
gzip as a whole). Equal payloads are stored once: the record with the largest page id is
the response, the others are revisits that refer to it.

Reading (``format("warc")``): the driver lists the files and packs them into partitions
by size; a task parses the header block of a record first, tests the pushed predicates
(record type and other header columns) and steps over the payload of a record that
fails, or of every record with option payload=false, without keeping or decoding it.

Defined results: null html is an empty payload; a null page id is the smallest and is
read back as null; repeated rows of a response's page are responses as well; a null URL
is written as the record's own id; a record cut short at the end of a file is an error;
an empty table gives no records.
"""

import gzip
import io

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull,
                                    StringStartsWith)

from .text import cut, small

SCHEMA = ("record_id string, warc_type string, target_uri string, date string, payload_digest string, "
          "refers_to string, content_type string, content_length bigint, http_length bigint, payload binary")
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri",
           "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
           "content_type": "content-type"}
PACK = 64 << 20         # bytes of files in a partition
STEP = 1 << 20          # bytes read at once while stepping over a payload
BATCH = 8 << 20         # payload bytes in an Arrow batch

# Digits of a number in base 32 as Spark's conv writes them, and of RFC 4648.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base-32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, RFC32)


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def roles(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(digest, bytes, winner) of the payloads that occur more than once."""
    keys = pages.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("bytes"))
    return (keys.filter(F.col("bytes") >= at_least).groupBy("digest", "bytes")
            .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))


def records(pages: DataFrame, at_least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the record of every row of (page_id, url, payload), without its end."""
    shared = small(cut(roles(pages, at_least))).withColumn("shared", F.lit(True))
    d = pages.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload")})
    d = d.join(shared, ["digest", "bytes"], "left")
    again = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    d = d.withColumn("again", again).withColumn(
        "block", F.concat(http, F.when(F.col("again"), "").otherwise(F.col("payload"))))
    uri = F.coalesce(F.translate("url", "\r\n", ""), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:"))
    more = F.when(F.col("again"), F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
        urn(F.col("winner")), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), more,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(END))
    return d.select(F.concat(head, "block").alias("value"))


def write(pages: DataFrame, path: str, at_least: int = 0, compression: str = "gzip") -> None:
    """Archives of (page_id, url, html)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    records(p, at_least).write.mode("overwrite").option("lineSep", END).option("compression", compression).text(path)


class Files(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class WarcSource(DataSource):
    """Options: path; payload (default true): whether payloads are read at all."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted = []        # (header, kind, values), all of which a record must meet

    def pushFilters(self, filters):
        for f in filters:
            header = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if header and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((header, "in", (f.value,)))
            elif header and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.wanted.append((header, "in", tuple(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.wanted.append((header, "starts", (f.value,)))
            elif header and isinstance(f, IsNotNull):
                self.wanted.append((header, "any", ()))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((x for x in found if x.type == fs.FileType.File and x.size and x.base_name[0] not in "._"),
                       key=lambda x: x.path)
        packs, room = [], 0
        for x in found:
            if not packs or room < x.size:
                packs.append([])
                room = PACK
            packs[-1].append(x.path)
            room -= x.size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import fs
        system = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        types = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t])
                           for n, t in (c.split() for c in SCHEMA.split(", "))])
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in parse(io.BufferedReader(Plain(stream), STEP), self.meets, self.payload, path):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    def meets(self, head) -> bool:
        for header, kind, values in self.wanted:
            v = head.get(header)
            if v is None or kind == "in" and v not in values or kind == "starts" and not v.startswith(values):
                return False
        return True


class Plain(io.RawIOBase):
    """A read-only raw stream over anything with read(n)."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, b):
        data = self.stream.read(len(b))
        b[:len(data)] = data
        return len(data)


def head_of(stream, first: bytes, path: str) -> dict:
    """Header fields (names in lower case) up to the empty line; folded lines are joined."""
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record in {path}: {first[:40]!r}")
    head, last = {}, None
    while True:
        line = stream.readline()
        if not line:
            raise ValueError(f"a header is cut short in {path}")
        if line in (b"\r\n", b"\n"):
            return head
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            head[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            head[last] = value.strip()


def parse(stream, meets, payload: bool, path: str):
    """Rows of the records whose headers meet the predicates."""
    while True:
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            first = stream.readline()
        if not first:
            return
        head = head_of(stream, first, path)
        left = int(head.get("content-length", 0))
        if not meets(head):
            step_over(stream, left, path)
            continue
        row = {c: head.get(h) for c, h in HEADERS.items()}
        row["content_length"], row["http_length"], row["payload"] = left, None, None
        if "http" in head.get("content-type", "") and left:
            # the block's own header comes first; what follows it is the payload
            while left:
                line = stream.readline(left)
                left -= len(line)
                if not line:
                    raise ValueError(f"a record is cut short in {path}")
                if line in (b"\r\n", b"\n"):
                    break
                if line[:15].lower() == b"content-length:":
                    row["http_length"] = int(line[15:])
        if payload and head.get("warc-type") != "revisit":
            data = stream.read(left)
            if len(data) < left:
                raise ValueError(f"a record is cut short in {path}")
            row["payload"] = data
        else:
            step_over(stream, left, path)
        yield row


def step_over(stream, n: int, path: str) -> None:
    while n:
        got = len(stream.read(min(n, STEP)))
        if not got:
            raise ValueError(f"a record is cut short in {path}")
        n -= got


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under a path. Filters on header columns reach the tasks that read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def pages_of(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of read records.

    A response's size and digest are those of the payload as read; a revisit's are those
    that its headers hold.
    """
    def page(c):
        return F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("bigint")

    own = F.col("warc_type") == "response"
    return archive.filter(F.col("warc_type").isin("response", "revisit")).select(
        page(F.col("record_id")).alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("http_length")).cast("bigint").alias("payload_bytes"),
        F.when(own, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
