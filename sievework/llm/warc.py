"""WARC archives with revisit records, and a two-level capture index.

Writing: of pages with equal payloads (SHA-256) of at least REVISIT_BYTES bytes, the one with the smallest
id is a response, the others are revisits that refer to it. Every record is a gzip member of an archive in
the shared folder. A task writes archives under names of its own attempt and reports what it wrote; names
of lost attempts are in no index.

Index: entries (reversed-host URL key, page id, archive, offset, length) are sorted over the whole corpus
and packed into compressed blocks of BLOCK entries. Each index file has a sparse directory at its end, one
line for each of its blocks: the first key and page, offset and length. A lookup finds the index file among
the files' first keys (a row for each file, as many as the session's range partitions, so it is broadcast),
binary-searches that file's directory, reads the range of a block, binary-searches that, and reads the range
of the record. Captures.find does so in tasks, for a table of URLs or of URLs and page ids, sorted so that a
task reads a block once; records that lie close together in one archive are read as one range.

Payloads stay where they are unless their digest repeats; digests of a thousandth of all pages or more are
broadcast, so only payloads of rarer repeats are shuffled.

Null payloads are empty and very long ones are records like others; a null URL has the key of an empty host; a
null page id stays null. Several rows of one page id are several records; copies of the response with its very
id are responses too. Pages of null id refer to the smallest id of their payload like others; where no page
of a payload has an id, all are responses. Other columns aren't read, so their names don't matter. An empty
table gives an empty index.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievework.llm.common import bound_batches, maybe_among, new_folder, staged, with_table

REVISIT_BYTES = 100
#: Entries of an index block; bytes after which an archive is closed; bytes of a reading range and the largest gap in it.
BLOCK, ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 2_000, 256 << 20, 8 << 20, 64 << 10
DATE = "2000-01-01T00:00:00Z"


def _fs(uri: str):
    """A file system that executors can write to, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri)))


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.a.org:80/x?y#z gives org,a,www)/x?y."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + re.sub(r"[\x00-\x20]", "", url or "")
    shown = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + shown + ")" + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", tail)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page is None else page}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(level, wbits=31)
    return gz.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse_record(member: bytes) -> dict:
    """Headers in lower case, and for responses the payload; a payload that its digest doesn't fit raises."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record of page {fields['x-page-id']} is damaged")
    return {
        "page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number("x-refers-to-page-id"), "url": fields["warc-target-uri"],
        "payload": payload if kind == "response" else None
    }


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest and the id that a revisit refers to."""
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), text.alias("html"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("digest")
    )
    long = F.octet_length("html") >= REVISIT_BYTES
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = staged(first.where("n > 1 AND first IS NOT NULL"), "repeats")
    marked = maybe_among(rows, "digest", first, "digest")
    both = with_table(marked.where("maybe").drop("maybe"), first, "digest", "n")
    none = F.lit(None).cast("long")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    names = ["page_id", "url", "html", "digest"]
    return marked.where("not maybe").select(*names, none.alias("refers_to")).unionAll(both.select(*names, refers.alias("refers_to")))


def _place(key: str, page: int | None) -> tuple:
    """The order of entries: by key, then by page, no page before all."""
    return key, page is not None, page or 0


@dataclass
class Captures:
    """A written archive: its folder, and a row for each index file with its first key and page and its directory's place."""

    folder: str
    files: DataFrame

    def keys(self, table: DataFrame, url: str = "url") -> DataFrame:
        """table with key, the URL key of its url."""
        import pandas as pd

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield p.assign(key=[url_key(u) for u in p[url]])

        bound_batches(table.sparkSession)
        return table.mapInPandas(run, StructType([*table.schema.fields, StructField("key", StringType())]))

    def find(self, wanted: DataFrame, url: str = "url", page: str | None = None) -> DataFrame:
        """key, page, archive, at and size of the captures of a table's URLs; with page, of its URLs and page ids only.
        Each different one is looked up once."""
        import pandas as pd

        folder = self.folder
        files = self.files.sparkSession.sparkContext.broadcast(sorted((tuple(r) for r in self.files.collect()), key=lambda r: _place(r[0], r[1])))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(folder, files.value)
            for p in parts:
                found = (e for k, n in zip(p["key"], p["page"], strict=True) for e in index.find(k, None if pd.isna(n) else int(n), page is not None))
                while some := list(islice(found, 10_000)):
                    got = pd.DataFrame(some, columns=["key", "page", "archive", "at", "size"])
                    yield got.astype({"page": "Int64", "at": "int64", "size": "int64"})

        number = F.col(f"`{page}`").cast("long") if page else F.lit(None).cast("long")
        asked = self.keys(wanted.select(F.col(f"`{url}`").alias("url"), number.alias("page"))).select("key", "page").distinct()
        # sorted, so that neighbours are in one block
        dealt = asked.repartitionByRange(
            max(1, 2 * asked.sparkSession.sparkContext.defaultParallelism), "key", "page"
        ).sortWithinPartitions("key", "page")
        return dealt.mapInPandas(run, "key string, page long, archive string, at long, size long")

    def read(self, entries: DataFrame, payloads: bool = False) -> DataFrame:
        """The records of entries. Digests of payloads are checked; payloads come along if asked for."""
        import pandas as pd

        folder, names = self.folder, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for archive, mine in p.groupby("archive", sort=False):
                    rows = [
                        parse_record(m) for m in read_ranges(folder, archive, sorted(zip(mine["at"].tolist(), mine["size"].tolist(), strict=True)))
                    ]
                    yield pd.DataFrame(
                        {
                            n: pd.array(
                                [r[n] for r in rows],
                                dtype="Int64" if n in ("page_id", "refers_to", "payload_bytes") else "object"
                            ) for n in names
                        }
                    )

        spark = entries.sparkSession
        near = entries.withColumn("part", F.floor(F.col("at") / RANGE_BYTES))
        dealt = near.repartition(
            spark.sparkContext.defaultParallelism * 2, "archive", "part"
        ).sortWithinPartitions("archive", "at").select("archive", "at", "size")
        kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
        return dealt.mapInPandas(run, kinds)

    def lookup(self, urls: list[str]) -> list[dict]:
        """The captures of some URLs, with payloads."""
        spark = self.files.sparkSession
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        return [r.asDict() for r in self.read(self.find(asked), payloads=True).collect()]


class Index:
    """Looks keys up in the index files of a folder. It holds one directory and one block at a time."""

    def __init__(self, folder: str, files: list[tuple]):
        self.folder, self.files = folder, files
        self.firsts = [_place(f[0], f[1]) for f in files]
        self.open_file, self.directory, self.open_block, self.entries = -1, [], None, []

    def blocks(self, file: int) -> list[tuple]:
        """Order, offset and length of the blocks of a file."""
        if self.open_file != file:
            _, _, name, offset, length = self.files[file]
            lines = map(json.loads, read_block(self.folder, name, offset, length))
            self.directory = [(_place(k, n), at, size) for k, n, at, size in lines]
            self.open_file = file
        return self.directory

    def block(self, file: int, number: int) -> list[list]:
        if self.open_block != (file, number):
            _, at, size = self.blocks(file)[number]
            self.entries = [json.loads(line) for line in read_block(self.folder, self.files[file][2], at, size)]
            self.open_block = file, number
        return self.entries

    def find(self, key: str, page: int | None, paged: bool) -> Iterator[list]:
        """Entries of a key, in order; of one page only, if paged."""
        place = _place(key, page) if paged else (key,)
        # entries of that place may begin in the block before the first that starts with it or beyond it
        file = max(0, bisect.bisect_left(self.firsts, place) - 1)
        number = max(0, bisect.bisect_left(self.blocks(file), place, key=lambda b: b[0]) - 1) if self.files else 0
        while file < len(self.files):
            if number >= len(self.blocks(file)):
                file, number = file + 1, 0
                continue
            if self.blocks(file)[number][0][: len(place)] > place:
                return
            entries = self.block(file, number)
            at = bisect.bisect_left(entries, place, key=lambda e: _place(e[0], e[1])[: len(place)])
            while at < len(entries) and _place(entries[at][0], entries[at][1])[: len(place)] == place:
                yield entries[at]
                at += 1
            number += 1


def read_block(folder: str, file: str, offset: int, length: int) -> list[bytes]:
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{file}") as f:
        return zlib.decompress(f.read_at(int(length), int(offset))).splitlines()


def read_ranges(folder: str, archive: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The members at ranges (offset, length) in rising order; near ones are read together."""
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{archive}") as f:
        i = 0
        while i < len(ranges):
            start, j, end = ranges[i][0], i, ranges[i][0]
            while j < len(ranges) and ranges[j][0] - end <= GAP_BYTES and (j == i or ranges[j][0] + ranges[j][1] - start <= RANGE_BYTES):
                end = max(end, ranges[j][0] + ranges[j][1])
                j += 1
            data = f.read_at(end - start, start)
            for a, n in ranges[i:j]:
                yield data[a - start : a - start + n]
            i = j


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> Captures:
    """Write archives and index below folder (a new one in the shared folder, if None)."""
    import pandas as pd

    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def archive(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(folder)
        fs.create_dir(root)
        out, name, size = None, "", 0
        try:
            for p in parts:
                rows = []
                for page, where, text, digest, refers in zip(p["page_id"], p["url"], p["html"], p["digest"], p["refers_to"], strict=True):
                    page = None if pd.isna(page) else int(page)
                    member = make_record(page, where, text.encode("utf-8", "surrogatepass"), digest, None if pd.isna(refers) else int(refers))
                    if out is None or size >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    rows.append((url_key(where), page, name, size, len(member)))
                    size += len(member)
                got = pd.DataFrame(rows, columns=["key", "page", "archive", "at", "size"])
                yield got.astype({"page": "Int64"})
        finally:
            if out is not None:
                out.close()

    bound_batches(spark)
    entries = staged(planned(pages, key, url, html).mapInPandas(archive, "key string, page long, archive string, at long, size long"), "captures")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(folder)
        name, out, at, held, directory = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def put(lines: list) -> tuple[int, int]:
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            out.write(data)
            at += len(data)
            return at - len(data), len(data)

        for p in parts:
            for k, page, file, start, size in zip(p["key"], p["page"], p["archive"], p["at"], p["size"], strict=True):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                held.append((k, None if pd.isna(page) else int(page), file, int(start), int(size)))
                if len(held) >= BLOCK:
                    directory.append((*held[0][:2], *put(held)))
                    held = []
        if held:
            directory.append((*held[0][:2], *put(held)))
        if out is not None:
            place = put(directory)
            out.close()
            yield pd.DataFrame([(*directory[0][:2], name, *place)], columns=["first", "page", "file", "offset", "length"]).astype({"page": "Int64"})

    ordered = entries.repartitionByRange(
        max(1, spark.sparkContext.defaultParallelism), "key", "page", "archive", "at"
    ).sortWithinPartitions("key", "page", "archive", "at")
    return Captures(folder, staged(ordered.mapInPandas(pack, "first string, page long, file string, offset long, length long"), "files"))
