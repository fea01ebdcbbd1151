"""WARC archives with a two-level capture index.

Pages become WARC records, each its own gzip member, in archive files of about ``ARCHIVE_BYTES``. Of records with equal
payloads of at least ``REVISIT_BYTES`` the one with the largest key is a response and the others revisit it.

Index, first level: one line per record under its reversed-host key (``com,example,www)/path``), sorted, in compressed
blocks of ``BLOCK_LINES`` lines. Second level: a directory with the first key and place of each block. A lookup
binary-searches the directory, reads one or few blocks by range, and then the records by range from their archives.

Files are named anew by every task attempt, and only those in the tables that Spark commits are ever read, so lost and
repeated tasks do no harm. Equal payloads are found by a digest that is summed before any shuffle.

Defined results: a null html is an empty payload; a null url has an empty index key and no target; null page ids are
kept, and never the one that others refer to unless all are null; equal rows are each a record (all of those with the
largest id are responses); empty tables give empty archives. Only the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, dealt, shared_files, written
from siltstone.session import fresh_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 1000
TASK_RECORDS = 5000
DIRECTORY_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"

# Record fields and the profile of a revisit, from the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

LINE = "key string, page string, kind string, digest string, file string, offset long, length long"


@dataclass(frozen=True)
class Archive:
    """Index lines, their blocks and the directory of blocks, all written."""

    lines: DataFrame
    directory: DataFrame


def index_key(url: str | None) -> str:
    """The url with its host reversed, so that a domain and its subdomains sort together."""
    found = re.match(r"[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)(.*)", url or "", re.S)
    if not found:
        return url or ""
    host, _, port = found[1].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (":" + port if port else "") + ")" + (found[2] or "/")


def record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + str(page))}>"


def record(kind: str, page: str | None, url: str | None, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    """One WARC record as a gzip member."""
    block = HTTP + payload if kind == "response" else HTTP
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    if page is not None:
        fields.append(("X-Page-Id", page))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page", refers)]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]) + "\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with payload digest and size, and the page that a revisit refers to."""
    payload = F.coalesce(column(html), F.lit("")).cast("binary")
    rows = pages.select(column(key).alias("page"), column(url).alias("url"), column(html).alias("html"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    repeated = (rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest")
                .agg(F.max("page").alias("largest"), F.count(F.lit(1)).alias("records")).where("records > 1")
                .select("digest", "largest"))
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page").eqNullSafe(F.col("largest"))
    return joined.select("page", "url", "html", "digest", "size", F.when(revisit, F.col("largest")).alias("refers"))


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  folder: str | None = None) -> Archive:
    """Write every page as a record and index it."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = shared_files(folder)
        files.create_dir(root, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for frame in frames:
                rows = []
                for page, link, body, digest, size, refers in frame.itertuples(index=False, name=None):
                    if out is None:
                        name, at = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "response" if refers is None else "revisit"
                    payload = (body or "").encode("utf-8", "surrogatepass") if refers is None else b""
                    data = record(kind, page, link, digest, size, payload, refers)
                    out.write(data)
                    rows.append((index_key(link), page, kind, digest, name, at, len(data)))
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])
        finally:
            if out is not None:
                out.close()

    texts = with_revisits(pages, key, url, html).select(F.col("page").cast("string").alias("page"), "url", "html", "digest",
                                                        "size", F.col("refers").cast("string").alias("refers"))
    lines = written(texts.mapInPandas(records, LINE), "captures")
    return Archive(lines, write_index(lines, folder))


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """The sorted lines in compressed blocks; returns the directory: first and last key, file, offset, length."""
    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = shared_files(folder)
        files.create_dir(root, recursive=True)
        part, at, held, rows, out, name = TaskContext.get().partitionId(), 0, [], [], None, ""

        def flush() -> None:
            nonlocal at, held, out, name
            if out is None:
                name = f"index-{part:06d}-{uuid.uuid4().hex}.cdx"
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join(map(_escaped, line)) for line in held)
                                 .encode("utf-8", "surrogatepass"))
            out.write(data)
            rows.append((held[0][0], held[-1][0], name, at, len(data), len(held)))
            at, held = at + len(data), []

        try:
            for frame in frames:
                for line in frame.itertuples(index=False, name=None):
                    held.append(line)
                    if len(held) == BLOCK_LINES:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        yield pd.DataFrame(rows, columns=["first_key", "last_key", "file", "offset", "length", "lines"])

    order = [F.col(c) for c in ("key", "page", "file", "offset")]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ordered.mapInPandas(blocks, "first_key string, last_key string, file string, offset long, length long, "
                                        "lines long")
    return written(found.withColumn("folder", F.lit(folder)), "directory")


def _escaped(value: object) -> str:
    if value is None:
        return "\\N"
    return str(value).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _plain(value: str) -> str | None:
    if value == "\\N":
        return None
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), value)


def _block_lines(data: bytes) -> list[tuple]:
    rows = [tuple(map(_plain, line.split("\t"))) for line in
            zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]
    return [(*r[:5], int(r[5]), int(r[6])) for r in rows]


def _ranges(folder: str):
    """A function that reads a range of a file of the folder; files stay open."""
    files, root = shared_files(folder)
    opened: dict[str, object] = {}

    def read(name: str, offset: int, length: int) -> bytes:
        if name not in opened:
            for old in opened.values():
                old.close()
            opened.clear()
            opened[name] = files.open_input_file(f"{root}/{name}")
        return opened[name].read_at(length, offset)

    return read


def index_lines(archive: Archive) -> DataFrame:
    """Every index line, from the blocks that the directory names, with the folder of its archive."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder, name, offset, length in frame.itertuples(index=False, name=None):
                rows = _block_lines(_ranges(folder)(name, offset, length))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")]).assign(folder=folder)

    places = archive.directory.select("folder", "file", "offset", "length")
    return dealt(places, archive.directory.count()).mapInPandas(run, LINE + ", folder string")


def read_all(archive: Archive, payloads: bool = False) -> DataFrame:
    """Every record of an archive, through its index."""
    records = archive.directory.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    return read_records(index_lines(archive), payloads, -(-records // TASK_RECORDS))


def read_records(lines: DataFrame, payloads: bool = False, parts: int | None = None) -> DataFrame:
    """The records that index lines point to, read by range: page, size, digest, kind, what it refers to. ``parts`` says
    over how many tasks the reading is dealt.

    Size and digest of a response are taken from its payload; a revisit states those of the payload it stands for.
    """
    schema = "page string, url string, size long, digest string, kind string, refers string" + (
        ", payload binary" if payloads else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, at = None, None
        for frame in frames:
            rows = []
            for folder, name, offset, length in frame.itertuples(index=False, name=None):
                if folder != at:
                    reader, at = _ranges(folder), folder
                fields, payload = parse(reader(name, offset, length))
                kind = fields["WARC-Type"]
                size, digest = ((len(payload), hashlib.sha1(payload).hexdigest()) if kind == "response" else
                                (int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")))
                row = (fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, kind,
                       fields.get("X-Refers-To-Page"))
                rows.append((*row, payload) if payloads else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    places = lines.select("folder", "file", "offset", "length")
    piece = (F.col("offset") / F.lit(ARCHIVE_BYTES // 16)).cast("int")
    by = [F.col("file"), piece]
    spread = places.repartition(max(1, parts), *by) if parts is not None else places.repartition(*by)
    return spread.sortWithinPartitions("file", "offset").mapInPandas(run, schema)


def lookup(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """Index lines of the given urls: binary search in the directory, then range reads of the blocks that can hold them.

    The directory goes to the tasks if it has at most ``DIRECTORY_ROWS`` rows; a larger one is not sent: then the lines
    of all blocks are joined with the keys.
    """
    keys = urls.select(F.udf(lambda u: index_key(u), "string")(column(url)).alias("key")).distinct()
    directory = archive.directory.orderBy("first_key", "last_key", "file", "offset").limit(DIRECTORY_ROWS + 1).collect()
    if len(directory) > DIRECTORY_ROWS:
        return index_lines(archive).join(keys, "key", "left_semi")
    places = [tuple(r) for r in directory]
    firsts = [p[0] for p in places]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key in frame["key"]:
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and places[at][1] >= key:
                    _, _, name, offset, length, _, folder = places[at]
                    rows = [r for r in _block_lines(_ranges(folder)(name, offset, length)) if r[0] == key]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")]).assign(folder=folder)
                    at -= 1

    return keys.mapInPandas(run, LINE + ", folder string")
