"""WARC archives with a two-level capture index.

Writing: each task writes its pages to one archive in the shared folder, a gzip member for each record, and gives an
index row (reversed-host URL key, page, file, offset, length). Index rows are range-partitioned and sorted by (key,
page); each part becomes one file of compressed blocks followed by a sparse directory (first key and byte range of each
block), so no directory of all blocks is ever in one place. Reading: a query finds its part by the parts' first keys
(one for each partition), its block by binary search in that part's directory, reads that block's range only, finds its
lines by binary search again, and the archives are then read by ranges, in the order of their offsets.

Files are opened through pyarrow's file systems under the folder in spark.checkpoint.dir. Every attempt of a task writes
files of its own names, and the rows that it gives name them; so a task that is tried again, or twice at once, never
changes a file that other rows point to, and files of lost attempts are never read.

Defined cases: null html is an empty payload; a null URL has the key of an empty one; pages that repeat a page_id are
captures of their own, and the response among equal payloads is the largest page_id; a null page_id is a capture but
never a response others refer to, unless all are null; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import fresh, new_folder, table

#: Index lines in a compressed block.
BLOCK_LINES = 1024
EMPTY = base64.b32encode(hashlib.sha1(b"").digest()).decode()
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path and query: com,example,www)/path?query."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host, _, port = host.partition(":")
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{':' + port if port else ''}){path}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, sha1: str) -> bytes:
    """One gzip member with a response record, or with a revisit record, which has no payload."""
    revisit = refers_to is not None
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def read_record(member: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and payload of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, body.partition(b"\r\n\r\n")[2]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, write) -> None:
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:  # not by the ending of the name
        write(out)


def _own_name(kind: str, ending: str) -> str:
    """A file name that no other attempt of this or of another task has."""
    return f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{ending}"


INDEX = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition of pages (page_id, url, payload, refers_to); returns the index rows."""

    def written(batches):
        import pandas as pd

        name, rows = _own_name("pages", ".warc.gz"), []

        def write(out):
            at = 0
            for pdf in batches:
                refers = pdf["refers_to"].astype("Int64")
                for page, url, payload, ref in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["payload"], refers):
                    page, ref = (None if x is pd.NA else int(x) for x in (page, ref))
                    member = record(page, url, payload, ref, digest(payload))
                    out.write(member)
                    rows.append((url_key(url), page, name, at, len(member)))
                    at += len(member)

        _write(folder, name, write)
        if rows:
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    return pages.select("page_id", "url", "payload", "refers_to").mapInPandas(written, INDEX)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted index; returns a row for each part: file, first and last key, where its directory starts and its length."""

    def written(batches):
        import pandas as pd

        name = _own_name("index", ".cdxj.z")
        found: dict = {}

        def write(out):
            lines, directory, at, bounds = [], [], 0, [None, None]

            def block():
                nonlocal at
                z = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
                out.write(z)
                directory.append([lines[0][0], at, len(z)])
                at += len(z)
                lines.clear()

            for pdf in batches:
                for row in zip(pdf["key"], pdf["page_id"].astype("Int64"), pdf["file"], pdf["offset"], pdf["length"]):
                    bounds = [row[0] if bounds[0] is None else bounds[0], row[0]]
                    lines.append([row[0], None if row[1] is pd.NA else int(row[1]), row[2], int(row[3]), int(row[4])])
                    if len(lines) == BLOCK_LINES:
                        block()
            if lines:
                block()
            z = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(z)
            found.update(first=bounds[0], last=bounds[1], at=at, length=len(z))

        _write(folder, name, write)
        if found["first"] is not None:
            yield pd.DataFrame([{"part": name, **found}])

    sorted_rows = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return sorted_rows.mapInPandas(written, "part string, first string, last string, at long, length long")


class Part:
    """One part of the index: its sparse directory in memory, its blocks read when they are needed."""

    def __init__(self, store, path: str, at: int, length: int):
        self.file = store.open_input_file(path)
        self.file.seek(at)
        self.directory = json.loads(zlib.decompress(self.file.read(length)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple = (None, [])

    def block(self, i: int) -> list:
        if self.held[0] != i:
            self.file.seek(self.directory[i][1])
            lines = zlib.decompress(self.file.read(self.directory[i][2])).decode().split("\n")
            self.held = (i, [json.loads(x) for x in lines])
        return self.held[1]

    def find(self, key: str):
        """Every line with the key; equal keys may go over several blocks."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines = self.block(i)
            for j in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                if lines[j][0] != key:
                    return
                yield lines[j]
            i += 1


def lookup(keys: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """Index lines of every distinct key in keys (key); parts is what write_index returned, a row for each partition."""
    table_of = parts.orderBy("part").collect()  # bounded: one row for each partition of the index
    bounds = [(p["first"], p["last"]) for p in table_of]
    spark = keys.sparkSession
    routes = spark.createDataFrame([(p["part"], p["first"], p["last"], p["at"], p["length"]) for p in table_of], "part string, first string, last string, at long, length long")
    lasts = [b[1] for b in bounds]
    firsts = [b[0] for b in bounds]

    def routed(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key in pdf["key"]:
                i = bisect.bisect_left(lasts, key)
                while i < len(firsts) and firsts[i] <= key:
                    out.append((key, table_of_names[i]))
                    i += 1
            if out:
                yield pd.DataFrame(out, columns=["key", "part"])

    table_of_names = [p["part"] for p in table_of]
    sent = keys.select("key").distinct().mapInPandas(routed, "key string, part string").join(F.broadcast(routes), "part")

    def searched(batches):
        import pandas as pd

        store, path = _open(folder)
        part, name = None, None
        for pdf in batches:
            out = []
            for key, p, at, length in zip(pdf["key"], pdf["part"], pdf["at"], pdf["length"]):
                if p != name:
                    part, name = Part(store, f"{path}/{p}", int(at), int(length)), p
                out += part.find(key)
            if out:
                yield pd.DataFrame(out, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    # by number: AQE would join partitions of small rows, behind which the real work is reads of whole ranges
    n = max(len(table_of), spark.sparkContext.defaultParallelism)
    return sent.repartition(n, "part").sortWithinPartitions("part", "key").select("key", "part", "at", "length").mapInPandas(searched, INDEX)


def read_captures(found: DataFrame, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest (as the record says) and payload (null in revisits) of index lines."""

    def read(batches):
        import pandas as pd

        store, path = _open(folder)
        name, file = None, None
        for pdf in batches:
            out, size = [], 0
            for f, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"]):
                if f != name:
                    name, file = f, store.open_input_file(f"{path}/{f}")
                file.seek(int(offset))
                headers, payload = read_record(file.read(int(length)))
                page, ref = (None if x in (None, "None") else int(x) for x in (_urn(headers.get(k)) for k in ("warc-record-id", "warc-refers-to")))
                revisit = headers["warc-type"] == "revisit"
                out.append((page, headers["warc-type"], ref, headers["warc-payload-digest"].removeprefix("sha1:"), None if revisit else payload))
                size += len(payload)
                if size > 1 << 24:
                    yield _frame(out)
                    out, size = [], 0
            if out:
                yield _frame(out)

    def _frame(out):
        import pandas as pd

        return pd.DataFrame(out, columns=["page_id", "record_type", "refers_to", "payload_digest", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(found.sparkSession.sparkContext.defaultParallelism, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = found.repartition(n, "file").sortWithinPartitions("file", "offset")
    return placed.mapInPandas(read, "page_id long, record_type string, refers_to long, payload_digest string, payload binary")


def _urn(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<urn:page:").removesuffix(">")


def with_revisits(pages: DataFrame, least_bytes: int = 0, html: str = "html") -> DataFrame:
    """page_id, url, payload and refers_to: of equal payloads of at least least_bytes bytes, the largest page_id stands for all."""
    read = pages.select("page_id", "url", F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    hashed = read.withColumn("sha", F.sha2("payload", 256))
    first = hashed.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    joined = hashed.join(first.where("n > 1").select("sha", "response"), "sha", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = fresh(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    captures = write_archives(with_revisits(pages), folder)
    index = f"{folder}/index"
    parts = write_index(spark.read.parquet(_kept(captures, f"{folder}/captures")), index)
    parts = spark.read.parquet(_kept(parts, f"{folder}/parts"))
    wanted = pages.select(_key_udf()(F.col("url")).alias("key"))
    seen = read_captures(lookup(wanted, parts, index), folder)

    def digested(batches):
        for pdf in batches:
            sizes = [None if p is None else len(p) for p in pdf["payload"]]
            sums = [said if p is None else digest(p) for p, said in zip(pdf["payload"], pdf["payload_digest"])]
            yield pdf[["page_id", "record_type", "refers_to"]].assign(payload_bytes=_long(sizes, pdf), payload_digest=sums)

    def _long(values, pdf):
        import pandas as pd

        return pd.Series(values, index=pdf.index, dtype="Int64")

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    rows = spark.read.parquet(_kept(seen.mapInPandas(digested, schema), f"{folder}/seen"))
    responses = rows.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"), F.col("payload_digest").alias("sum"))
    responses = responses.dropDuplicates(["refers_to", "sum"]).withColumnRenamed("sum", "payload_digest")
    revisits = rows.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("?")))).cast("long")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*names).unionByName(revisits.withColumn("payload_bytes", F.coalesce("full", missing)).select(*names))


def _kept(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def _key_udf():
    @F.pandas_udf("string")
    def keyed(urls):
        return urls.map(url_key)

    return keyed


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL: dict[str, str] = {}
