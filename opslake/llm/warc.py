"""WARC archives with revisit records.

Method. Headers (no payloads) are shuffled by payload digest; in each group of equal payloads
the record with the smallest id is the original, the others are revisits and are joined to it.
Archives are then written anew with fresh headers: responses carry the payload, revisits name
the original. Reading resolves revisits the same way: headers by digest, joined to originals.

Archives are text files of Spark's writer, gzip over the whole file: a record is its header
block and payload, and the record separator (two line ends) is the writer's line separator, so
files are committed task by task. The reader goes by ``Content-Length``, so payloads may hold any
text. It unpacks a file as a stream; one record at a time is in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.llm.common import keep, numbered, utf8_length
from opslake.plans.session import scratch_path

#: Smaller payloads are never stored as revisits.
LEAST_BYTES = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_PER_BATCH = 1000


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Header row of every page: _row, page, url, digest, bytes; a null payload is empty."""
    body = F.coalesce(F.col("_body"), F.lit(""))
    rows = numbered(pages.select(pages[id_col].alias("page"), pages[url_col].alias("url"), pages[body_col].alias("_body")), "page")
    return rows.select("_row", F.col("page").cast("long").alias("page"), "url", F.sha2(body, 256).alias("digest"),
                       utf8_length(body).alias("bytes"), body.alias("body"))


def resolve(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """_row and refers_row, refers_to, of the headers that are revisits.

    The original of a digest is the record with the smallest page, then the smallest row; a null
    page comes last. Originals are kept before the join, so that both sides are plain shuffles
    and the records of one payload can be split over tasks.
    """
    large = heads.filter(F.col("bytes") >= least_bytes)
    order = F.struct(F.col("page").isNull(), "page", "_row")
    first = keep(large.groupBy("digest").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "digest", F.col("o._row").alias("refers_row"), F.col("o.page").alias("refers_to")), "originals")
    return large.select("_row", "digest").join(first, "digest").filter("_row <> refers_row").select(
        "_row", "refers_row", "refers_to")


def _uuid(digest: Column, row: Column) -> Column:
    """Record id from payload and row, so that a retried task writes the same one."""
    h = F.md5(F.concat_ws(":", digest, row))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws(
        "-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)))


def _clean(text: Column) -> Column:
    """Header values hold no line ends."""
    return F.regexp_replace(text, "[\r\n]+", " ")


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One text per record, header block and payload."""
    all_rows = pages.join(revisits, "_row", "left")
    again = F.col("refers_row").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _uuid(F.col("digest"), F.col("_row")), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        optional("WARC-Target-URI", _clean(F.col("url"))),
        optional("WARC-Page-ID", F.col("page").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<"), _uuid(F.col("digest"), F.col("refers_row")), F.lit(">"))),
        )).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(CRLF))
    return all_rows.select(F.concat(head, F.when(again, "").otherwise(F.col("body"))).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id",
          url_col: str = "url", body_col: str = "html") -> str:
    """Deduplicated archives of all pages under ``path``."""
    heads = headers(pages, id_col, url_col, body_col)
    revisits = resolve(heads.drop("body", "url"), least_bytes)
    records(heads, revisits).write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)
    return path


def parse(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and payloads of the records of a byte stream."""
    have = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        have.extend(block or b"")
        return block is not None

    while True:
        while have[:2] == b"\r\n" or (len(have) < 2 and more()):
            if have[:2] == b"\r\n":
                del have[:2]
        if not have:
            return
        at = 0
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(have) - 3)
            if not more():
                raise ValueError("a WARC header without an end")
        lines = bytes(have[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        while len(have) < end + 4 + size:
            if not more():
                raise ValueError("a WARC payload is cut off")
        yield head, bytes(have[end + 4:end + 4 + size])
        del have[:end + 4 + size]


def _unpacked(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Pieces of a file, gunzipped (one member or many) if it is gzip."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i:i + step] for i in range(0, len(content), step))
        return
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        rest = content[at:at + step]
        while not member.eof and (rest or at < len(content)):
            yield member.decompress(rest, 1 << 20)
            if member.eof:
                break
            rest = member.unconsumed_tail
            if not rest:
                at += step
                rest = content[at:at + step]
        at = at + len(content[at:at + step]) - len(member.unused_data) if member.eof else len(content)


FIELDS = "page long, url string, type string, record_id string, refers_id string, digest string, bytes long, file string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives under ``path``: fields of the header, and bytes and digest of the payload as read.

    A revisit's digest is the one its header states. With ``payloads`` the texts come along.
    """
    import hashlib

    schema = FIELDS + (", body string" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            cols = list(zip(*rows))
            kinds = [pa.int64() if n in ("page", "bytes") else pa.string() for n in names]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows = []
                for head, body in parse(_unpacked(content.as_py())):
                    revisit = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                    page = head.get("warc-page-id")
                    row = (int(page) if page is not None else None, head.get("warc-target-uri"), head["warc-type"],
                           head["warc-record-id"], head.get("warc-refers-to"), digest, len(body), file)
                    rows.append((*row, body.decode("utf-8", "replace")) if payloads else row)
                    if len(rows) >= ROWS_PER_BATCH:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.mapInArrow(fold, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Records with revisits joined to their originals by payload digest.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page of the original).
    """
    originals = found.filter("type = 'response'").select(
        "digest", F.col("record_id").alias("refers_id"), F.col("page").alias("refers_to"), F.col("bytes").alias("full"))
    again = found.filter("type = 'revisit'").join(originals, ["digest", "refers_id"], "left")
    cols = [F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
            F.col("type").alias("record_type")]
    return found.filter("type <> 'revisit'").select(*cols, F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.withColumn("bytes", F.col("full")).select(*cols, "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as deduplicated archives and read back, one row per page.

    A null payload is empty; equal rows are one response and revisits; a null page id stays null;
    an empty table gives no rows. Payloads are written and read whole.
    """
    path = write(pages, scratch_path(pages.sparkSession, "warc"))
    return resolved(read(pages.sparkSession, path))


SQL = f"""
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest,
                  cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages),
r as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {LEAST_BYTES} and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {LEAST_BYTES} and page_id <> first_id then first_id end as refers_to
from r"""
