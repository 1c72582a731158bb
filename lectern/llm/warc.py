"""WARC archives: indexed writing and coalesced byte-range reading (operator 8)."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import MAX_BROADCAST_IDS, read_table, written
from lectern.sources.scratch import scratch_path

MIN_REVISIT_BYTES = 100
#: Ranges of one file at most this far apart are read at once, in reads of at most MAX_READ bytes.
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
CRLF = b"\r\n"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def record_bytes(page_id, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to) -> bytes:
    """One gzip member holding one WARC/1.1 record; a revisit record has no block of its own."""
    revisit = refers_to is not None
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"\s", "%20", url or "")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("X-Payload-Length", str(n_bytes))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
        payload = b""
    fields.append(("Content-Length", str(len(payload))))
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + CRLF + payload + CRLF + CRLF) + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    return fields, rest[: int(fields["content-length"])]


def file_system(path: str):
    """(file system, path in it) for any store that Arrow knows: file, hdfs, s3, gs ..."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + re.sub("^file:", "", path))


def mark_revisits(pages: DataFrame) -> DataFrame:
    """pages plus n_bytes, digest and refers_to (the class's smallest page_id, for other pages of equal payloads)."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest"))
    # combined before the shuffle, so that a payload that a third of the pages share costs no task more; the join moves only ids and digests, and adaptive execution may split it
    first = keyed.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.count("page_id").alias("k")).where("n > 1 and k > 0")
    small = keyed.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).select("page_id", "digest").join(first.select("digest", "first"), "digest")
    again = small.where("page_id is null or page_id > first").groupBy(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest")).agg(F.min("first").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    again = written(again)  # about a hundred bytes a row: payloads stay where they are while these are few
    few = again.limit(MAX_BROADCAST_IDS // 5 + 1).count() <= MAX_BROADCAST_IDS // 5
    return keyed.join(F.broadcast(again) if few else again, same, "left").drop("again_id", "again_digest")


def write_archives(pages: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Writes a record per row into archives below ``path`` and returns the index, itself kept as Parquet.

    Each task writes one archive under a name of its own; the index is committed by Spark and names only
    archives of tasks that succeeded, so an archive that a lost executor left is never read.
    """
    marked = mark_revisits(pages)
    if files:
        marked = marked.repartition(files)

    def write(batches):
        import pyarrow as pa

        store = at = where = None
        name = f"{path}/pages-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if store is None:
                    store, where = file_system(name)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    store, at = store.open_output_stream(where, compression=None), 0
                data = record_bytes(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["n_bytes"], r["digest"], r["refers_to"])
                store.write(data)
                rows.append((r["page_id"], r["url"], name, at, len(data), r["digest"], "response" if r["refers_to"] is None else "revisit"))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 names=["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        if store is not None:
            store.close()

    return written(marked.mapInArrow(write, INDEX))


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, members) of reads that cover sorted (offset, length) ranges."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= MAX_GAP and offset + length - out[-1][0] <= MAX_READ:
            start, end, members = out[-1]
            out[-1] = (start, max(end, offset + length), [*members, i])
        else:
            out.append((offset, offset + length, [i]))
    return out


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the (possibly filtered) index names, by sorted byte ranges; digests are of the bytes read."""
    block = F.floor(F.col("offset") / F.lit(4 * MAX_READ))
    chosen = index.select("file", "offset", "length", block.alias("block")).repartition("file", "block").sortWithinPartitions("file", "offset")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            done = 0
            while done < len(rows):
                file, part = rows[done][0], []
                while done < len(rows) and rows[done][0] == file:
                    part.append(rows[done][1:])
                    done += 1
                store, where = file_system(file)
                with store.open_input_file(where) as f:
                    for start, end, members in coalesced(part):
                        data, out = f.read_at(end - start, start), []
                        for i in members:
                            o = part[i][0] - start
                            h, body = parse_record(data[o:o + part[i][1]])
                            ident = lambda x: None if x in (None, "<urn:page:null>") else int(x.strip("<>").rpartition(":")[2])
                            kind = h["warc-type"]
                            n, d = (len(body), hashlib.sha256(body).hexdigest()) if kind == "response" else (int(h["x-payload-length"]), h["warc-payload-digest"].rpartition(":")[2])
                            out.append((ident(h["warc-record-id"]), h["warc-target-uri"], kind, ident(h.get("warc-refers-to")), n, d, body.decode("utf-8", "surrogatepass") if with_payload else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                         names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return chosen.mapInArrow(read, RECORD)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as WARC and reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null url an empty one. Rows with a null or repeated page_id get
    records of their own (a null id names no response, and refers to one when its payload is another's).
    Payloads under 100 bytes never revisit. Extra columns are ignored. No pages, no archives, no rows.
    """
    index = write_archives(pages, path or scratch_path(pages.sparkSession))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(read_table(spark, sf_dir, "pages"))


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha256(body) as h from p),
c as (select h, min(page_id) as first from d where n >= 100 group by h)
select d.page_id, d.n::bigint as payload_bytes, d.h as payload_digest,
  case when c.first < d.page_id then 'revisit' else 'response' end as record_type,
  case when c.first < d.page_id then c.first end as refers_to
from d left join c on d.h = c.h
"""
