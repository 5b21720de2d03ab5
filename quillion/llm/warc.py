"""WARC records and revisit resolution (operator 6).

A revisit record says that its payload is that of an earlier response, and names the payload's digest.
Headers alone are shuffled by digest: each digest's original is its earliest response, and revisit records join
it. The result is a deduplicated archive: each payload once, as a response, every other capture a revisit with
fresh headers.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import _columns
from quillion.plans.scratch import Scratch

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_577_836_800
HEADER = ("record_id", "type", "uri", "date", "digest")
#: Digests that are broadcast at most, of a few hundred bytes each, and rows of one digest that stay together.
FEW = 50_000
HOT = 1_000_000
RECORDS = "record_id string, type string, uri string, date string, digest string, payload binary"


def digest_of(payload: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(payload))


def from_pages(pages: DataFrame) -> DataFrame:
    """Captures as records `(record_id, type, uri, date, digest, payload, page_id)`, one for each page.

    Captured in the order of `page_id`, one a second. A page whose `html` is null is a revisit record as
    an archive holds it, without payload, of the same address's digest: that of its `url`, which nothing resolves.
    """
    payload = F.col("html").cast("binary")
    return pages.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(F.col("html").isNull(), "revisit").otherwise("response").alias("type"),
        F.coalesce("url", F.lit("")).alias("uri"),
        F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.coalesce(digest_of(payload), digest_of(F.coalesce("url", F.lit("")).cast("binary"))).alias("digest"),
        payload.alias("payload"),
        "page_id",
    )


def captured_again(pages: DataFrame, every: int = 4) -> DataFrame:
    """Revisit records as `from_pages` has records: each page with an id divisible by `every`, found unchanged a day later.

    A page with a null id is not captured again.
    """
    again = from_pages(pages.where(F.col("page_id") % every == 0))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH + 86_400) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return again.select(F.concat("record_id", F.lit(":again")).alias("record_id"), F.lit("revisit").alias("type"), "uri", date.alias("date"), "digest", F.lit(None).cast("binary").alias("payload"), "page_id")


def header(kind: Column, record_id: Column, uri: Column, date: Column, digest: Column, length: Column, to_id: Column, to_uri: Column, to_date: Column) -> Column:
    """The WARC 1.1 header block of a record, up to its blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), to_id, F.lit(">"))), line("WARC-Refers-To-Target-URI", to_uri), line("WARC-Refers-To-Date", to_date), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", digest),
        F.when(kind == "revisit", F.coalesce(refers, line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )


def _attach(rows: DataFrame, groups: DataFrame, few: int) -> DataFrame:
    """`rows` with what `groups` knows of their digest, by a left join on `digest`.

    Up to `few` groups, which are counted, go to the rows. Beyond that both sides meet by digest, and the rows of
    a digest of more than `HOT` rows in several parts; the list of such digests is at most one for `HOT` rows.
    """
    if groups.count() <= few:
        return rows.join(F.broadcast(groups.drop("rows")), "digest", "left")
    hot = groups.where(F.col("rows") > HOT).select("digest", F.ceil(F.col("rows") / HOT).alias("parts"))
    spread = rows.join(F.broadcast(hot), "digest", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / HOT) - 1))).drop("rows")
    return spread.join(copies, ["digest", "part"], "left").drop("part")


def resolve(records: DataFrame, few: int = FEW) -> DataFrame:
    """Records with `state`, `original_id`, a fresh `header` and the `payload` that the archive keeps.

    - A response that is the first of its digest, by date, then id, then uri, then further columns: `original`,
      with its payload. Of rows that repeat it in every column one is the original, the others are revisits
      of it, so that the archive has each payload once.
    - A later response, or a revisit, of a digest that has a response: `revisit`, that response's id in
      `original_id`, no payload. Responses are first whatever their date, since a revisit holds nothing.
    - A revisit whose digest no response has: `unresolved`, kept as a revisit without a reference.
    Records with a null digest or of another type are `other` and keep payload and type. A null payload counts as an
    empty one. Further columns stay, save those named like the result's; those of maps or nested types are no
    tie-breakers, and rows that differ only there are told apart by their JSON. Empty input gives an empty result.

    Only headers are shuffled. A response's payload moves only if its digest has several responses and there are more
    than `few` such digests.
    """
    base = [c for c in records.columns if c not in ("state", "original_id", "header", "n_bytes")]
    more = [c for c in base if c not in HEADER and c != "payload"]
    own = records.select(*[_columns.named(c) for c in (*HEADER, "payload")], *[_columns.named(c).alias(f"c{i}") for i, c in enumerate(more)])
    rest = [f"c{i}" for i in range(len(more))]
    plain = [F.col(c) if isinstance(own.schema[c].dataType, T.AtomicType) else F.to_json(F.struct(c)) for c in rest]
    key = F.struct("date", "record_id", "uri", *[x.alias(c) for x, c in zip(plain, rest)])
    scratch = Scratch(records.sparkSession, "revisits")
    known = own.where("digest is not null and type in ('response', 'revisit')")
    response = F.col("type") == "response"
    groups = scratch.keep(known.groupBy("digest").agg(F.min(F.when(response, key)).alias("first"), F.count_if(response).alias("responses"), F.count("*").alias("rows")))

    several = groups.where("responses > 1").select("digest", "first", "rows")
    same = known.where(response).select("digest", key.alias("key"))
    tied = scratch.keep(_attach(same, several, few).where("key = first").groupBy("digest").agg(F.count("*").alias("ties")).where("ties > 1"))
    several = scratch.keep(several.join(tied, "digest", "left"))

    revisit = F.coalesce((F.col("type") == "revisit") & F.col("digest").isNotNull(), F.lit(False))
    kept = _attach(own.where(~revisit), several, few)
    found = F.col("first").isNotNull()
    state = F.when(F.coalesce(~response, F.lit(True)) | F.col("digest").isNull(), "other").when(~found | key.eqNullSafe(F.col("first")), "original").otherwise("revisit")
    kept = kept.withColumn("state", state)
    if tied.take(1):
        many = kept.where("state = 'original' and ties is not null")
        # rows alike in every column become one row with their number, whichever executor has them, and that many rows again
        one = many.groupBy("digest", key.alias("key")).agg(F.count("*").alias("n"), F.first(F.struct(*many.columns)).alias("row"))
        again = one.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("turn"))
        again = again.withColumn("state", F.when(F.col("turn") == 1, "original").otherwise("revisit")).drop("turn")
        kept = kept.where("not (state = 'original' and ties is not null)").unionByName(again)
    kept = kept.drop("ties")
    lone = _attach(own.where(revisit), groups.where("first is null or rows > responses").select("digest", "first", "rows"), few)
    named = kept.unionByName(lone.withColumn("state", F.when(found, "revisit").otherwise("unresolved")))

    holds = F.col("state").isin("original", "other")
    payload = F.when(holds, F.coalesce("payload", F.lit(b""))).otherwise(F.lit(b""))
    kind = F.when(F.col("state") == "original", "response").when(F.col("state") == "other", F.col("type")).otherwise("revisit")
    to = F.when(F.col("state") == "revisit", F.col("first"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fresh = header(F.coalesce(kind, F.lit("")), text("record_id"), text("uri"), text("date"), text("digest"), F.octet_length(payload), to["record_id"], to["uri"], to["date"])
    place = {c: f"c{i}" for i, c in enumerate(more)}
    out = named.withColumn("header", fresh).withColumn("payload", payload).withColumn("original_id", to["record_id"])
    order = [c for c in base if c != "payload"]
    result = ["state", "original_id", "header", "payload"]
    return out.select(*[place.get(c, c) for c in order], *result).toDF(*order, *result)


def write_archive(resolved: DataFrame, path: str) -> DataFrame:
    """Write `.warc.gz` files, one for each partition, below `path`, a folder that all executors share; names and record counts.

    Every record is a gzip member of its own. A file is named after its partition and appears under its name when
    it is whole, so a task that runs again replaces its own file and no other.
    """
    os.makedirs(path, exist_ok=True)

    def run(it):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = os.path.join(path, f".{name}.{context.taskAttemptId()}")
        n = 0
        with open(draft, "wb") as f:
            for batch in it:
                for h, p in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                    f.write(gzip.compress(h.encode() + bytes(p) + b"\r\n\r\n", mtime=0))
                    n += 1
        if n:
            os.replace(draft, os.path.join(path, name))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["name", "n"])
        else:
            os.remove(draft)

    return resolved.select("header", "payload").mapInArrow(run, "name string, n long")


def parse(data: bytes) -> list[dict]:
    """The records of one archive file, gzipped or plain; a broken tail is left out."""
    if data[:2] == b"\x1f\x8b":
        out = bytearray()
        import zlib

        while data:
            d = zlib.decompressobj(31)
            try:
                out += d.decompress(data) + d.flush()
            except zlib.error:
                break
            data = d.unused_data
        data = bytes(out)
    found, at = [], 0
    while (m := re.compile(rb"\s*WARC/\d\.\d\r?\n").match(data, at)) is not None:
        end = re.compile(rb"\r?\n\r?\n").search(data, m.end())
        if not end:
            break
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[m.end() : end.start()].decode("utf-8", "replace").splitlines())}
        size = int(fields.get("content-length") or 0)
        if end.end() + size > len(data):
            break
        body = data[end.end() : end.end() + size]
        at = end.end() + size
        http = body.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else body
        digest = fields.get("warc-payload-digest") or (f"sha1:{hashlib.sha1(http).hexdigest()}" if fields.get("warc-type") == "response" else None)
        found.append({"record_id": fields.get("warc-record-id", "").strip("<>"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri", ""), "date": fields.get("warc-date", ""), "digest": digest, "payload": http})
    return found


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archive files below `path`."""

    def run(it):
        for batch in it:
            for data in batch.column(0):
                rows = parse(data.as_py())
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.binary() if k == "payload" else pa.string()) for k in ("record_id", "type", "uri", "date", "digest", "payload")]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)
