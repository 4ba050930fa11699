"""WARC archives: records written by Spark, read back as splits, and deduplicated by revisit resolution.

1. `write_archives`: a response record for each row, one gzip member a record, through Spark's text writer and so on any store
   that Spark can write to. A member ends in the highest byte of its length, which is zero below 16 MiB: that byte is the writer's
   line separator. Longer records are written apart, with their own last byte as separator. No member holds MAGIC but at its start;
   a record gets a field more (X-Fill) where nothing else helps.
2. `read_archives`: the files as lines that end at MAGIC, the first bytes of a gzip member, so that a large archive is read by
   many tasks and a task holds a record at a time. A record is decoded, and its payload is hashed.
3. `deduplicated`: headers, without payloads, are shuffled by payload digest, after a partial maximum in each task; that of
   equal payloads with the largest id stays a response. Decisions are joined to the compressed members by record id, and new
   archives are written with fresh headers: responses whole, the others as revisit records that name their original.
4. `resolved`: headers of such archives, where each revisit is joined to its original response by payload digest. A digest with
   many revisits is dealt to several tasks.

SHA-1 names a payload in the records; equality is decided by SHA-256.

Defined results: a null text is an empty payload; rows without id have no id header, come before all others where the largest id is
looked for, and read back as null; of equal payloads and ids the record with the greatest record id is the response; line breaks in
an address are written as %0D and %0A, a null address leaves the header out. An empty table gives an archive without records. A
record of any length is one member, but a row cannot pass Spark's limit of 2 GB. A revisit whose original is in none of the archives
resolves to null. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from .common import lookup, release, table, text_of, workdir, written

#: The first three bytes of a gzip member that holds deflated data.
MAGIC = b"\x1f\x8b\x08"
#: The archives carry no capture times of their own in `pages`.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
END = "\r\n"
_HEAD = "record_id string, record_type string, page_id string, uri string, date string, refers_to_id string, declared string, payload_bytes bigint, sha1 string, sha256 binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as upper-case base32, in built-in functions: 40 bits are ten hexadecimal and eight base-32 digits."""
    hexed = F.sha1(data)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(record: bytes, level: int = LEVEL) -> bytes:
    """The record as one gzip member in which MAGIC stands at the start only."""
    for setting in [(level, 8), *[(a, b) for a in range(9, 0, -1) for b in (9, 7, 6)]]:
        packer = zlib.compressobj(setting[0], zlib.DEFLATED, 31, setting[1])
        out = packer.compress(record) + packer.flush()
        if out.find(MAGIC, 1) < 0:
            return out
    raise ValueError("no setting gives a member without the first bytes of a member in it")


def filled(record: bytes, number: int) -> bytes:
    """The record with one more field, which says nothing, behind its version."""
    version, _, rest = record.partition(END.encode())
    return version + f"{END}X-Fill: {number}{END}".encode() + rest


def record_member(record: bytes, level: int = LEVEL) -> bytes:
    """The WARC record as a member. A member ends in the record's CRC and length, whatever the setting of the compressor: where these
    hold MAGIC (lengths of 2,187 bytes and CRCs that end in 1F are the usual case, about one record in a million), a field is added."""
    for number in range(64):
        try:
            return member(filled(record, number) if number else record, level)
        except ValueError:
            continue
    return member(record, level)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").split(END)
    return lines[0], {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


def header(fields: dict[str, str | None]) -> bytes:
    return "".join(["WARC/1.1", END, *[f"{k}: {v}{END}" for k, v in fields.items() if v is not None], END]).encode("utf-8", "surrogatepass")


def parsed(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not sep or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    block = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        return fields, http + b"\r\n\r\n", payload
    return fields, b"", block


def described(record: bytes) -> tuple:
    """The columns of _HEAD: what the header says and what the payload is. A revisit has no payload of its own."""
    fields, _, payload = parsed(record)
    kind, empty = fields.get("warc-type"), fields.get("warc-type") == "revisit"
    sha1 = None if empty else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    declared = (fields.get("warc-payload-digest") or "").rpartition(":")[2] or None
    page, refers = fields.get("x-page-id"), fields.get("warc-refers-to")
    return fields.get("warc-record-id"), kind, page, fields.get("warc-target-uri"), fields.get("warc-date"), refers, declared, None if empty else len(payload), sha1, None if empty else hashlib.sha256(payload).digest()


def members(lines: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Member and its record, from what stands between the MAGICs of a split.

    A MAGIC within a member, which archives written here do not have, has cut it: the parts are put together again.
    """
    held = b""
    for line in lines:
        if not line and not held:
            continue
        held = held + MAGIC + line if held else MAGIC + line
        unpacker = zlib.decompressobj(31)
        try:
            record = unpacker.decompress(held)
        except zlib.error as e:
            raise ValueError("a split of the archive starts within a record") from e
        if unpacker.eof:
            yield held, record
            held = b""
    if held:
        raise ValueError("a split of the archive ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """member, the gzip members of archives that hold one record in each; lines may come in any number of splits."""
    return spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("line"))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _HEAD.split(", ")]
    rows: list[tuple] = []
    for _, record in members(x.as_py() for batch in batches for x in batch.column(0)):
        rows.append(described(record))
        if len(rows) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The columns of _HEAD for each record of the archives, without payloads."""
    return read_archives(spark, path).mapInArrow(_heads, _HEAD)


def _named_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held, size = [], [], 0
    for packed, record in members(x.as_py() for batch in batches for x in batch.column(0)):
        ids.append(_fields(record.partition(b"\r\n\r\n")[0])[1].get("warc-record-id"))
        held.append(packed)
        size += len(packed)
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(held, pa.binary())], names=["record_id", "member"])
            ids, held, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(held, pa.binary())], names=["record_id", "member"])


def _lines(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Members without their last byte, which is `top`."""
    body, top, size = [], [], 0
    for record in records:
        packed = record_member(record)
        body.append(packed[:-1])
        top.append(packed[-1])
        size += len(packed)
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), pa.array(top, pa.int32())], names=["body", "top"])
            body, top, size = [], [], 0
    if body:
        yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), pa.array(top, pa.int32())], names=["body", "top"])


def _saved(lines: DataFrame, path: str) -> None:
    """body and top as archive files. Records of 16 MiB or more, if there are any, go to files of their own."""
    seen = Observation()
    lines = lines.observe(seen, F.max("top").alias("top"))
    put = lambda top: lines.where(F.col("top") == top).select(F.col("body").cast("string").alias("value")).write.mode("append").option("encoding", "ISO-8859-1").option("lineSep", chr(top)).text(path)
    put(0)
    for top in range(1, (seen.get["top"] or 0) + 1):
        put(top)


def _urn(name: Column) -> Column:
    """A record id made from a name."""
    h = F.md5(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(rows: DataFrame, path: str, key: str = "page_id", uri: str = "url", text: str = "html", date: str = DATE) -> None:
    """A response record for each row; the payload is the text in UTF-8. Headers are put together by built-in functions."""
    payload = text_of(text).cast("binary")
    address = F.replace(F.replace(F.col(uri).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    made = rows.select(F.col(key).cast("string").alias("k"), address.alias("u"), payload.alias("p"), F.monotonically_increasing_id().alias("place"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("p").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    made = made.withColumn("http", http)
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: response{END}"),
        line("WARC-Record-ID", _urn(F.concat_ws("\n", F.coalesce("k", F.lit("")), F.col("place")))),
        F.lit(f"WARC-Date: {date}{END}"),
        line("WARC-Target-URI", F.col("u")),
        line("X-Page-ID", F.col("k")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("p")))),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", (F.octet_length("http") + F.octet_length("p")).cast("string")),
        F.lit(END),
    )
    record = F.concat(head.cast("binary"), F.col("http").cast("binary"), F.col("p"), F.lit(b"\r\n\r\n"))
    _saved(made.select(record.alias("record")).mapInArrow(lambda batches: _lines(x.as_py() for b in batches for x in b.column(0)), "body binary, top int"), path)


def decisions(heads: DataFrame, kind: str = "bigint", least: int = 0) -> DataFrame:
    """record_id, and target_id, target_uri and target_date, the original of what becomes a revisit (else null).

    heads: of archives. Among responses with equal payloads of at least `least` bytes that with the largest page id is the original; a
    record that is a revisit already refers to the original with its digest, if there is one.
    """
    page = F.col("page_id").cast(kind).alias("page")
    response = heads.where((F.col("record_type") == "response") & F.col("sha256").isNotNull() & (F.col("payload_bytes") >= least))
    # Only records that share their payload are looked up: the others stay as they are.
    best = response.groupBy("sha256").agg(F.max(F.struct(page, "record_id", "uri", "date")).alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    best = best.select("sha256", "m", F.col("best.record_id").alias("target_id"), F.col("best.uri").alias("target_uri"), F.col("best.date").alias("target_date"))
    total = heads.count()
    found = lookup(response.select("record_id", "sha256"), best.drop("m"), ["sha256"], best.select("sha256", "m"), total, ["record_id"]).where("record_id != target_id").drop("sha256")
    old = heads.where("record_type = 'revisit' and declared is not null").select("record_id", F.col("declared").alias("sha1"))
    if old.isEmpty():
        return found
    sizes = old.groupBy("sha1").agg(F.count(F.lit(1)).alias("m"))
    first = response.join(sizes.select("sha1"), "sha1", "left_semi").groupBy("sha1").agg(F.max(F.struct(page, "record_id", "uri", "date")).alias("b"))
    first = first.select("sha1", F.col("b.record_id").alias("target_id"), F.col("b.uri").alias("target_uri"), F.col("b.date").alias("target_date"))
    return found.unionByName(lookup(old, first, ["sha1"], sizes, total, ["record_id"]).drop("sha1"))


def fresh_id(record_id: str) -> str:
    """The id of the new record that is made from a record."""
    h = hashlib.md5(f"fresh\n{record_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def renewed(record: bytes, target: tuple[str, str | None, str | None] | None) -> bytes:
    """The record with a fresh header; a revisit of target (record id, address, date), without payload, if there is one."""
    fields, http, payload = parsed(record)
    old = fields.get("warc-type") == "revisit"
    digest = (fields.get("warc-payload-digest") or "").rpartition(":")[2] if old else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = old or target is not None
    block = http if revisit else http + payload
    new = header(
        {
            "WARC-Type": "revisit" if revisit else fields.get("warc-type"),
            "WARC-Record-ID": fresh_id(fields.get("warc-record-id", "")),
            "WARC-Date": fields.get("warc-date"),
            "WARC-Target-URI": fields.get("warc-target-uri"),
            "X-Page-ID": fields.get("x-page-id"),
            "WARC-Payload-Digest": f"sha1:{digest}" if digest else None,
            "WARC-Profile": PROFILE if revisit else None,
            "WARC-Refers-To": fresh_id(target[0]) if target else None,
            "WARC-Refers-To-Target-URI": target[1] if target else None,
            "WARC-Refers-To-Date": target[2] if target else None,
            "Content-Type": fields.get("content-type"),
            "Content-Length": str(len(block)),
        }
    )
    return new + block + b"\r\n\r\n"


def _renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            for packed, *target in zip(*(batch.column(c) for c in ("member", "target_id", "target_uri", "target_date")), strict=True):
                to = [x.as_py() for x in target]
                yield renewed(zlib.decompress(packed.as_py(), 31), tuple(to) if to[0] is not None else None)

    yield from _lines(records())


def deduplicated(spark: SparkSession, source: str, path: str, kind: str = "bigint", least: int = 0) -> None:
    """Archives at path of the records of the archives at source: of equal payloads one response, the others revisits."""
    folder = workdir(spark, "warc")
    heads = written(headers(spark, source), f"{folder}/headers")
    decided = written(decisions(heads, kind, least), f"{folder}/decisions")
    release(spark)
    named = read_archives(spark, source).mapInArrow(_named_members, "record_id string, member binary")
    # Compressed members are dealt out by record id, of which there is one a record; the decisions, which are short, are the hashed side.
    whole = named.join(decided.hint("shuffle_hash"), "record_id", "left").select("member", "target_id", "target_uri", "target_date")
    _saved(whole.mapInArrow(_renewed, "body binary, top int"), path)


def resolved(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, uri and record_id of each record of deduplicated archives."""
    heads = written(headers(spark, path), f"{workdir(spark, 'warc')}/headers")
    page = F.col("page_id").cast(kind).alias("page_id")
    plain = heads.where("record_type != 'revisit'").select(page, "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"), "uri", "record_id")
    revisit = heads.where("record_type = 'revisit'").select(page, F.coalesce("declared", F.lit("")).alias("payload_digest"), F.col("refers_to_id").alias("original"), "record_type", "uri", "record_id")
    by = revisit.groupBy("payload_digest", "original").agg(F.count(F.lit(1)).alias("m"))
    # Only originals are looked up, not all responses.
    wanted = by.select(F.col("original").alias("record_id")).where("record_id is not null").distinct()
    first = heads.where("record_type = 'response'").join(wanted, "record_id", "left_semi").select(F.col("sha1").alias("payload_digest"), F.col("record_id").alias("original"), "payload_bytes", page.alias("refers_to"))
    found = lookup(revisit, first, ["payload_digest", "original"], by.groupBy("payload_digest").agg(F.sum("m").alias("m")), heads.count(), ["record_id"], "left")
    return plain.unionByName(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "record_id"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), workdir(spark, "archives")
    kind = pages.schema["page_id"].dataType.simpleString()
    write_archives(pages, f"{folder}/raw")
    deduplicated(spark, f"{folder}/raw", f"{folder}/deduplicated", kind)
    return resolved(spark, f"{folder}/deduplicated", kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no SHA-1 as bytes or base32: the digest comes from its hexadecimal text, ten digits at a time.
ORACLE_SQL = """WITH p AS (
  SELECT page_id, row_number() OVER () AS rid, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT rid, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM p
), o AS (
  SELECT p.*, first_value(rid) OVER w AS keep, first_value(page_id) OVER w AS kept FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST, rid)
)
SELECT o.page_id, CAST(strlen(o.body) AS BIGINT) AS payload_bytes, d.payload_digest, CASE WHEN o.rid = o.keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN o.rid = o.keep THEN NULL ELSE o.kept END AS refers_to
FROM o JOIN d USING (rid)"""
