"""Records whose CRC and length, as they end a gzip member, hold the first bytes of a member."""

import zlib

from pyspark.sql import functions as F

from driftline.llm import warc


def records(spark, path):
    return [r for _, r in warc.members(bytes(row["line"]) for row in warc.read_archives(spark, path).coalesce(1).collect())]


def pages(spark, n, size):
    html = F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("a" * (size - 6)))
    return spark.range(1000, 1000 + n, 1, 2).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), html.alias("html"))


def test_every_record_can_be_written(spark, tmp_path):
    warc.write_archives(pages(spark, 1, 1600), f"{tmp_path}/one")
    size = 1600 + 2187 - len(records(spark, f"{tmp_path}/one")[0])
    rows = pages(spark, 3000, size)
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    warc.write_archives(rows, f"{tmp_path}/all")
    found = records(spark, f"{tmp_path}/all")
    odd = [r for r in found if len(r) != 2187]
    assert len(found) == 3000 and 0 < len(odd) < 60 and all(b"X-Fill: " in r for r in odd)
    # Without the field each of them has MAGIC in the last eight bytes of any member.
    for r in odd:
        fill = r[r.index(b"X-Fill") :].partition(b"\r\n")[0] + b"\r\n"
        plain = r.replace(fill, b"", 1)
        assert len(plain) == 2187 and warc.MAGIC in zlib.crc32(plain).to_bytes(4, "little") + len(plain).to_bytes(4, "little")
        assert warc.parsed(r)[2] == warc.parsed(plain)[2]
    got = warc.op12_warc(spark, str(tmp_path))
    assert got.where(f"record_type = 'response' and payload_bytes = {size}").count() == 3000
