"""Expressions on edge cases, and parsers on hand-made bytes."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import formats, media, paths, values


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "want"), [("a/b.c.JPG", "jpg"), (".hidden", None), ("a/.jpg", None), ("a.b/c", None), ("x.", None), ("é/ü.PNG", "png")])
def test_extension(spark, path, want):
    assert one(spark, paths.extension("p"), p=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.c.JPG", "b.c"), (".hidden", ".hidden"), ("a/x", "x"), ("x.y", "x")])
def test_stem(spark, path, want):
    assert one(spark, paths.stem("p"), p=path) == want


@pytest.mark.parametrize(
    ("make", "model", "want"),
    [("Apple", "iPhone 15", "Apple iPhone 15"), ("Canon", "Canon EOS R5", "Canon EOS R5"), ("", "", "Unknown"), (None, "X/100", "X_100"), ("Sony", None, "Sony"), ("é", "", "_")],
)
def test_device(spark, make, model, want):
    assert spark.createDataFrame([(make, model)], "a string, b string").select(paths.device_name("a", "b")).first()[0] == want


def test_pipe_round_trip(spark):
    for p in ["a b:c", "a\\ b", "plain", " : "]:
        assert one(spark, paths.pipe_unescape(paths.pipe_escape("p")), p=p.replace("\\", "/")) == p.replace("\\", "/")


@pytest.mark.parametrize(("text", "want"), [("2024:05:01 10:20:30", 1714558830000), ("2024:02:30 00:00:00", None), ("junk", None), ("1969:12:31 23:59:59", -1000)])
def test_exif_time(spark, text, want):
    assert one(spark, values.exif_millis(F.col("p")), p=text) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1 << 40, "1.00 TB"), (1 << 51, "2048.00 TB")])
def test_bytes(spark, n, want):
    assert one(spark, values.format_bytes(F.col("p")), p=n) == want


def test_bytes_as_sql_prints_them(spark, tmp_path):
    """Keys whose squares pass a TB, and sums that lie halfway or next to it: as DuckDB's printf has them, which ends at GB."""
    import duckdb

    from tessera.plans.queries import ORACLES, QUERIES

    keys = [1, 31, 32, 1023, 1024, 32767, 32768, 1_048_575, 1_048_576, 8_999_999, 54_000_000, 94_906_267, 1_000_000_007, *range(1_048_000, 60_000_000, 99_991), *[k << 9 for k in range(1, 300)]]
    con = duckdb.connect()
    con.execute("create table orders as select unnest(?::bigint[]) as o_orderkey", [keys])
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    for name in ("format_bytes", "format_bytes_forms"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES[name]).fetchall())
    near = [k * 5**3 * (1 << b) // 1000 + e for k in (1001, 1003, 2005, 8195, 99995) for b in (20, 30, 40) for e in (-1, 0, 1)]
    got = spark.createDataFrame([(n,) for n in near], "n bigint").select("n", values.format_bytes(F.col("n")).alias("s")).collect()
    for r in got:
        k = max(i for i in range(5) if r.n >= 1024**i)
        assert r.s == f"{r.n / 1024**k:.2f} {'BKMGT'[k]}B", r


def test_fingerprint_regions(spark):
    small, large = b"hello", bytes(range(256)) * 1000
    head, tail = large[:65536], large[-65536:]
    want = {"jpg": head, "png": tail, "mov": head + tail, "dng": head + tail, "txt": large, "mkv": head}
    for ext, region in want.items():
        df = spark.createDataFrame([(large,), (small,), (b"",)], "c binary").select(values.fingerprint(F.col("c"), F.lit(ext)))
        twice = small * (2 if ext in ("mov", "dng") else 1)
        assert [r[0] for r in df.collect()] == [zlib.crc32(region), zlib.crc32(twice), 0]


def test_xxh3_is_little_endian(spark):
    import xxhash

    got = spark.createDataFrame([(b"abc",), (b"",), (None,)], "c binary").select(media.xxh3_128(F.col("c"))).collect()
    assert [r[0] and bytes(r[0]) for r in got] == [xxhash.xxh3_128(b"abc").digest()[::-1], xxhash.xxh3_128(b"").digest()[::-1], None]


def tiff(tags: dict[int, str], order="<") -> bytes:
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    entries, data, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, text in sorted(tags.items()):
        raw = text.encode() + b"\0"
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(data))
        entries += struct.pack(order + "HHI", tag, 2, len(raw)) + inline
        data += raw if len(raw) > 4 else b""
    return head + struct.pack(order + "H", len(tags)) + entries + bytes(4) + data


def test_exif_tags():
    body = tiff({0x010F: "Apple", 0x0110: "X", 0x9003: "2024:05:01 10:20:30"}, ">")
    app1 = b"Exif\0\0" + body
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda\0\x02"
    assert media.exif_tags(jpeg) == {"make": "Apple", "model": "X", "original": "2024:05:01 10:20:30"}
    assert media.exif_tags(tiff({0xA431: "CAM", 0xA420: "SHOT1"})) == {"serial": "CAM", "image_id": "SHOT1"}
    assert media.exif_tags(b"") == media.exif_tags(b"\xff\xd8\xff") == media.exif_tags(body[:20]) == {}


@pytest.mark.parametrize("version", [0, 1])
def test_mp4(spark, version):
    when = 3_800_000_000
    mvhd = bytes([version, 0, 0, 0]) + (struct.pack(">Q", when) if version else struct.pack(">I", when)) + bytes(20)
    box = struct.pack(">I4s", 8 + len(mvhd), b"mvhd") + mvhd
    data = struct.pack(">I4s", 8, b"free") + struct.pack(">I4sQ", 1, b"moov", 16 + len(box)) + box
    assert media.mp4_seconds(data) == when
    assert media.mp4_seconds(data[:20]) is None
    assert one(spark, values.quicktime_millis(F.lit(when))) == (when - 2_082_844_800) * 1000
    assert one(spark, values.quicktime_millis(F.lit(5))) is None


def test_formats(spark):
    assert formats.format_dimension(spark).count() == 19
    assert formats.format_dimension(spark, "raw").count() == 7
    assert one(spark, formats.mime_type(F.lit("m4v"))) == "video/mp4"
    assert one(spark, formats.format_name(F.lit("xyz"))) == "Unknown(xyz)"


@pytest.mark.parametrize(("path", "want"), [("/a/../../b", "/../b"), ("x/./y/../z", "/base/x/z"), ("", "/base"), ("/", "/"), (None, None), ("../..", "/.."), ("/é//ü/", "/é/ü")])
def test_lexical(spark, path, want):
    assert one(spark, paths.lexical(F.lit(path).cast("string"), "/base")) == want


def test_numbers_and_ranges(spark):
    assert one(spark, values.percent(F.lit(1), F.lit(3))) == 33
    assert one(spark, values.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, values.left_over(F.lit(2), F.lit(5))) == 0
    assert one(spark, values.bytes_per_second(F.lit(10), F.lit(0))) == 0
    data = bytes(range(200))
    for start, length in ((0, 10), (150, 100), (200, 5), (500, 5)):
        assert one(spark, values.range_crc(F.lit(data), start, length)) == zlib.crc32(data[start : start + length])
    assert one(spark, values.format_bytes(F.lit(1 << 50), 1, True)) == "1024.0 TiB"
    assert one(spark, paths.exif_text(F.lit("Apple\0\0"))) == "Apple"


def test_formats_may_be_added(spark):
    more = [("Orf", "orf", "raw", "image/x-olympus-orf", "head", [])]
    assert formats.format_dimension(spark, "raw", more).count() == 8
    assert one(spark, formats.is_supported(F.lit("JPG"))) and not one(spark, formats.is_supported(F.lit("jpg"), "raw"))
    assert not one(spark, formats.is_supported(F.lit(None).cast("string")))
