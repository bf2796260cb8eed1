"""Dates, sizes, counts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import region

GENESIS = "0" * 64
REGION_BYTES = 65536


def millis(ts: Column) -> Column:
    """Unix milliseconds of a timestamp, rounded down."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("long")


def exif_millis(text: Column) -> Column:
    """`yyyy:MM:dd HH:mm:ss`, as UTC; null if no such time exists. Any separators are taken."""
    t = F.regexp_replace(text, r"^(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).*$", "$1-$2-$3 $4:$5:$6")
    return F.unix_millis(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))


def taken_at(original: Column, modified: Column, mtime_ms: Column) -> Column:
    """When a picture was taken: its original date, else its date, else the file's time."""
    return F.timestamp_millis(F.coalesce(exif_millis(original), exif_millis(modified), mtime_ms))


def quicktime_millis(seconds: Column) -> Column:
    """QuickTime seconds (since 1904) as Unix milliseconds; null up to 1970."""
    offset = 2_082_844_800  # fixed value: seconds from 1904-01-01 to 1970-01-01
    return F.when(seconds > offset, (seconds - offset) * 1000)


def format_bytes(n: Column, decimals: int = 2, binary: bool = False, units: str = "KMGT") -> Column:
    """B as they are, then KB, MB, GB, TB (binary: KiB and so on) with decimals; statistics show two, listings one.

    The last of units takes all that is larger. What lies halfway goes to the even digit, by whole numbers: n counts as a double does.
    """
    n = n.cast("double")
    whole, ten = n.cast("long"), 10**decimals
    out = F.concat(whole.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        bits = 10 * k
        below = F.lit((1 << bits) - 1).cast("long")
        count, rest = F.shiftright(whole, bits), whole.bitwiseAND(below) * ten
        part, left = F.shiftright(rest, bits), rest.bitwiseAND(below)
        up = (left * 2 > below + 1) | ((left * 2 == below + 1) & ((count * ten + part) % 2 == 1))
        part = part + up.cast("int")
        text = (count + (part >= ten).cast("int")).cast("string")
        if decimals:
            text = F.concat(text, F.lit("."), F.lpad((part % ten).cast("string"), decimals, "0"))
        out = F.when(n >= 1024.0**k, F.concat(text, F.lit(f" {unit}iB" if binary else f" {unit}B"))).otherwise(out)
    return out


def format_count(n: Column) -> Column:
    """A count with commas between thousands."""
    return F.format_number(n, 0)


def left_over(a: Column, b: Column) -> Column:
    """a - b, not below 0."""
    return F.greatest(a - b, F.lit(0))


def difference(a: Column, b: Column) -> Column:
    """How far two numbers are apart."""
    return F.abs(a - b)


def percent(done: Column, total: Column) -> Column:
    """Whole percent of total, rounded down; 0 of nothing."""
    return F.when(total > 0, F.floor(done / total * 100)).otherwise(F.lit(0)).cast("int")


def bytes_per_second(n: Column, seconds: Column) -> Column:
    """0 before any time has passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def range_crc(content: Column, start: int, length: int) -> Column:
    """CRC-32 of the bytes of a range; of those that are there where content ends before it."""
    return F.crc32(F.substr(content, F.lit(start + 1), F.lit(length)))


def fingerprint(content: Column, ext: Column) -> Column:
    """CRC-32 of the format's region. A file shorter than the region gives head and tail twice."""
    head = F.substring(content, 1, REGION_BYTES)
    tail = F.substr(content, F.greatest(F.length(content) - REGION_BYTES, F.lit(0)) + 1, F.lit(REGION_BYTES))
    r = region(ext)
    return F.crc32(F.when(r == "head", head).when(r == "tail", tail).when(r == "head_tail", F.concat(head, tail)).otherwise(content))


def event_hash(occurred_at: Column, event_type: Column, entity_type: Column, entity_id: Column, payload: Column, prev_hash: Column) -> Column:
    """SHA-256 over the event's fields; its number is no part of it."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (occurred_at, event_type, entity_type, entity_id, payload, prev_hash)]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def identity(sha256: Column, xxh3: Column) -> Column:
    """A content's identity with its algorithm: SHA-256 if there, else XXH3-128; the two never compare equal."""
    return F.when(sha256.isNotNull(), F.struct(F.lit("sha256").alias("algo"), sha256.alias("hash"))).when(xxh3.isNotNull(), F.struct(F.lit("xxh3_128").alias("algo"), xxh3.alias("hash")))


def hex_lower(b: Column) -> Column:
    return F.lower(F.hex(b))
