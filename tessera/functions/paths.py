"""Paths as data: parts, templates, device names, containment, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unix_path(path: Column | str) -> Column:
    """Backslashes become slashes, and one leading slash goes."""
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), "^/", "")


def clean_root(path: Column | str, keep_root: bool = False) -> Column:
    """A root without trailing quotes and separators; with keep_root, what would be empty is '/'."""
    out = F.regexp_replace(F.trim(_c(path)), r"""[\\/"']+$""", "")
    return F.when(out == "", F.lit("/")).otherwise(out) if keep_root else out


def lexical(path: Column | str, base: str = "/") -> Column:
    """An absolute path without `.` and with each `..` taken back one component; links aren't followed.

    A relative path starts at base. A `..` with nothing before it stays.
    """
    p = _c(path)
    whole = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))

    def step(kept: Column, x: Column) -> Column:
        back = (x == "..") & (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("..")) != "..")
        return F.when(back, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension of the last component, null if there is none; a dot-file has none."""
    found = F.regexp_extract(_c(path), r"[^/]\.([^./]*)$", 1)
    return F.lower(F.when(found != "", found))


def extension_after_first_dot(path: Column | str) -> Column:
    """All after the path's first dot, in lower case; null without a dot. Statistics group by this."""
    p = _c(path)
    return F.when(F.instr(p, ".") > 0, F.lower(F.substr(p, F.instr(p, ".") + 1)))


def stem(path: Column | str) -> Column:
    """The last component without its extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def is_inside(path: Column | str, root: Column | str) -> Column:
    """Containment by whole components; the root itself counts as inside."""
    return (_c(path) == _c(root)) | F.startswith(_c(path), F.concat(_c(root), F.lit("/")))


def relative_to(path: Column | str, root: Column | str) -> Column:
    """path as shown under root: without the root where it is inside, otherwise as it is."""
    p, r = _c(path), _c(root)
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).otherwise(p)


def device_name(make: Column | str, model: Column | str) -> Column:
    """Folder name of a camera: the model, after its make unless it begins with it; Unknown if both are empty."""
    mk, md = F.trim(F.coalesce(_c(make), F.lit(""))), F.trim(F.coalesce(_c(model), F.lit("")))
    both = F.when(md == "", mk).when(mk == "", md).when(F.startswith(F.lower(md), F.lower(mk)), md).otherwise(F.concat_ws(" ", mk, md))
    safe = F.trim(F.regexp_replace(both, "[^A-Za-z0-9 _-]", "_"))
    return F.when(safe == "", F.lit("Unknown")).otherwise(safe)


def exif_text(value: Column | str) -> Column:
    """An EXIF ASCII value without its NUL padding and outer spaces."""
    return F.trim(F.regexp_replace(_c(value), "^\\x00+|\\x00+$", ""))


def raw_text(serial: Column | str, image: Column | str) -> Column:
    """serial:image with what is missing left empty; null if both are."""
    s, i = _c(serial), _c(image)
    return F.when(s.isNotNull() | i.isNotNull(), F.concat(F.coalesce(s, F.lit("")), F.lit(":"), F.coalesce(i, F.lit(""))))


def raw_fingerprint(serial: Column | str, image: Column | str) -> Column:
    """serial:image if both are there after outer spaces and quotes are gone, otherwise null."""

    def clean(x):
        return F.regexp_replace(F.regexp_replace(F.trim(_c(x)), '^"+|"+$', ""), "^'+|'+$", "")

    s, i = clean(serial), clean(image)
    return F.when((s != "") & (i != ""), F.concat_ws(":", s, i))


def destination(path: Column | str, taken_at: Column, device: Column, template: str) -> Column:
    """The template with $year $mon $day $device $filename $stem $ext replaced, one after the other."""
    out = F.lit(template)
    for name, value in (
        ("$year", F.date_format(taken_at, "yyyy")),
        ("$mon", F.date_format(taken_at, "MM")),
        ("$day", F.date_format(taken_at, "dd")),
        ("$device", device),
        ("$filename", file_name(path)),
        ("$stem", stem(path)),
        ("$ext", F.coalesce(extension(path), F.lit(""))),
    ):
        out = F.replace(out, F.lit(name), value)
    return out


def date_in_path(path: Column | str) -> Column:
    """The day that yyyy/MM-dd/... stands for; null for other paths and days that don't exist."""
    parts = F.split(_c(path), "/")
    year, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    fits = (F.length(year) == 4) & (F.length(rest) == 5) & F.contains(rest, F.lit("-"))
    return F.when(fits, F.try_to_date(F.concat(year, F.lit("-"), rest), "yyyy-MM-dd"))


def pipe_escape(path: Column | str) -> Column:
    return F.replace(F.replace(_c(path), F.lit(" "), F.lit("\\ ")), F.lit(":"), F.lit("\\:"))


def pipe_unescape(text: Column | str) -> Column:
    return F.replace(F.replace(_c(text), F.lit("\\:"), F.lit(":")), F.lit("\\ "), F.lit(" "))


def burst_prefix(name: Column | str) -> Column:
    """What stands before a name's trailing digits; null if it has none."""
    return F.when(_c(name).rlike("[0-9]$"), F.regexp_extract(_c(name), r"^(.*?)(\d+)$", 1))


def burst_number(name: Column | str) -> Column:
    """The trailing digits as a number; 0 if they are beyond a long."""
    digits = F.regexp_extract(_c(name), r"^(.*?)(\d+)$", 2)
    return F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(0)))
