"""Scalar functions on strings, paths, dates and boxes, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlane.functions.spans import FLAGS, as_column

MONTHS = "January February March April May June July August September October November December".split()


def strip(c: Column | str) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(as_column(c), r"(?U)\s+", " "))


def shown(c: Column | str) -> Column:
    """A matched text for display: white space collapsed; if nothing is left, quoted with its escapes."""
    c = as_column(c)
    raw = F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")), F.lit("'"))
    return F.when(collapse(c) == "", raw).otherwise(collapse(c))


def pad(c: Column | str, n: int) -> Column:
    """Spaces to the right up to n characters; longer text stays whole."""
    c = as_column(c)
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(n) - F.length(c))))


def lines(c: Column | str) -> Column:
    """A text's lines; no empty one after the last break."""
    parts = F.split(as_column(c), r"\R|[\x1c-\x1e]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def sanitize(c: Column | str) -> Column:
    """A pseudonym as part of a file name; nothing left gives REDACTED."""
    safe = F.regexp_replace(F.regexp_replace(as_column(c), "[^a-zA-Z0-9_.-]+", "_"), "_+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(safe == "", "REDACTED").otherwise(safe)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last extension with its dot; none for a name that begins or ends with its only dot."""
    return F.regexp_extract(file_name(path), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1)


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def path_order(path: Column | str) -> Column:
    """Sort key that compares paths by component."""
    return F.split(as_column(path), "/")


def stamped(path: Column | str, stamp: str) -> Column:
    """A time stamp before the extension, or at the end without one."""
    path, ext = as_column(path), suffix(path)
    return F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(ext)), F.lit(f"-{stamp}"), ext)


URL = FLAGS + r"https?://\S+"


def host(url: Column | str) -> Column:
    """Lower-case host without user, port or brackets; empty if there is none."""
    u = strip(url)
    v6 = F.regexp_extract(u, FLAGS + r"^https?://(?:[^/?#]*@)?\[([^\]]*)\]", 1)
    return F.lower(F.when(v6 != "", v6).otherwise(F.regexp_extract(u, FLAGS + r"^https?://(?:[^/?#]*@)?([^/:?#\[]+)", 1)))


def url_label(url: Column | str) -> Column:
    """The host's last but one part: the word that names the service."""
    parts = F.filter(F.split(F.regexp_replace(host(url), "[^.a-z0-9-]+$", ""), "[.]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(1)), F.lit(""))


def url_token(url: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """'[<label> URL]', the label's alias if it has one, '[URL]' without a host."""
    label = url_label(url)
    inner = label
    for name, alias in sorted((aliases or {}).items()):
        inner = F.when(label == name.lower(), alias.strip("[]").strip() or name.lower()).otherwise(inner)
    return F.when(label == "", "[URL]").otherwise(F.concat(F.lit("["), inner, F.lit(" URL]")))


def norm_heading(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_column(c)), "[^a-z ]", " ")


def fix_ocr(c: Column | str) -> Column:
    """A lone | is the letter I; so is l before 've, 'm, 'll or 'd."""
    c = F.regexp_replace(as_column(c), r"(?U)(?<!\S)[|](?!\S)", "I")
    return F.regexp_replace(c, r"(?U)\bl(?=['’](?:d|m|ll|ve)\b)", "I")


def date_of(name: Column | str) -> Column:
    """struct<year, month, label> of a stem with 20YY-M or 20YY_M; (0, 0, stem) without."""
    name = as_column(name)
    p = "(20[0-9]{2})[_-]([0-9]{1,2})"
    y, m = F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2)
    month = F.when(m == "", 0).otherwise(m.try_cast("int"))
    word = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.when((month >= 1) & (month <= 12), month).otherwise(13))
    label = F.when(y == "", name).otherwise(F.coalesce(F.concat(word, F.lit(" "), y), name))
    return F.struct(F.when(y == "", 0).otherwise(y.try_cast("int")).alias("year"), month.alias("month"), label.alias("label"))


_DAY = r"(\p{Lu}\p{Ll}{2,8}[.]?\s+[0-9]{1,2},\s*[0-9]{4})"


def review_period(c: Column | str) -> Column:
    """'Mon D, YYYY – Mon D, YYYY' where the text has two such dates joined by a dash; else null."""
    p = rf"(?U){_DAY}\s*[—–-]\s*{_DAY}"
    a, b = (F.regexp_extract(as_column(c), p, i) for i in (1, 2))
    return F.when(a != "", F.concat(a, F.lit(" – "), b))


def iso_time(epoch: Column | str) -> Column:
    """Seconds since 1970 as an ISO time in the session's zone; microseconds only when there are some."""
    t = F.timestamp_seconds(as_column(epoch))
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(t, "SSSSSS") == "000000", whole).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad_px: int = 2) -> Column:
    """Pixels of a unit rectangle whose y goes up: padded, inside the picture; null where nothing is left."""
    x0 = F.greatest(F.lit(0), (x * width).cast("int") - pad_px)
    x1 = F.least(width.cast("int"), ((x + w) * width).cast("int") + pad_px)
    y0 = F.greatest(F.lit(0), ((1 - y - h) * height).cast("int") - pad_px)
    y1 = F.least(height.cast("int"), ((1 - y) * height).cast("int") + pad_px)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def crop_scale(scale: Column, width: Column, height: Column, most: float = 8000.0) -> Column:
    return F.least(scale, F.lit(most) / width, F.lit(most) / height)


def global_coordinates(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Place on the whole page of a point observed in a crop of it; all in [0, 1] from the top left."""
    return F.struct((x0 + x * (x1 - x0)).alias("x"), (y0 + y * (y1 - y0)).alias("y"))


def is_uuid(c: Column | str) -> Column:
    return F.lower(as_column(c)).rlike(r"^[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}\z")


def looks_like_json(c: Column | str) -> Column:
    return as_column(c).rlike(r"(?U)^\s*[\[{]")


_JSON = {"allowSingleQuotes": "false", "maxNumLen": "2147483647", "maxStringLen": "2147483647"}


def is_json(c: Column | str) -> Column:
    """Is the whole text one JSON value, as json.loads has it? Null, blank and over 1,000 deep it is none.

    Spark's parsers stop behind the first value. So the text is read as the first of two elements: the text's own digest
    comes second only if nothing but one value is before it."""
    c = as_column(c)
    digest = F.md5(c)
    pair = F.from_json(F.concat(F.lit("["), c, F.lit(', "'), digest, F.lit('"]')), "array<string>", _JSON)
    return F.coalesce(F.get(pair, F.lit(1)) == digest, F.lit(False))


def decode(content: Column | str, strict: bool = False, bom: bool = False) -> Column:
    """UTF-8 bytes as text; bad ones become U+FFFD, or with strict end the query. bom: a leading mark goes."""
    content = as_column(content)
    s = F.decode(content, "UTF-8") if strict else F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(s, "^﻿", "") if bom else s
