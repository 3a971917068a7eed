"""Small expressions shared by sources and analytics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_CATEGORY = "__NA__"


def dash_null(x: Column) -> Column:
    """NULL for the mark ``-``."""
    return F.nullif(x, F.lit("-"))


def field(fields: Column, i: int) -> Column:
    """Field ``i`` from 0, NULL beyond the end."""
    return F.get(fields, F.lit(i))


def hex_number(text: Column) -> Column:
    """A hexadecimal number with or without ``0x``, NULL if it is none."""
    digits = F.regexp_extract(text, r"\A(?:0[xX])?([0-9A-Fa-f]+)\z", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def time_bin(seconds: Column, width: float) -> Column:
    """The start of the bin of that width."""
    return F.floor(seconds / F.lit(width)) * F.lit(width)


def utc_timestamp(text: Column, pattern: str) -> Column:
    """The instant of a time without zone that is UTC, whatever the session's zone; NULL if it doesn't fit."""
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} xx"))


def quoted_tokens(line: Column) -> Column:
    """Tokens between blanks; a quoted one may hold blanks and loses its quotes."""
    raw = F.regexp_extract_all(line, F.lit(r'("[^"]*"|[^ "]+)'), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), x.substr(F.lit(2), F.length(x) - 2)).otherwise(x))


def comma_tokens(line: Column, fields: int) -> Column:
    """Comma-separated fields with quotes, as an array of that many."""
    return F.array(*[F.from_csv(line, ", ".join(f"_{i} string" for i in range(fields)))[f"_{i}"] for i in range(fields)])


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def or_category(x: Column) -> Column:
    """Any value as a category, with one of its own for NULL."""
    return F.coalesce(x.cast("string"), F.lit(NULL_CATEGORY))


def url_parts(method: Column, url: Column, bare_connect: bool) -> tuple[Column, Column, Column]:
    """Host, port and path of a proxy's URL.

    ``CONNECT`` has ``host:port``; without a port the host is kept only where
    ``bare_connect`` says so. Else the third slash-separated part is the host
    with an optional port (80 by default); without any slash all are NULL.
    """
    parts = F.split(url, "/")
    place = F.when(method == "CONNECT", url).when(url.contains("/"), field(parts, 2))
    split = F.split(place, ":")
    has_port = place.contains(":")
    host = F.when(has_port | (method != "CONNECT") | method.isNull() | F.lit(bare_connect), field(split, 0))
    port = F.when(has_port, field(split, 1).try_cast("long")).when((method.isNull() | (method != "CONNECT")) & place.isNotNull(), F.lit(80).cast("long"))
    path = F.when((method.isNull() | (method != "CONNECT")) & url.contains("/"), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "/")))
    return host, port, path
