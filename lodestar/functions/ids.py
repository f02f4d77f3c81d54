"""Ids that depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public name space of URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based (version 5) id of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def symbol_id(repository: Column, path: Column, kind: Column, qualified: Column, start: Column, end: Column) -> Column:
    return uuid5(F.concat_ws("|", repository, path, kind, qualified, start.cast("string"), end.cast("string")))


def file_id(repository: Column, path: Column) -> Column:
    return uuid5(F.concat_ws("|", repository, F.lit("file"), path))


def edge_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)
