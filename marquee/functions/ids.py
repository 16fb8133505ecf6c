"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix:md5`` of the parts joined by bars, a dash for null."""
    return F.concat(F.lit(prefix + ":"), F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the first 32 hex digits of sha256 over the JSON array of the parts, null as ``null``."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256), 1, 32))


#: Fixed value: the version under which derived ids are made.
RESOLVER = "entity-resolver-v1"


def site_id(strict_key: Column) -> Column:
    return stable_id("site", F.lit(RESOLVER), strict_key)


def entity_id(kind: Column, key: Column) -> Column:
    return stable_id("entity", F.lit(RESOLVER), kind, key)


def alias_id(kind: Column, literal: Column) -> Column:
    return stable_id("alias", F.lit(RESOLVER), kind, literal)


def airport_id(name_key: Column) -> Column:
    return stable_id("airport", F.lit(RESOLVER), name_key)


def airport_alias_id(kind: Column, literal: Column) -> Column:
    return stable_id("airport-alias", F.lit(RESOLVER), kind, literal)


def review_id(domain: Column, reason: Column, *identity: Column) -> Column:
    return stable_id("review", F.lit(RESOLVER), domain, reason, *identity)


def fnv1a(text: str) -> str:
    """32-bit FNV-1a of a text's UTF-16 units, as eight hex digits."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces; numbers that are not finite are an error."""
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
