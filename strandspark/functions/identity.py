"""Stable identities: name-based UUIDs, canonical JSON digests, ordered fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """UUID version 5 from SHA-1, without Python code."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def fingerprint(key: Column, value: Column) -> Column:
    """Aggregate: MD5 over the values' MD5s in the order of the keys.

    One group's digests, 32 characters a row, meet in one task.
    """
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.md5(value).alias("h"))))
    return F.md5(F.array_join(F.transform(pairs, lambda x: x["h"]), ""))
