"""Content hashes of canonical JSON as column expressions. Columns are strings, integers, booleans or arrays of these: floats print differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, without spaces, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), KEEP_NULLS)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def short(digest: Column, n: int = 12) -> Column:
    return F.substring(digest, 1, n)


def question_id(*parts: Column) -> Column:
    """Sixteen hex digits of the hash of a JSON array of strings."""
    return short(sha256(F.to_json(F.array(*[p.cast("string") for p in parts]))), 16)


def template_id(category: Column, template: Column) -> Column:
    return short(sha256(F.to_json(F.array(category, template))), 12)


def prompt_hash(name: Column, version: Column, system: Column, user: Column) -> Column:
    return sha256(F.concat_ws("\x00", name, version, system, user))


def cache_key(**fields: Column) -> Column:
    """The key of a call: everything that may change its reply. Decimal settings come as strings."""
    return sha256(canonical_json(**fields))


def manifest_hash(images: Column, corruption: Column, severity: Column, max_edge: int = 0, jpeg_quality: int = 90) -> Column:
    """The hash of images (array of struct<camera, path, source_sha256>) as they are sent; empty without any."""
    refs = F.transform(images, lambda x: F.struct(x["camera"].alias("camera"), x["source_sha256"].alias("sha256")))
    whole = canonical_json(images=refs, corruption=corruption, severity=severity, max_edge=F.lit(max_edge), jpeg_quality=F.lit(jpeg_quality))
    return F.when(F.size(images) > 0, sha256(whole)).otherwise("")
