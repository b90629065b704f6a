"""Canonical JSON, the hashes that derive from it, and the key hash of a partitioned log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a source's scope and of an extraction contract, and the constants of the 32-bit MurmurHash2 that message logs deal keys by.
SCOPE_FIELDS = ("seeds", "allowed_urls", "allowed_origins", "path_prefixes", "deny_path_prefixes", "sitemap_url_prefixes")
CONTRACT_FIELDS = ("min_content_chars", "max_decoded_body_bytes", "max_extraction_bytes", "max_extraction_millis", "extraction_schema")
MURMUR_SEED, MURMUR_M = 0x9747B28C, 0x5BD1E995
_MASK = 0xFFFFFFFF


def canonical_json(**fields: Column) -> Column:
    """An object with its fields in byte order of their names, without spaces, with nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields, key=str.encode)]), {"ignoreNullFields": "false"})


def scope_sha256(source: Column | str) -> Column:
    """The hash of what a source may crawl. source: a struct with source_id and the scope's string arrays. Arrays are sorted; ``allowed_urls`` may be null, which differs from an empty
    list; ``sitemap_url_prefixes`` null is an empty list; another null, or a null within a list, is an error."""
    s = F.col(source) if isinstance(source, str) else source
    fields: dict[str, Column] = {"source_id": s["source_id"].cast("string")}
    for f in SCOPE_FIELDS:
        v = s[f]
        if f == "sitemap_url_prefixes":
            v = F.coalesce(v, F.array().cast("array<string>"))
        wrong = F.exists(v, lambda x: x.isNull())
        wrong = F.coalesce(wrong, F.lit(False)) if f == "allowed_urls" else F.coalesce(wrong, F.lit(True))
        fields[f] = F.when(wrong, F.raise_error(F.lit(f"source.{f} must be a list of strings"))).otherwise(F.array_sort(v))
    return F.sha2(canonical_json(**fields), 256)


def contract_sha256(policy: Column | str) -> Column:
    """The hash of what decides how pages are extracted; a field that the policy lacks counts as null."""
    p = F.col(policy) if isinstance(policy, str) else policy
    return F.sha2(canonical_json(**{f: p[f] for f in CONTRACT_FIELDS}), 256)


def register(spark) -> None:
    """The hashes as SQL functions of a session: ``scope_sha256(struct)``, ``contract_sha256(struct)`` take JSON text, so that any shape of struct will do, and
    ``history_fingerprint`` four 64-bit parts of an event's row."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION history_fingerprint(event_id STRING, event_type STRING, schema_version INT, dedupe_key STRING, payload_sha256 STRING, created_at TIMESTAMP) RETURNS ARRAY<BIGINT> "
        "RETURN transform(sequence(0, 3), i -> CAST(conv(substring(sha2(concat('[', array_join(transform(array(event_id, event_type, CAST(schema_version AS STRING), dedupe_key, payload_sha256, "
        "date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")), x -> coalesce(x, 'null')), ', '), ']'), 256), 16 * i + 1, 16), 16, -10) AS BIGINT))"
    )
    lists = ", ".join(f"{f}: ARRAY<STRING>" for f in sorted(SCOPE_FIELDS))
    order = ", ".join(
        f"'{f}', " + ("source.source_id" if f == "source_id" else f"array_sort({'coalesce(source.sitemap_url_prefixes, array())' if f == 'sitemap_url_prefixes' else 'source.' + f})") for f in sorted((*SCOPE_FIELDS, "source_id"))
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION scope_sha256(source STRUCT<source_id: STRING, {lists}>) RETURNS STRING RETURN sha2(to_json(named_struct({order}), map('ignoreNullFields', 'false')), 256)")


def murmur2(key: Column | str) -> Column:
    """The 32-bit MurmurHash2 of a string's bytes, as a non-negative bigint, by a fold over its words of four bytes inside generated code."""
    k = F.hex(F.encode(F.col(key) if isinstance(key, str) else key, "UTF-8"))
    n = F.octet_length(F.col(key) if isinstance(key, str) else key).cast("long")
    byte = lambda at: F.substring(k, at * 2 + 1, F.lit(2))
    times = lambda x: (x * F.lit(MURMUR_M).cast("long")).bitwiseAND(F.lit(_MASK).cast("long"))  # noqa: E731  31 bits by 32 fit in 63

    def word(i: Column) -> Column:
        at = (i * 4).cast("int")
        return F.conv(F.concat(byte(at + 3), byte(at + 2), byte(at + 1), byte(at)), 16, 10).cast("long")

    def step(h: Column, i: Column) -> Column:
        w = times(word(i))
        return times(h).bitwiseXOR(times(w.bitwiseXOR(F.shiftrightunsigned(w, 24))))

    words = F.floor(n / 4).cast("int")
    seed = F.lit(MURMUR_SEED).cast("long").bitwiseXOR(n)
    h = F.when(words > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), seed, step)).otherwise(seed)
    left = (n % 4).cast("int")
    tail = lambda j: F.shiftleft(F.conv(byte(words * 4 + j), 16, 10).cast("long"), 8 * j)
    rest = F.when(left == 3, tail(2).bitwiseXOR(tail(1)).bitwiseXOR(tail(0))).when(left == 2, tail(1).bitwiseXOR(tail(0))).when(left == 1, tail(0))
    h = F.when(left > 0, times(h.bitwiseXOR(rest))).otherwise(h)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 15))


def key_partition(key: Column | str, partitions: int) -> Column:
    """The partition that a log's default partitioner picks for a key."""
    return F.pmod(murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.lit(partitions).cast("long")).cast("int")
