"""Identity functions as Column expressions: stable ids, hashes and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
FIELD_MARK = "\x1f"


def normalize_name(name: Column) -> Column:
    """Case folded, trimmed, white space runs as one space."""
    folded = F.lower(F.regexp_replace(F.translate(name, "ſς", "sσ"), "[ßẞ]", "ss"))
    whole = F.trim(F.regexp_replace(F.translate(folded, "ς", "σ"), r"\s+", " "))
    # ASCII without white space needs no patterns
    plain = (F.octet_length(name) == F.length(name)) & (F.translate(name, " \t\n\x0b\f\r", "") == name)
    return F.when(plain, F.lower(name)).otherwise(whole)


def normalize_atom_text(text: Column) -> Column:
    """White space runs as one space, case kept."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def uuid5(name: Column, namespace_hex: str = URL_NAMESPACE) -> Column:
    """RFC 4122 version 5 of a name, natively from SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def hash_id(prefix: str, content: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(content))


def pair_id(a: Column, b: Column, prefix: str = "rel-") -> Column:
    """Id of an unordered pair."""
    return hash_id(prefix, F.concat(F.least(a, b), F.greatest(a, b)))


def length_prefixed_hash(*fields: Column) -> Column:
    """md5 of length-prefixed fields, so that no two field lists collide by concatenation."""
    return F.md5(F.concat(*(F.concat(F.length(f).cast("string"), F.lit(":"), f) for f in fields)))


def community_id(members: Column) -> Column:
    """Id of a set of members, whatever their order."""
    return F.concat(F.lit("community-"), F.substring(F.sha2(F.array_join(F.array_sort(members), FIELD_MARK), 256), 1, 16))
