"""Values: canonical JSON, their hash and size, and the two fields that are read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blake3 import blake3
from .codes import let

#: How values are hashed, by name. Equality of hashes decides duplicates and conflicts; the algorithm is stored beside them.
HASHES = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5, "blake3": blake3}


def content_hash(value: Column, algorithm: str = "sha256") -> Column:
    return HASHES[algorithm](value)


def size(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def variant(value: Column) -> Column:
    return F.try_parse_json(value)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(value: Column) -> Column:
    return F.coalesce(_kind(variant(value)).startswith("OBJECT"), F.lit(False))


def canonical(value: Column) -> Column:
    """A submitted value: an object in compact form with sorted keys; a string that holds an object, that string; else null."""
    v = variant(value)
    text = F.try_variant_get(v, "$", "string")
    kind = _kind(v)
    return F.when(kind.startswith("OBJECT"), F.to_json(v)).when((kind == "STRING") & is_object(text), text)


def iscc_field(value: Column) -> Column:
    """The ISCC string of a value: key ISCC first, else the first key that is equal but for case; null unless a string."""
    fields = F.from_json(F.when(is_object(value), value), "map<string,variant>")

    def chosen(m: Column) -> Column:
        named = F.array_sort(F.filter(F.map_keys(m), lambda k: F.lower(k) == "iscc"))  # ISCC sorts before all other spellings
        return let(F.element_at(m, F.get(named, F.lit(0))), lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")))

    return let(fields, chosen)


def listed_iscc(value: Column) -> Column:
    """What a listing shows: key iscc, else ISCC, else a dash."""
    v = variant(value)
    return F.coalesce(F.try_variant_get(v, "$.iscc", "string"), F.try_variant_get(v, "$.ISCC", "string"), F.lit("-"))


def declared_at(value: Column) -> Column:
    """The timestamp field: a JSON integer of milliseconds; null otherwise, numeric strings and fractions included."""
    v = variant(value)
    field = F.when(is_object(value), F.try_variant_get(v, "$.timestamp", "variant"))
    whole = F.get_json_object(value, "$.timestamp").rlike("^-?[0-9]{1,18}$")
    return F.when((_kind(field) == "BIGINT") & whole, F.timestamp_millis(F.try_variant_get(v, "$.timestamp", "long")))


def created_at(value: Column, ingested_at: Column | None = None) -> Column:
    return F.coalesce(declared_at(value), F.current_timestamp() if ingested_at is None else ingested_at)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def short_id(text: Column, n: int = 12) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)
