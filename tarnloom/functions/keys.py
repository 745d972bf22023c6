"""Keys: digests, partitions, descent bytes, and which keys are valid."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PARTITIONS

LEGACY = "^bbqjc[ab][a-z2-7]{51}$"
#: CIDv1s that need no decoding: base16, raw or DAG data, a 32-byte SHA-256 digest.
PLAIN = "^f01(55|70|71)1220[0-9a-f]{64}$"
_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def hex_int(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


def digest(key: Column) -> Column:
    return F.sha2(key, 256)


def partition_id(key: Column, partitions: int = PARTITIONS) -> Column:
    return hex_int(F.substring(digest(key), 1, 2)) % partitions


def partition_of(key: str, partitions: int = PARTITIONS) -> int:
    """partition_id() of one key, on the driver: a lookup's constant for partition pruning."""
    return hashlib.sha256(key.encode()).digest()[0] % partitions


def descent_byte(key: Column, depth: int) -> Column:
    if not 0 <= depth <= 30:
        raise ValueError("a digest has 31 descent bytes, 0 to 30")
    return hex_int(F.substring(digest(key), 3 + 2 * depth, 2))


def partition_name(partition: Column) -> Column:
    return F.format_string("partition/%03d", partition)


def named_partition(name: Column, partitions: int = PARTITIONS) -> Column:
    """The id in a name such as partition/042; null for other names and ids out of range."""
    found = F.regexp_extract(name, "^partition/([0-9]{1,9})$", 1)
    n = F.when(found != "", found.cast("int"))
    return F.when(n < partitions, n)


def is_legacy_key(key: Column) -> Column:
    return key.rlike(LEGACY)


def _base_decode(text: str, alphabet: str, bits: int) -> bytes | None:
    """RFC 4648 without padding; non-zero trailing bits and impossible lengths are errors."""
    value = 0
    for c in text:
        at = alphabet.find(c)
        if at < 0:
            return None
        value = value << bits | at
    n = len(text) * bits
    if n % 8 >= bits or value & ((1 << n % 8) - 1):
        return None
    return (value >> n % 8).to_bytes(n // 8, "big")


def _base_x(text: str, alphabet: str) -> bytes | None:
    value = 0
    for c in text:
        at = alphabet.find(c)
        if at < 0:
            return None
        value = value * len(alphabet) + at
    zeros = len(text) - len(text.lstrip(alphabet[0]))
    return b"\0" * zeros + value.to_bytes((value.bit_length() + 7) // 8, "big")


_AZ, _B58 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_HEX32, _Z32 = "0123456789abcdefghijklmnopqrstuv", "ybndrfg8ejkmcpqxot1uwisza345h769"
_B64 = _AZ + _AZ.lower() + "0123456789"
#: Multibase prefixes (fixed values of the public table) and how the rest is decoded.
MULTIBASE = {
    "0": lambda s: _base_decode(s, "01", 1), "7": lambda s: _base_decode(s, "01234567", 3), "9": lambda s: _base_x(s, "0123456789"),
    "f": lambda s: _base_decode(s, "0123456789abcdef", 4), "F": lambda s: _base_decode(s, "0123456789ABCDEF", 4),
    "b": lambda s: _base_decode(s, _BASE32, 5), "B": lambda s: _base_decode(s, _BASE32.upper(), 5), "c": lambda s: _base_decode(s.rstrip("="), _BASE32, 5), "C": lambda s: _base_decode(s.rstrip("="), _BASE32.upper(), 5),
    "v": lambda s: _base_decode(s, _HEX32, 5), "V": lambda s: _base_decode(s, _HEX32.upper(), 5), "t": lambda s: _base_decode(s.rstrip("="), _HEX32, 5), "T": lambda s: _base_decode(s.rstrip("="), _HEX32.upper(), 5), "h": lambda s: _base_decode(s, _Z32, 5),
    "k": lambda s: _base_x(s, "0123456789abcdefghijklmnopqrstuvwxyz"), "K": lambda s: _base_x(s, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "z": lambda s: _base_x(s, _B58), "Z": lambda s: _base_x(s, "123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"),
    "m": lambda s: _base_decode(s, _B64 + "+/", 6), "M": lambda s: _base_decode(s.rstrip("="), _B64 + "+/", 6), "u": lambda s: _base_decode(s, _B64 + "-_", 6), "U": lambda s: _base_decode(s.rstrip("="), _B64 + "-_", 6),
}


def _varint(data: bytes, at: int) -> tuple[int, int] | None:
    value = 0
    for i in range(9):
        if at + i >= len(data):
            return None
        byte = data[at + i]
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            return None if byte == 0 and i else (value, at + i + 1)
    return None


def is_cid_v1(key: str) -> bool:
    """Whether a key is a syntactically valid CIDv1: multibase, version 1, codec, multihash of the stated length."""
    decode = MULTIBASE.get(key[:1])
    data = decode(key[1:]) if decode and len(key) > 1 else None
    if not data:
        return False
    at, numbers = 0, []
    for _ in range(4):  # version, codec, hash function, digest length
        if not (read := _varint(data, at)):
            return False
        numbers.append(read[0])
        at = read[1]
    return numbers[0] == 1 and numbers[3] <= 64 and len(data) - at == numbers[3]


@F.pandas_udf(T.BooleanType())
def _cid_v1(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: isinstance(k, str) and is_cid_v1(k)).astype(bool)


def is_valid_key(key: Column, full: bool = True) -> Column:
    """CIDv1 or legacy id. full: keys that the native forms don't recognise are decoded in a vectorised UDF; else they are invalid."""
    native = F.coalesce(is_legacy_key(key) | key.rlike(PLAIN), F.lit(False))
    return native | _cid_v1(F.when(~native, key)) if full else native

