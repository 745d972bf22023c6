"""ISCC codes and 64-bit content codes: decode, encode, distance, bands."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Main types (fixed values): content units, whose body begins with the code; composites, whose second unit is the code.
CONTENT, COMPOSITE = 2, 5


def _bits(base32: Column) -> Column:
    """A base32 string as a string of bits, five a character."""
    five = lambda c: F.lpad(F.conv((F.instr(F.lit(_ALPHABET), c) - 1).cast("string"), 10, 2), 5, "0")
    return F.array_join(F.transform(F.split(base32, ""), five), "")


def _number(bits: Column) -> Column:
    """Up to 64 bits as the BIGINT that holds them."""
    return F.conv(bits, 2, -10).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def decode(text: Column) -> Column:
    """The content code of an ISCC; null for anything that isn't one with a content code. Strict unpadded base32."""

    def of_bits(bits: Column) -> Column:
        used = (F.length(bits) / 8).cast("int") * 8
        clean = F.substr(bits, used + 1).rlike("^0*$")
        kind = F.substring(bits, 1, 4)
        unit = (kind == F.lit(format(CONTENT, "04b"))) & (used >= 80)
        composite = (kind == F.lit(format(COMPOSITE, "04b"))) & (used == 272)
        return F.when(clean & unit, _number(F.substring(bits, 17, 64))).when(clean & composite, _number(F.substring(bits, 81, 64)))

    def of_bare(bare: Column) -> Column:
        shape = bare.rlike("^[A-Z2-7]{4,100}$") & (F.length(bare) % 8).isin(0, 2, 4, 5, 7)
        return F.when(shape, let(_bits(bare), of_bits))

    return let(F.upper(F.regexp_replace(F.trim(text), "^(ISCC:|iscc:)", "")), of_bare)


def encode(code: Column, subtype: int = 0) -> Column:
    """A bare content unit of 64 bits with this code."""
    head = format(CONTENT << 4 | subtype, "08b") + "00000001"
    bits = F.concat(F.lit(head), F.lpad(F.conv(F.hex(code), 16, 2), 64, "0"))
    letter = lambda i: F.substr(F.lit(_ALPHABET), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.lit("ISCC:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), letter), ""))


def shown(code: Column) -> Column:
    """A code as 0x and hex digits; null for null."""
    return F.when(code.isNotNull(), F.format_string("0x%016x", code))


def of_hex(digits: Column) -> Column:
    """16 hex digits as the BIGINT with these bits."""
    return F.conv(digits, 16, -10).cast("long")


def of_signs(vector: Column) -> Column:
    """64 numbers as bits, most significant first: 1 where positive."""
    return _number(F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), ""))


def parse_query(text: str) -> tuple[str, int | str]:
    """A search's argument: ("code", signed number) for 0x and hex digits or 16 hex digits, else ("iscc", text)."""
    digits = text.strip()
    plain = digits[2:] if digits[:2] in ("0x", "0X") else digits if len(digits) == 16 and all(c in "0123456789abcdefABCDEF" for c in digits) else None
    if plain is None:
        return "iscc", digits
    n = int(plain, 16)
    if n >= 1 << 64:
        raise ValueError("a code has 64 bits")
    return "code", n - (1 << 64) if n >= 1 << 63 else n


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def check_bands(bands: int) -> int:
    if not (1 <= bands <= 64 and 64 % bands == 0):
        raise ValueError("bands must divide 64")
    return 64 // bands


def band_values(code: Column, bands: int = 8) -> Column:
    """The code's bands, the most significant first."""
    width = check_bands(bands)
    if width == 64:
        return F.array(code)
    return F.array(*[F.shiftrightunsigned(code, 64 - width * (i + 1)).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)])


def probe_masks(width: int, probe: int) -> list[int]:
    """All masks of a band's width with at most `probe` bits, fewest first."""
    masks = [sum(1 << b for b in c) for k in range(min(probe, width) + 1) for c in itertools.combinations(range(width), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def exact_probe(radius: int, bands: int) -> int:
    """The smallest probe with which banding misses no pair within the radius."""
    return max(0, -(-(radius + 1) // bands) - 1)


def bucket_key(index: Column, value: Column) -> Column:
    return F.format_string("iscc/%02d/%016x", index, value)
