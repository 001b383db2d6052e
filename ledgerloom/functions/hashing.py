"""Keyed ids, base32 and digests, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet of RFC 4648 base32 in lower case.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex of a binary column; the padded keys are constants of the plan."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def keyed_id(key: bytes, label: str, device: Column, number: Column) -> Column:
    """First 16 bytes, in hex, of the keyed digest over label, device and the number as eight bytes, the highest first."""
    wide = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    return F.substring(hmac_sha256(key, F.concat(F.lit(label).cast("binary"), wide(device), wide(number))), 1, 32)


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def base32(data: Column) -> Column:
    """Unpadded lower-case base32 of a binary column, five bytes at a time."""

    def letters(data: Column) -> Column:
        number = lambda g: F.conv(F.rpad(F.hex(F.substring(data, g * 5 + 1, F.lit(5))), 10, "0"), 16, 10).cast("long")
        eight = lambda n: F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(n, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)])
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(data) - 1) / 5).cast("int")), number)
        return F.substring(F.array_join(F.transform(groups, eight), ""), F.lit(1), F.ceil(F.octet_length(data) * 8 / 5).cast("int"))

    return F.when(F.octet_length(data) == 0, "").otherwise(_let(data, letters))


def unbase32(text: Column) -> Column:
    """The bytes of unpadded lower-case base32, in hex; null unless the text is what ``base32`` writes (letters, length, spare bits)."""

    def decoded(text: Column) -> Column:
        letter = lambda g, k: F.greatest(F.instr(F.lit(BASE32), F.substring(text, (g * 8 + 1 + k).cast("int"), F.lit(1))) - 1, F.lit(0)).cast("long")
        five = lambda g: F.lpad(F.hex(sum((F.shiftleft(letter(g, k), 35 - 5 * k) for k in range(1, 8)), F.shiftleft(letter(g, 0), 35))), 10, "0")
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 8).cast("int")), five)
        return F.lower(F.substring(F.array_join(groups, ""), F.lit(1), (F.floor(F.length(text) * 5 / 8) * 2).cast("int")))

    fine = text.rlike(f"\\A[{BASE32}]+\\z")
    got = _let(text, decoded)
    return F.when(text == "", "").when(fine, _let(got, lambda g: F.when(base32(F.unhex(g)) == text, g)))


def range_proof(key: bytes, nonce: Column, name: Column, offset: Column, data: Column) -> Column:
    """Keyed digest over a challenge: nonce, name, offset, length and the bytes, each number as eight bytes."""
    wide = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    return hmac_sha256(key, F.concat(nonce.cast("binary"), name.cast("binary"), wide(offset), wide(F.octet_length(data)), data))
