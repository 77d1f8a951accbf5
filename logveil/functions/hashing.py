"""Keyed hashes and pseudonyms as Column expressions."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logveil.functions.lists import CASE_SENSITIVE

_BLOCK = 64


@dataclass(frozen=True)
class Key:
    """A key that was stretched once on the driver; expressions hold it as two literals.

    Plans show literals; where plans are shared, set spark.sql.redaction.string.regex.
    """

    value: bytes
    hash_len: int = 12

    @classmethod
    def derive(cls, salt: str, iterations: int = 600_000, context: bytes = b"logveil", hash_len: int = 12) -> Key:
        return cls(hashlib.pbkdf2_hmac("sha256", salt.encode(), context, iterations), hash_len)

    @classmethod
    def random(cls, hash_len: int = 12) -> Key:
        """A key of this run only: its pseudonyms cannot be made again."""
        return cls(os.urandom(32), hash_len)

    def pads(self) -> tuple[bytes, bytes]:
        """The inner and the outer padded key of HMAC-SHA256."""
        raw = hashlib.sha256(self.value).digest() if len(self.value) > _BLOCK else self.value
        raw = raw.ljust(_BLOCK, b"\0")
        return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_hex(value: Column, key: Key) -> Column:
    """HMAC-SHA256 of a string's UTF-8 bytes, in lower-case hex."""
    inner, outer = key.pads()
    first = F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def normalized(value: Column, tag: Column) -> Column:
    """What is hashed: lower case, but for tags whose case matters."""
    return F.when(tag.isin(*CASE_SENSITIVE), value).otherwise(F.lower(value))


def pseudonym(value: Column, tag: Column | str, key: Key) -> Column:
    """[TAG_hex]; the hex part depends on the value and not on the tag."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("["), tag, F.lit("_"), F.substring(hmac_hex(normalized(value, tag), key), 1, key.hash_len), F.lit("]"))
