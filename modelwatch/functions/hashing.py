"""Keyed hashing with built-in functions only (HMAC-SHA256 from ``sha2``)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelwatch.functions.numeric import col_

# Whitespace that Python's str.strip() removes (Unicode White_Space plus the
# ASCII separators \x1c-\x1f), as a Java regex class.
_WS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: ``trim`` only removes spaces, so strip the whitespace class at both ends."""
    return F.regexp_replace(col_(c), rf"^{_WS}+|{_WS}+$", "")


def _pads(salt: str) -> tuple[bytes, bytes]:
    key = salt.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(c: str | Column, salt: str) -> Column:
    """HMAC-SHA256 of the UTF-8 text, as 64 lowercase hex characters.

    ``sha2(opad || unhex(sha2(ipad || msg)))`` — equal to Python's ``hmac`` module.
    """
    ipad, opad = _pads(salt)
    inner = F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(col_(c), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(opad)), F.unhex(inner)), 256)


def subject_key(c: str | Column, salt: str) -> Column:
    """Pseudonymous key: NULL / blank → NULL, else HMAC of the stripped text."""
    s = py_strip(col_(c).cast("string"))
    return F.when(s.isNotNull() & (F.length(s) > 0), hmac_sha256_hex(s, salt))
