"""HMAC-SHA256 as nested built-in hashes, so that checking stays in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 64  # of SHA-256


def hmac_sha256(secret: str, body: Column) -> Column:
    """Hex digest over the raw bytes of ``body``.

    The key pads are literals of the plan; ``build_session`` has Spark redact them in plan text.
    """
    key = secret.encode("utf-8")
    if len(key) > BLOCK_BYTES:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK_BYTES, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.sha2(F.concat(inner_pad, body.cast("binary")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def is_authentic(secret: str | None, body: Column, signature: Column) -> Column:
    """The header carries the right digest; a missing header or secret fails."""
    if not secret:
        return F.lit(False)
    expected = F.concat(F.lit("sha256="), hmac_sha256(secret, body))
    return F.coalesce(signature == expected, F.lit(False))
