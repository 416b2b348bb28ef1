"""Message authentication in the JVM: HMAC-SHA256 as two nested hashes over a key's pads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(secret: str, body: Column) -> Column:
    """Lower-case hexadecimal HMAC of a text or binary column."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def signed(secret: str, body: Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(secret, body))


def verified(secret: str | None, body: Column, signature: Column) -> Column:
    """Whether the signature fits; nothing does without a secret or a signature. Hashes of both are compared, so that the time doesn't tell how much of it fits."""
    if not secret:
        return F.lit(False)
    return F.coalesce(F.sha2(signed(secret, body), 256) == F.sha2(signature, 256), F.lit(False))
