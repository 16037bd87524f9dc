"""Encryption of personal fields: AES-256-GCM under a key derived from a secret."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(secret: str) -> Column:
    return F.lit(hashlib.sha256(secret.encode()).digest())


def _reordered(data: Column, to_wire: bool) -> Column:
    """Spark's iv, text, tag against the wire's iv, tag, text."""
    n = F.octet_length(data)
    iv = F.substring(data, F.lit(1), F.lit(12))
    if to_wire:
        return F.concat(iv, F.substring(data, n - 15, F.lit(16)), F.substring(data, F.lit(13), n - 28))
    return F.concat(iv, F.substring(data, F.lit(29), n - 28), F.substring(data, F.lit(13), F.lit(16)))


def encrypt(text: Column, secret: str) -> Column:
    """base64 of iv (12), tag (16) and ciphertext."""
    return F.base64(_reordered(F.aes_encrypt(text.cast("binary"), _key(secret), F.lit("GCM")), to_wire=True))


def decrypt(wire: Column, secret: str) -> Column:
    """The text, or null if it was made with another secret or altered."""
    return F.try_aes_decrypt(_reordered(F.unbase64(wire), to_wire=False), _key(secret), F.lit("GCM")).cast("string")
