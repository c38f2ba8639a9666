"""Canonical JSON, checksums and keyed authentication.

The key never enters a plan: the signing and checking UDFs read it from a file or environment variable on the worker.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 32
ALGORITHM = "HMAC-SHA-256"


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are kept. The numbers of a payload are integers."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_text(value) -> str:
    """Canonical JSON of nested Python values: keys sorted at every level, compact, non-finite numbers rejected."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical(payload: Column) -> Column:
    """Any JSON text in canonical form, at every level; null where it is malformed or holds a non-finite number."""

    @F.pandas_udf("string")
    def rewrite(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else canonical_text(json.loads(v))
            except ValueError:
                return None

        return values.map(one)

    return rewrite(payload)


def payload_sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


def parse_key(text: str) -> bytes:
    text = text.strip()
    if len(text) % 2:
        raise ValueError("a key is an even number of hexadecimal digits")
    key = bytes.fromhex(text)
    if len(key) < KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes at least")
    return key


def demonstration_key() -> bytes:
    """A public key for examples and tests; it protects nothing."""
    return hashlib.sha256(b"demonstration").digest()


#: Named as path, stands for the public demonstration key.
DEMONSTRATION = "demonstration:"


def load_key(path: str | None = None, variable: str | None = None) -> bytes:
    """From a file, else from an environment variable; without either there is no key. The demonstration key must be asked for."""
    if path == DEMONSTRATION:
        return demonstration_key()
    if path:
        with open(path, encoding="ascii") as f:
            return parse_key(f.read())
    if variable and os.environ.get(variable):
        return parse_key(os.environ[variable])
    raise ValueError("no key: give a file or a set environment variable")


def write_key(path: str, size: int = KEY_BYTES) -> None:
    """A new random key in a file that only the owner can read; an existing file is not replaced."""
    if size < KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes at least")
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        f.write(secrets.token_hex(size))


def key_fingerprint(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


def sign(payload: Column, path: str | None = None, variable: str | None = None) -> Column:
    @F.pandas_udf("string")
    def tag(values: pd.Series) -> pd.Series:
        key = load_key(path, variable)
        return values.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest())

    return tag(payload)


def verify(payload: Column, tag: Column, path: str | None = None, variable: str | None = None) -> Column:
    """Constant-time comparison; malformed tags are false."""

    @F.pandas_udf("boolean")
    def check(values: pd.Series, tags: pd.Series) -> pd.Series:
        key = load_key(path, variable)

        def one(v: str | None, t: str | None) -> bool:
            try:
                given = bytes.fromhex(t or "")
            except ValueError:
                return False
            return v is not None and hmac.compare_digest(hmac.new(key, v.encode(), hashlib.sha256).digest(), given)

        return pd.Series([one(v, t) for v, t in zip(values, tags)], dtype=bool)

    return check(payload, tag)


def mentions_key(text: Column, path: str | None = None, variable: str | None = None) -> Column:
    """Whether a text holds the key in hexadecimal, in either case. The key is read on the workers and is in no plan."""

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        key = load_key(path, variable).hex()
        return values.map(lambda v: v is not None and key in v.lower()).astype(bool)

    return check(text)
