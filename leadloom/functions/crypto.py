"""Signed tokens: HMAC has no built-in expression, so these are Arrow-batched UDFs."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_hex(c: Column, secret: str) -> Column:
    """HMAC-SHA-256 of a text in hex; null stays null."""

    @F.pandas_udf("string")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else hmac.new(secret.encode(), v.encode(), hashlib.sha256).hexdigest())

    return sign(c)


def _signature(data: str, secret: str) -> str:
    return base64.urlsafe_b64encode(hmac.new(secret.encode(), data.encode(), hashlib.sha256).digest()).decode()[:24]


def sign_token(payload: Column, secret: str) -> Column:
    """URL-safe base64 of the payload, a dot and 24 characters of its signature."""

    @F.pandas_udf("string")
    def sign(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            data = base64.urlsafe_b64encode(v.encode()).decode().rstrip("=")
            return f"{data}.{_signature(data, secret)}"

        return s.map(one)

    return sign(payload)


def verify_token(token: Column, secret: str) -> Column:
    """The payload of a token with a right signature, else null; compared in constant time."""

    @F.pandas_udf("string")
    def check(s: pd.Series) -> pd.Series:
        def one(v):
            data, dot, sig = (v or "").partition(".")
            if not dot or not hmac.compare_digest(sig.encode(), _signature(data, secret).encode()):
                return None
            return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode()

        return s.map(one)

    return check(token)
