"""Credentials taken out of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[redacted]"
#: What credentials look like (fixed patterns), in the order in which they are taken out.
PATTERNS = (
    r"(?i)\bgh[pousr]_[A-Za-z0-9]{16,}",
    r"(?i)\bgithub_pat_[A-Za-z0-9_]{20,}",
    r"\b[A-Za-z0-9._%+-]+:[^@\s/]{6,}@",
    r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}",
    r"(?i)\bAuthorization:\s*\S+",
    r"(?i)\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\bAKIA[0-9A-Z]{16}\b",
)


def redact(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Known secrets of 6 characters or more go first, then everything of a credential's form."""
    for value in known:
        if len(value) >= 6:
            text = F.replace(text, F.lit(value), F.lit(REDACTED))
    for pattern in PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def mask_address(address: Column) -> Column:
    """The first character and the domain of an e-mail address."""
    return F.when(address.rlike("^[^@]+@.+"), F.regexp_replace(address, "^(.)[^@]*@", "$1***@")).otherwise(REDACTED)
