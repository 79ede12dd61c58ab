"""Secrets in logs and errors, replaced on the cluster or on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a secret looks like, and what is shown instead; Java and Python read these patterns alike.
SECRETS = (
    (r"(?i)(://[^/:@\s]+):[^/@\s]+@", r"$1:***@"),
    (r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)(\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;&]+)", r"$1$2***"),
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9+/=._~-]{8,}", r"$1 ***"),
)


def redacted(text: Column) -> Column:
    """The text with secrets replaced: passwords in addresses, values of telling names, authorisation headers."""
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def redacted_text(text: str) -> str:
    """As ``redacted``, for a message on the driver."""
    for pattern, shown in SECRETS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", shown), text)
    return text
