"""Secret redaction (R18): the earliest match of any rule wins, the longer of equal starts, without overlaps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules in order; i: letter case does not count.
RULES = (
    ("openai-key", "i", r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,}\b"),
    ("aws-access-key", "", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("aws-secret-key", "i", r"aws[_\-]?secret[_\-]?(?:access[_\-]?)?key[\"'\s:=]+[\"']?[A-Za-z0-9/+=]{40}[\"']?"),
    ("github-pat", "i", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("google-api-key", "", r"\bAIza[0-9A-Za-z\-_]{35}\b"),
    ("slack-token", "i", r"\bxox[abprs]-[A-Za-z0-9\-]{10,}\b"),
    ("connection-string-password", "i", r"(?:password|pwd)\s*=\s*[^;\"\r\n]+"),
    ("bearer-token", "i", r"bearer\s+[A-Za-z0-9\-._~+/]{10,}=*"),
    ("api-key-assignment", "i", r"\bapi[_\-]?key[\"'\s:=]+[\"']?[A-Za-z0-9_\-]{16,}[\"']?"),
    ("password-assignment", "i", r"\b(?:password|passwd|secret)[\"'\s:=]+[\"']?[^\s\"',;]{6,}[\"']?"),
    ("jwt", "", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("pem-private-key", "", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |DSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"),
)
_COMPILED = [(name, re.compile(pattern, re.IGNORECASE if "i" in flags else 0)) for name, flags, pattern in RULES]
#: A cheap test that any text with a match passes.
_HINT = re.compile(r"sk-|AKIA|ASIA|secret|gh[pousr]_|AIza|xox|passw|pwd|bearer|api|eyJ|-----BEGIN", re.IGNORECASE)


def marker(rule: str) -> str:
    return f"<REDACTED:{rule}>"


def redact_text(text: str | None) -> tuple[str, int]:
    """The text with a marker for each hit, and the number of hits."""
    if not text or not _HINT.search(text):
        return text or "", 0
    found = [(m.start(), m.start() - m.end(), name) for name, rule in _COMPILED for m in rule.finditer(text) if m.end() > m.start()]
    out, at, n = [], 0, 0
    for start, minus, name in sorted(found, key=lambda h: h[:2]):
        if start >= at or n == 0:
            out += [text[at:start], marker(name)]
            at, n = start - minus, n + 1
    return "".join([*out, text[at:]]), n


def _redact(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([redact_text(t) for t in texts], columns=["text", "hits"])


def _redact_all(lists: pd.Series) -> pd.DataFrame:
    done = [[redact_text(t) for t in x] if x is not None else None for x in lists]
    return pd.DataFrame([(None, 0) if x is None else ([t for t, _ in x], sum(n for _, n in x)) for x in done], columns=["texts", "hits"])


def redact_all(texts: Column) -> Column:
    """(texts, hits) of an array of texts, in Arrow batches; a null array stays null."""
    return F.pandas_udf(_redact_all, "texts array<string>, hits int")(texts)


def redact(text: Column) -> Column:
    """(text, hits) of a text column, in Arrow batches."""
    return F.pandas_udf(_redact, "text string, hits int")(text)
