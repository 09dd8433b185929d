"""Credentials in text: counts with built-in expressions, spans in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmere.detect.spans import Span

# The patterns of credential kinds; the same in Java, RE2 and Python.
RULES = {
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
    "aws_access_key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[porsu]_[A-Za-z0-9]{36,251}\b",
    "github_pat": r"\bgithub_pat_[A-Za-z0-9_]{60,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "slack_webhook": r"https://hooks\.slack\.com/services/[A-Za-z0-9/_+-]{40,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_\-]{35}\b",
    "stripe_secret_key": r"\bsk_live_[0-9A-Za-z]{24,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
}
_KEY_BLOCK = re.compile(RULES["private_key"] + r".*?-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", re.S)
_COMPILED = {name: re.compile(p) for name, p in RULES.items()}
#: What each rule needs somewhere in the text: a cheap look before the patterns.
_NEEDLES = ("-----BEGIN", "AKIA", "ASIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "gh", "xox", "hooks.slack", "AIza", "sk_live_", "T3BlbkFJ", "eyJ")


def counts(text: Column) -> Column:
    """Map of the credential kinds found to how often; NULL text gives an empty map."""
    each = F.create_map(*[x for name, p in RULES.items() for x in (F.lit(name), F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)))])
    return F.map_filter(each, lambda _, n: n > 0)


def spans(text: str | None) -> list[Span]:
    """The credentials of a text; a key block counts as a whole."""
    if not text or not any(n in text for n in _NEEDLES):
        return []
    out = {Span(*m.span(), "private_key", "secret") for m in _KEY_BLOCK.finditer(text)}
    whole = sorted(out)
    for name, p in _COMPILED.items():
        for m in p.finditer(text):
            if name != "private_key" or not any(w.start == m.start() for w in whole):
                out.add(Span(*m.span(), name, "secret"))
    return sorted(out)
