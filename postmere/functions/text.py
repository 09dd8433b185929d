"""Scalar functions on text columns, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sender_domain(address: Column) -> Column:
    """What follows the last ``@``, without blanks and a closing bracket, lower case; NULL if there is none."""
    tail = F.regexp_replace(F.trim(F.substring_index(address, "@", -1)), r">+$", "")
    return F.when(address.contains("@"), F.nullif(F.lower(F.trim(tail)), F.lit("")))


def without_nul(col: Column) -> Column:
    return F.translate(col, "\x00", "")


def mask(label: str, value: Column) -> Column:
    """``[label ••••12]``; the last two characters only of values with eight letters and digits or more."""
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return F.concat(F.lit(f"[{label} ••••"), F.when(F.length(bare) >= 8, F.right(bare, F.lit(2))).otherwise(""), F.lit("]"))


def initials(name: Column) -> Column:
    """``K. N.`` of a name."""
    words = F.regexp_extract_all(name, F.lit(r"\p{L}[\p{L}'’-]*"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def role_phrase(role: Column) -> Column:
    """``a friend``, ``an agent``; ``someone`` for an unknown role."""
    r = F.trim(F.lower(role))
    article = F.when(r.rlike("^[aeiou]"), "an ").otherwise("a ")
    return F.when(role.isNull() | r.isin("", "unknown"), "someone").otherwise(F.concat(article, r))


def tidy(text: Column) -> Column:
    """White space left by a removal: single, and none before punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+([,.;:!?])", "$1"), r"[ \t]{2,}", " "))


def embed_input(subject: Column, body: Column, words: int = 512, most: int = 2000) -> Column:
    """The text to embed: the subject, a blank line and the body's first *words* words without links and overlong words, cut at *most*
    characters: the input that the embedder takes, a feature of it."""
    clean = F.regexp_replace(body, r"(?i)(?:https?://|www\.)\S+", " ")
    kept = F.filter(F.split(F.trim(F.regexp_replace(clean, r"\s+", " ")), " "), lambda w: F.length(w).between(1, 64))
    text = F.coalesce(F.array_join(F.slice(kept, 1, words), " "), F.lit(""))
    return F.substring(F.concat(F.coalesce(subject, F.lit("")), F.lit("\n\n"), text), 1, most)


def chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping pieces of so many words."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, size), " "))


def head(text: Column, limit: int) -> Column:
    """At most *limit* characters, with a note where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("\n\n[truncated]"))).otherwise(text)


def web_link(uri: Column) -> Column:
    """An https link of at most 2048 printable characters with a host and no user; else NULL."""
    ok = uri.rlike(r"^https://[^\s/?#@:]+(?::\d+)?(?:[/?#][\x21-\x7E]*)?$") & (F.length(uri) <= 2048)
    return F.when(ok, uri)


def digest(col: Column, bits: int = 256, length: int = 16) -> Column:
    return F.substring(F.sha2(col, bits), 1, length)


def as_text(value: Column) -> Column:
    """A trimmed text, NULL if empty."""
    return F.nullif(F.trim(value), F.lit(""))


def name_key(name: Column) -> Column:
    """A firm's name for comparison: small, ``&`` as and, without punctuation and legal form."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    bare = F.trim(F.regexp_replace(plain, r"\b(inc|ltd|llc|plc|gmbh|corp|corporation|limited|as|ab)$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), plain)
