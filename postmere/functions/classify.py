"""Rule classification of records by their headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sending services that mark promotional mail.
SENDING_SERVICES = "mailchimp|sendgrid|mailgun|sparkpost|amazonses|sendinblue|constantcontact|hubspot|klaviyo|mailjet"


def header(headers: Column, name: str) -> Column:
    """A header without regard to case; the first of several spellings; empty if there is none."""
    hit = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))


def classify(kind: Column, headers: Column, from_addr: Column) -> Column:
    """Struct ``label, confidence`` of a record."""
    unsubscribe = header(headers, "List-Unsubscribe")
    precedence = F.lower(header(headers, "Precedence"))
    auto = F.lower(header(headers, "Auto-Submitted"))
    listed = unsubscribe != ""
    mass = precedence.isin("bulk", "list", "junk")
    service = F.lower(F.coalesce(from_addr, F.lit(""))).rlike(SENDING_SERVICES) | unsubscribe.rlike(f"(?i){SENDING_SERVICES}")
    cases = [
        (F.coalesce(kind != "email", F.lit(True)), "document", 1.0), (listed & (mass | service), "promotional", 0.9), (listed, "newsletter", 0.7),
        (~auto.isin("", "no"), "notification", 0.8), (precedence == "bulk", "bulk", 0.7),
    ]
    out = F.lit(None)
    for when, label, sure in reversed(cases):
        otherwise = out if label != "bulk" else F.struct(F.lit("personal").alias("label"), F.lit(0.5).alias("confidence"))
        out = F.when(when, F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"))).otherwise(otherwise)
    return out
