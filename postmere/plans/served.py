"""Tables as a tier serves them: holding rows, and rows degraded until they are projected anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "id source account thread_id sent_at sender_domain domain category transactional_type importance requires_action action_type action_summary deadline "
    "waiting_on time_sensitive suggested_disposition sensitivity_level one_line organizations enriched_at uri facts"
).split()
#: Columns with text of third parties that a policy redacts.
REDACTED = ("one_line", "action_summary", "organizations", "facts")
PENDING = "[pending redaction] "


def holding(messages: DataFrame, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Of the rows of an id that with the latest ``synced_at`` (then ``enriched_at``, ``policy_hash``; NULL is least).

    *columns*: the ones that are carried through the shuffle, besides ``id``; all of them if None. The choice of the row takes
    only its key, so a narrow list reads and moves little else.
    """
    names = [c for c in messages.columns if c != "id" and (columns is None or c in set(columns))]
    key = F.struct("synced_at", "enriched_at", "policy_hash")
    if not names:
        return messages.select("id").distinct()
    return messages.groupBy("id").agg(F.max_by(F.struct(*names), key).alias("_h")).select("id", *[F.col(f"_h.{c}").alias(c) for c in names])


def served(messages: DataFrame, digest: str, fields: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """Rows of the policy *digest* as they are, others with their text hidden, so that no filter or group sees it.

    ``vector_current``: whether the row's vector is of its stored text and of this policy. Columns that *messages* lacks stay
    out; it needs ``policy_hash``, ``embedded_policy_hash`` and, for ``one_line``, ``domain``.
    """
    current = F.coalesce(F.col("policy_hash") == digest, F.lit(False))
    kept = {*fields, "id", "enriched_at"}
    out = []
    have = set(messages.columns)
    for c in COLUMNS:
        if c not in have:
            continue
        hidden = c in REDACTED or c not in kept
        col = F.when(current, F.col(c)) if hidden else F.col(c)
        if c == "one_line" and c in kept:
            domain = F.col("domain") if "domain" in kept else F.lit(None)
            col = F.when(current, F.col(c)).otherwise(F.concat(F.lit(PENDING), F.coalesce(domain, F.lit("other")), F.lit(" item")))
        out.append(col.alias(c))
    vectors = ["summary_embedding"] if "summary_embedding" in have else []
    return messages.select(*out, *vectors, (current & F.col("embedded_policy_hash").eqNullSafe(F.col("policy_hash"))).alias("vector_current"))


def backlog(messages: DataFrame, digest: str) -> DataFrame:
    """``pending, embed_stale``: rows of another policy, and rows whose vector is of another text."""
    pending = ~F.col("policy_hash").eqNullSafe(F.lit(digest))
    return messages.agg(F.count_if(pending).alias("pending"), F.count_if(~pending & ~F.col("embedded_policy_hash").eqNullSafe(F.col("policy_hash"))).alias("embed_stale"))


def served_needs(columns: set[str]) -> set[str]:
    """The stored columns that :func:`served` reads for these."""
    return columns | {"policy_hash", "embedded_policy_hash"} | ({"domain"} if "one_line" in columns else set())
