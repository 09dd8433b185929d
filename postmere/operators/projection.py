"""The one-way projection of enriched records into the sanitized tier, and what a sync does with each row."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from postmere.functions.facts import country_code
from postmere.functions.text import sender_domain, web_link
from postmere.operators.redaction import KEEP_ALL, Redaction, redacted_row
from postmere.plans.engine import sensitivity_rank
from postmere.plans.served import COLUMNS
from postmere.plans.spec import SENSITIVITY
from postmere.sources.tables import ship_package

#: Columns that a projected row keeps whatever its policy lists.
KEPT = ("id", "enriched_at")


@dataclass(frozen=True)
class Policy:
    fields: tuple[str, ...] = tuple(COLUMNS)
    sensitivity_gate: str = "high"
    gate_action: str = "redact"
    redact: Redaction = Redaction()

    def digest(self) -> str:
        """A fingerprint of every setting that changes a row."""
        classes = {k: v for k, v in asdict(self.redact).items() if k != "place_name" or "facts" in self.fields}
        settings = {"version": 2, "fields": sorted(set(self.fields)), "sensitivity_gate": self.sensitivity_gate, "gate_action": self.gate_action, "redact": classes}
        return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


#: Free text as it was written below the gate, a stub at or above it.
STUB_POLICY = Policy(gate_action="stub", redact=KEEP_ALL)


def latest(enrichments: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``doc_id, enrichment, enriched_at``: the newest enrichment of each document (rejections aside); of equal times the greatest
    ``enrichment_model``, then ``schema_version``. *fields*: those of the enrichment to carry through the shuffle; None for all."""
    rows = enrichments.filter(F.col("doc_id").isNotNull() & F.col("enrichment").isNotNull())
    key = F.struct("enriched_at", "enrichment_model", "schema_version")
    value = F.col("enrichment") if fields is None else F.struct(*[F.col(f"enrichment.{f}").alias(f) for f in fields]) if fields else F.lit(True)
    newest = rows.groupBy("doc_id").agg(F.max_by(F.struct(value.alias("enrichment"), "enriched_at"), key).alias("_l"))
    out = newest.select("doc_id", "_l.enrichment", "_l.enriched_at")
    return out if fields is None or fields else out.drop("enrichment")


def _typed(enriched: DataFrame, path: tuple[str, ...]) -> Column | None:
    """The column at *path* of the enrichment, or None where the table's schema lacks it."""
    at = enriched.schema["enrichment"].dataType
    for name in path:
        at = at.elementType if isinstance(at, ArrayType) else at
        if not isinstance(at, StructType) or name not in at.names:
            return None
        at = at[name].dataType
    return F.col(".".join(("enrichment", *path)))


_REDACTED = "one_line string, action_summary string, organizations array<string>, carrier string, origin string, destination string"


def redact_columns(entity: Column, rules: Redaction) -> Column:
    """The redacted free text of a struct of :func:`redacted_row`'s columns, in Arrow batches."""
    ship_package(SparkSession.active())

    @F.pandas_udf(_REDACTED)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        done = [redacted_row(dict(zip(rows.columns, r, strict=True)), rules) for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)]
        names = [c.split(" ")[0] for c in _REDACTED.split(", ")]
        return pd.DataFrame({n: pd.Series([d[n] for d in done], dtype=object) for n in names})

    return run(entity)


def project(enriched: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Projected rows from ``doc_id, enrichment, enriched_at`` and, where the table has them, the record's ``source, account, thread_id, sent_at,
    from_addr, uri``.

    At or above the gate a stub policy, or a record without people and references to redact against, leaves a line that names only
    domain and action. Otherwise the free text (summaries, organizations, carrier, kept place names) is redacted by the policy's
    rules. Facts whose dates don't hold, or of which nothing survives, are NULL; so are columns outside of the policy's
    fields. Null enrichment fields take their defaults.
    """
    e = lambda *n: c if (c := _typed(enriched, n)) is not None else F.lit(None)
    filled = lambda n, default: F.coalesce(F.nullif(e(n), F.lit("")), F.lit(default))
    level, domain, action = F.coalesce(e("sensitivity_level"), F.lit("none")), filled("domain", "other"), filled("action_type", "none")
    listed = lambda n: F.coalesce(F.size(e(n)), F.lit(0)) > 0 if _typed(enriched, (n,)) is not None else F.lit(False)
    gated = (F.coalesce(sensitivity_rank(level), F.lit(0)) >= SENSITIVITY.index(policy.sensitivity_gate)) & (F.lit(policy.gate_action == "stub") | ~(listed("people") | listed("references")))
    stub = F.concat(F.lit("[sensitive] "), domain, F.lit(" item"), F.when(F.coalesce(e("requires_action"), F.lit(False)), F.concat(F.lit(" — action: "), action)).otherwise(""))
    people = e("people") if _typed(enriched, ("people",)) is not None else F.lit(None).cast("array<struct<role: string, name: string>>")
    references = e("references") if _typed(enriched, ("references",)) is not None else F.lit(None).cast("array<struct<kind: string, value: string>>")
    text = lambda *n: e(*n).cast("string")
    entity = F.struct(
        text("one_line").alias("one_line"), text("action_summary").alias("action_summary"), e("organizations").cast("array<string>").alias("organizations"), people.alias("people"), references.alias("references"),
        text("facts", "travel", "carrier").alias("carrier"), text("facts", "travel", "origin", "name").alias("origin"), text("facts", "travel", "destination", "name").alias("destination"),
    )
    have = set(enriched.columns)
    of = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    rows = enriched.withColumns({"_gated": gated, "_t": redact_columns(entity, policy.redact)})
    day = lambda n: e("facts", "travel", n).try_cast("date")
    holds = (e("facts", "travel", "start_date").isNull() | day("start_date").isNotNull()) & (e("facts", "travel", "end_date").isNull() | day("end_date").isNotNull())

    def place(n: str) -> Column:
        out = F.struct(F.col(f"_t.{n}").alias("name"), country_code(text("facts", "travel", n, "country")).alias("country"))
        return F.when(out["name"].isNotNull() | out["country"].isNotNull(), out)

    travel = F.struct(day("start_date").alias("start_date"), day("end_date").alias("end_date"), place("origin").alias("origin"), place("destination").alias("destination"), F.col("_t.carrier").alias("carrier"))
    survives = F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in (day("start_date"), day("end_date"), place("origin"), place("destination"), F.col("_t.carrier"))], F.lit(False))
    open_ = ~F.col("_gated")
    columns = {
        "id": F.col("doc_id"), "source": of("source"), "account": of("account"), "thread_id": of("thread_id"), "sent_at": of("sent_at", "timestamp"), "sender_domain": sender_domain(of("from_addr")),
        "domain": domain, "category": text("category"), "transactional_type": text("transactional_type"), "importance": filled("importance", "low"), "requires_action": F.coalesce(e("requires_action"), F.lit(False)),
        "action_type": action, "action_summary": F.when(open_, F.col("_t.action_summary")), "deadline": e("deadline").try_cast("date"), "waiting_on": filled("waiting_on", "none"), "time_sensitive": F.coalesce(e("time_sensitive"), F.lit(False)),
        "suggested_disposition": filled("suggested_disposition", "keep"), "sensitivity_level": level, "one_line": F.when(F.col("_gated"), stub).otherwise(F.col("_t.one_line")),
        "organizations": F.when(open_, F.col("_t.organizations")), "enriched_at": F.col("enriched_at"), "uri": web_link(of("uri")), "facts": F.when(open_ & holds & survives, F.struct(travel.alias("travel"))),
    }
    kept = {*policy.fields, *KEPT}
    out = rows.select(*[c.alias(n) for n, c in columns.items()])
    return out.select(*[F.col(n) if n in kept else F.lit(None).cast(out.schema[n].dataType).alias(n) for n in columns])


def from_records(records: DataFrame) -> DataFrame:
    """What a projected row takes from its record: ``id, source, account, thread_id, sender_domain, uri``."""
    return records.select(F.concat("source", F.lit("::"), "source_uid").alias("id"), "source", "account", "thread_id", sender_domain(F.col("from_addr")).alias("sender_domain"), web_link(F.col("uri")).alias("uri"))


def sync_actions(enriched: DataFrame, held: DataFrame, digest: str, force: bool = False) -> DataFrame:
    """``id, action``: what a sync does with each enriched document: ``insert``, ``replace`` (enriched anew),
    ``reproject`` (another policy, or *force*), ``reembed`` (vector of another text) or ``skip``."""
    state = held.select(F.col("id").alias("doc_id"), F.col("enriched_at").alias("done"), "policy_hash", "embedded_policy_hash", F.lit(True).alias("_held"))
    both = enriched.select("doc_id", "enriched_at").join(state, "doc_id", "left")
    action = (
        F.when(F.col("_held").isNull(), "insert").when(~F.col("done").eqNullSafe(F.col("enriched_at")), "replace")
        .when(F.lit(force) | ~F.col("policy_hash").eqNullSafe(F.lit(digest)), "reproject").when(~F.col("embedded_policy_hash").eqNullSafe(F.col("policy_hash")), "reembed").otherwise("skip")
    )
    return both.select(F.col("doc_id").alias("id"), action.alias("action"))


def sync(enriched: DataFrame, held: DataFrame, policy: Policy, now: Column, embed=None, limit: int = 0, reembed_limit: int = 0, force: bool = False) -> DataFrame:
    """The rows that a sync writes: ``action``, the projected columns, ``summary_embedding, policy_hash, embedded_policy_hash, synced_at, changed``.

    New and re-enriched rows are embedded by *embed* (a function of a text column; None leaves vectors out), newest first and at most *limit* of them (0 for
    all): a new row beyond it is ``capped`` and not written, a re-enriched one keeps its old vector as stale. A row projected
    anew keeps its vector, which stays current only if its text is the same. Of rows whose vector is stale at most *reembed_limit* (0 for none), newest first, are
    embedded again. ``changed``: whether any projected column differs from the stored row.
    """
    digest = policy.digest()
    actions = sync_actions(enriched, held, digest, force).withColumnRenamed("id", "doc_id")
    work = enriched.join(actions.filter("action <> 'skip'"), "doc_id")
    new = project(work, policy).join(actions.withColumnRenamed("doc_id", "id"), "id")
    old = held.select("id", F.struct(*COLUMNS).alias("_old"), F.col("one_line").alias("_was"), F.col("summary_embedding").alias("_vector"), F.col("embedded_policy_hash").alias("_under"), F.col("policy_hash").alias("_policy"))
    rows = new.join(old, "id", "left")
    rank = lambda when, limit: _first(rows.filter(when), limit)
    fresh = F.col("action").isin("insert", "replace")
    chosen = rank(fresh, limit) if limit else rows.filter(fresh).select("id")
    stale = (F.col("action") == "reembed") | (F.col("action") == "reproject") & ~F.col("one_line").eqNullSafe(F.col("_was"))
    again = rank(stale, reembed_limit) if reembed_limit else rows.select("id").limit(0)
    picked = chosen.unionByName(again).withColumn("_embed", F.lit(True))
    rows = rows.join(picked, "id", "left").withColumn("_embed", F.coalesce("_embed", F.lit(False)) & F.lit(embed is not None))
    capped = (F.col("action") == "insert") & ~F.col("_embed") & F.lit(bool(limit) and embed is not None)
    same = F.col("one_line").eqNullSafe(F.col("_was")) & F.col("_under").eqNullSafe(F.col("_policy"))
    vector = F.when(F.col("_embed"), embed(F.col("one_line"))) if embed is not None else F.when(F.lit(False), F.col("_vector"))
    return rows.select(
        F.when(capped, "capped").otherwise(F.col("action")).alias("action"), *COLUMNS, vector.otherwise(F.col("_vector")).alias("summary_embedding"), F.lit(digest).alias("policy_hash"),
        F.when(F.col("_embed") | same, F.lit(digest)).otherwise(F.when(F.col("_under") != digest, F.col("_under"))).alias("embedded_policy_hash"), now.alias("synced_at"),
        (~F.struct(*COLUMNS).eqNullSafe(F.col("_old"))).alias("changed"),
    )


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """The ids of the newest rows, at most *limit*; a sort with a limit, no task orders all."""
    return rows.orderBy(F.desc_nulls_last("sent_at"), "id").limit(limit).select("id")


def stale_vectors(held: DataFrame, digest: str, limit: int = 0) -> DataFrame:
    """Rows of the policy whose vector is of another text, newest first; all of them without a limit."""
    rows = held.filter((F.col("policy_hash") == digest) & ~F.col("embedded_policy_hash").eqNullSafe(F.col("policy_hash")))
    rows = rows.select("id", "one_line", "sent_at")
    return rows.orderBy(F.desc_nulls_last("sent_at"), "id").limit(limit) if limit else rows


def run_counts(actions: DataFrame) -> DataFrame:
    """The counters of a sync run, in one pass."""
    names = ("insert", "replace", "reproject", "reembed", "skip", "capped")
    return actions.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("action") == n).alias(n) for n in names])
