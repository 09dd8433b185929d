"""Mail as records: the parse of raw messages, documents of the sensitive tier, and where fetchers plug in."""

from __future__ import annotations

import datetime as dt
import email
import email.policy
import email.utils
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmere.functions.classify import classify
from postmere.functions.text import as_text, without_nul
from postmere.plans import engine
from postmere.plans.spec import SENSITIVE
from postmere.sources.tables import ship_package

PARSED = (
    "from_addr string, to_addrs array<string>, subject string, sent_at timestamp, message_id string, headers map<string,string>, body_text string, error string"
)


class Fetcher(Protocol):
    """What an adapter of a provider offers: the records behind a cursor, those in *known* not downloaded again, and the next cursor."""

    def fetch(self, cursor: str | None, known: set[str]) -> Iterable[dict]: ...

    def next_cursor(self) -> str | None: ...


def parse_message(raw: bytes) -> dict:
    """A raw message as the columns of :data:`PARSED`: the first plain part as body, else any text; a date without zone is UTC."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()), None) or m.get_body(("html",)) or (None if m.is_multipart() else m)
    body = ""
    if part is not None:
        data = part.get_payload(decode=True) or b""
        try:
            body = data.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            body = data.decode("utf-8", "replace")
    sent = None
    if m["date"]:
        try:
            sent = email.utils.parsedate_to_datetime(str(m["date"]))
            sent = sent.replace(tzinfo=dt.UTC) if sent.tzinfo is None else sent.astimezone(dt.UTC)
        except ValueError:
            sent = None
    sender = email.utils.getaddresses([str(x) for x in m.get_all("from", [])])
    return {
        "from_addr": sender[0][1] if sender else None, "to_addrs": [a for _, a in email.utils.getaddresses([str(x) for x in m.get_all("to", [])])], "subject": str(m["subject"]).strip() or None if m["subject"] else None,
        "sent_at": sent, "message_id": str(m["message-id"]).strip() if m["message-id"] else None, "headers": {k: str(v) for k, v in m.items()}, "body_text": body, "error": None,
    }


def parse_messages(raw: DataFrame, content: str = "content") -> DataFrame:
    """*raw* (as of the binary file source) with the columns of :data:`PARSED`; a message that can't be read has only its ``error``.
    NULL content has NULL columns. Columns of the same names give way."""
    ship_package(raw.sparkSession)
    names = [c.split(" ")[0] for c in PARSED.split(", ")]
    keep = [c for c in raw.columns if c not in names]

    @F.pandas_udf(PARSED)
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            row = dict.fromkeys(names)
            if c is not None:
                try:
                    row = parse_message(bytes(c))
                except Exception as e:  # one message's fault is its own
                    row["error"] = f"{type(e).__name__}: {e}"[:1000]
            rows.append(row)
        out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names if n != "sent_at"})
        out["sent_at"] = pd.to_datetime(pd.Series([r["sent_at"] for r in rows], dtype=object), utc=True)
        return out[names]

    return raw.withColumn("_m", run(F.col(content))).select(*keep, *[F.col(f"_m.{n}").alias(n) for n in names])


def to_documents(records: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """``id, content, meta, ingested_at`` of records: the sensitive tier's rows, classified, without NUL characters. ``meta.sent_at`` is
    ISO text. Records without source or uid have no id and are left out."""
    clean = lambda c: without_nul(F.col(c))
    label = classify(F.col("kind"), F.col("headers"), F.col("from_addr"))
    have = dict(records.dtypes)
    sent = F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if have.get("sent_at", "").startswith("timestamp") else clean("sent_at")
    of = lambda c: clean(c) if c in have else F.lit(None).cast("string")
    listed = lambda c: F.transform(F.col(c), without_nul) if c in have else F.lit(None).cast("array<string>")
    meta = F.struct(
        *[of(c).alias(c) for c in ("source", "source_uid", "kind", "account", "folder", "thread_id", "from_addr")], listed("to_addrs").alias("to_addrs"), listed("labels").alias("labels"), as_text(of("subject")).alias("subject"),
        sent.alias("sent_at"), of("uri").alias("uri"), label["label"].alias("label"), label["confidence"].alias("label_confidence"),
    )
    body = "body_text" if "body_text" in have else "content"
    rows = records.filter("source is not null and source_uid is not null")
    return rows.select(F.concat("source", F.lit("::"), "source_uid").alias("id"), clean(body).alias("content"), meta.alias("meta"), (F.col("delivered_at") if "delivered_at" in have else F.lit(None).cast("timestamp") if ingested_at is None else ingested_at).alias("ingested_at"))


SENSITIVE_COLUMNS = ("id", "subject", "from_addr", "sent_text", "label")


def sensitive_tier(documents: DataFrame) -> engine.Tier:
    """The sensitive tier as the query model sees it: ranges and months by the instant of ``sent_at``, keywords in subject and
    content. Newest and oldest go by that instant too (by the text, two dates of different offsets could stand apart from
    their times); undated rows come last in both."""
    sent = F.try_to_timestamp(F.col("meta.sent_at"))
    rows = documents.select("id", "content", F.col("meta.subject").alias("subject"), F.col("meta.from_addr").alias("from_addr"), F.col("meta.sent_at").alias("sent_text"), sent.alias("sent_at"),
        *[F.col(f"meta.{c}").alias(c) for c in ("label", "account", "source")], *[c for c in ("embedding",) if c in documents.columns])
    return engine.Tier(rows, SENSITIVE, text=("subject", "content"), vector="embedding")


def search_rows(tier: engine.Tier, spec, now: dt.datetime, offset: int = 0, snippet: int = 300) -> DataFrame:
    """``id, score, subject, from_addr, sent_text, label, snippet`` of the nearest rows; the snippet is the head of the content, as a list shows it."""
    got = engine.nearest(tier, spec, now, offset, (*SENSITIVE_COLUMNS, "content"))
    return got.select("id", "score", *SENSITIVE_COLUMNS[1:], F.substring(F.coalesce("content", F.lit("")), 1, snippet).alias("snippet"))


def document_scan(documents: DataFrame, source: str | None = None, account: str | None = None) -> DataFrame:
    """Documents of a source and account, newest first, then by id; undated ones last."""
    rows = documents
    for name, value in (("source", source), ("account", account)):
        if value is not None:
            rows = rows.filter(F.col(f"meta.{name}") == value)
    return rows.orderBy(F.desc_nulls_last(F.try_to_timestamp(F.col("meta.sent_at"))), F.asc("id"))


def enriched_scan(documents: DataFrame, enrichments: DataFrame, source: str | None = None) -> DataFrame:
    """Documents with their enrichment (``doc_id, enrichment, enriched_at``), newest first."""
    rows = document_scan(documents, source)
    both = rows.join(enrichments.filter("enrichment is not null").withColumnRenamed("doc_id", "id"), "id")
    return both.orderBy(F.desc_nulls_last(F.try_to_timestamp(F.col("meta.sent_at"))), F.asc("id"))


def existing_ids(documents: DataFrame, source: str) -> DataFrame:
    return documents.filter(F.col("meta.source") == source).select("id").distinct()


def stats(documents: DataFrame) -> DataFrame:
    """``label, n``, the most frequent first, a total row (NULL label marked ``(all)``) on top."""
    counts = documents.groupBy(F.col("meta.label").alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.lit("(all)").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.unionByName(counts).orderBy(F.desc(F.col("label") == "(all)"), F.desc("n"), F.asc_nulls_last("label"))


def archive_report(documents: DataFrame, counts: Column) -> tuple[DataFrame, DataFrame]:
    """What a scan for secrets found: ``id, secret_types, from_addr, subject, sent_at`` of each document with any, and per
    type ``n`` matches in ``documents`` documents. *counts*: a map of types to numbers, as the detectors give it."""
    found = documents.withColumn("_n", counts).filter(F.size("_n") > 0)
    hits = found.select("id", F.array_sort(F.map_keys("_n")).alias("secret_types"), F.col("meta.from_addr").alias("from_addr"), F.col("meta.subject").alias("subject"), F.col("meta.sent_at").alias("sent_at"))
    totals = found.select("id", F.explode("_n").alias("type", "k")).groupBy("type").agg(F.sum("k").alias("n"), F.countDistinct("id").alias("documents"))
    return hits, totals


def ingest(records: DataFrame, stored: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The documents of records whose id is not stored yet, one row an id (the earliest delivery), with an embedding if *embed* is given.

    A record that fails to map is a row's matter: its columns are NULL, the others go on. Known ids are left out before
    anything is computed for them.
    """
    docs = to_documents(records)
    fresh = docs.join(stored.select("id").distinct(), "id", "left_anti")
    one = fresh.groupBy("id").agg(F.min_by(F.struct("content", "meta", "ingested_at"), F.struct("ingested_at", F.xxhash64("content"))).alias("_d")).select("id", "_d.*")
    if embed is None:
        return one
    from postmere.functions.text import embed_input

    return one.withColumn("embedding", embed(embed_input(F.col("meta.subject"), F.col("content"))))


def fetched(spark, fetcher: Fetcher, cursor: str | None, known: set[str], batch: int = 1000) -> Iterator[tuple[DataFrame, str | None]]:
    """A fetcher's records as frames of at most *batch* rows, each with the cursor that is valid once it is stored."""
    rows: list[dict] = []

    def frame() -> DataFrame:
        return spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "json string")

    for r in fetcher.fetch(cursor, known):
        rows.append(r)
        if len(rows) >= batch:
            yield frame(), fetcher.next_cursor()
            rows = []
    if rows:
        yield frame(), fetcher.next_cursor()
