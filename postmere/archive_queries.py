"""Queries of the sensitive tier, the enrichment table, the archive, stored-table changes and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmere.functions import text as tx
from postmere.functions.facts import COUNTRIES, NO_CARRIER
from postmere.operators import archive, enrichment, metrics, projection, store
from postmere.plans import engine
from postmere.plans.spec import VOCABULARY, Spec
from postmere.queries import _E, _M, DIGEST, NOW, held
from postmere.sources import mail
from postmere.sources.tables import table

QUERIES, ORACLES = {}, {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# The sensitive tier: records as documents, one row a delivery, with the instant of delivery as their time where that of sending is text.

def _documents(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "records").withColumns({"sent_at": F.col("delivered_at"), "source_uid": F.concat("source_uid", F.lit("#"), F.col("delivery_id").cast("string"))})
    return mail.to_documents(rows)


_tier = lambda s, d: mail.sensitive_tier(_documents(s, d))
_HEADER = "lower(coalesce(list_filter(map_entries(headers), lambda e: lower(e.key) = '{}')[1].value, ''))"
_ESP = "mailchimp|sendgrid|mailgun|sparkpost|amazonses|sendinblue|constantcontact|hubspot|klaviyo|mailjet"
_DOC = f"""WITH h AS (SELECT *, lower(coalesce(from_addr, '')) AS f, {_HEADER.format('list-unsubscribe')} AS u, {_HEADER.format('precedence')} AS p, {_HEADER.format('auto-submitted')} AS a FROM records),
doc AS (SELECT source || '::' || source_uid || '#' || delivery_id AS id, content, nullif(trim(subject), '') AS subject, from_addr, account, source, delivered_at AS sent_at, CASE WHEN kind IS DISTINCT FROM 'email' THEN 'document'
 WHEN u <> '' AND (p IN ('bulk', 'list', 'junk') OR regexp_matches(f, '{_ESP}') OR regexp_matches(u, '{_ESP}')) THEN 'promotional' WHEN u <> '' THEN 'newsletter'
 WHEN a NOT IN ('', 'no') THEN 'notification' WHEN p = 'bulk' THEN 'bulk' ELSE 'personal' END AS label FROM h WHERE source IS NOT NULL AND source_uid IS NOT NULL)
"""
for _name, _value, _where in (("label", "newsletter", "label = 'newsletter'"), ("account", "me@lundmail.example", "account = 'me@lundmail.example'"), ("source", "imap:work", "source = 'imap:work'"), ("sent_at", {"since": "2024-06-01", "until": "2025-01-01"}, "sent_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00' AND sent_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'")):
    add(f"sensitive_{_name}", lambda s, d, n=_name, v=_value: engine.matching(_tier(s, d), Spec(filters={n: v}), NOW).select("id"), _DOC + f"SELECT id FROM doc WHERE {_where.replace('TIMESTAMPTZ', 'TIMESTAMPTZ')}")
add("sensitive_keyword", lambda s, d: engine.matching(_tier(s, d), Spec(text="Ferry"), NOW).select("id"), _DOC + "SELECT id FROM doc WHERE subject ILIKE '%ferry%' OR content ILIKE '%ferry%'")
add("sensitive_newest", lambda s, d: engine.page(_tier(s, d), Spec(limit=40), NOW, columns=("id", "subject", "from_addr", "label")), _DOC + "SELECT id, subject, from_addr, label FROM doc ORDER BY sent_at DESC NULLS LAST, id DESC LIMIT 41")
add("sensitive_oldest", lambda s, d: engine.page(_tier(s, d), Spec(order="oldest", limit=40), NOW, columns=("id",)), _DOC + "SELECT id FROM doc ORDER BY sent_at ASC NULLS LAST, id LIMIT 41")
add("sensitive_month_label", lambda s, d: engine.groups(_tier(s, d), Spec(group_by=("month", "label")), NOW),
    _DOC + "SELECT strftime(sent_at AT TIME ZONE 'UTC', '%Y-%m') AS g1, label AS g2, count(*) AS items, min(epoch_us(sent_at)) AS first_us, max(epoch_us(sent_at)) AS last_us FROM doc GROUP BY 1, 2 ORDER BY g1 NULLS LAST, g2 NULLS LAST LIMIT 101")
add("sensitive_account", lambda s, d: engine.groups(_tier(s, d), Spec(group_by=("account",)), NOW),
    _DOC + "SELECT account AS g1, count(*) AS items, min(epoch_us(sent_at)) AS first_us, max(epoch_us(sent_at)) AS last_us FROM doc GROUP BY 1 ORDER BY g1 NULLS LAST LIMIT 101")
add("document_stats", lambda s, d: mail.stats(_documents(s, d)), _DOC + "SELECT label, n FROM (SELECT '(all)' AS label, count(*) AS n FROM doc UNION ALL SELECT label, count(*) FROM doc GROUP BY label) ORDER BY label <> '(all)', n DESC, label")
add("documents_of_source", lambda s, d: mail.document_scan(_documents(s, d), "gmail:personal").select("id"), _DOC + "SELECT id FROM doc WHERE source = 'gmail:personal'")
add("document_point", lambda s, d: _documents(s, d).filter(F.col("id").startswith("gmail:")).groupBy().agg(F.min("id").alias("id")).join(_documents(s, d), "id").select("id", "content", F.col("meta.subject").alias("subject")),
    _DOC + "SELECT id, content, subject FROM doc WHERE id = (SELECT min(id) FROM doc WHERE starts_with(id, 'gmail:'))")
add("mapped_documents", lambda s, d: _documents(s, d).select("id", "meta.source", "meta.account", "meta.subject", "meta.label", F.col("meta.label_confidence").alias("confidence"), F.size("meta.to_addrs").alias("n_to")),
    _DOC + "SELECT d.id, d.source, d.account, d.subject, d.label, CAST(CASE d.label WHEN 'document' THEN 1.0 WHEN 'promotional' THEN 0.9 WHEN 'newsletter' THEN 0.7 WHEN 'notification' THEN 0.8 WHEN 'bulk' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence, CAST(CASE WHEN r.to_addrs IS NULL THEN -1 ELSE len(r.to_addrs) END AS INT) AS n_to FROM doc d JOIN records r ON d.id = r.source || '::' || r.source_uid || '#' || r.delivery_id")

# The enrichment table.
_e = lambda s, d: table(s, d, "enrichments")
_docs = lambda s, d: table(s, d, "records").filter("source is not null and source_uid is not null").groupBy(F.concat("source", F.lit("::"), "source_uid").alias("id"), "source").agg(F.min("delivered_at").alias("ingested_at"))
_DOCS = "SELECT source || '::' || source_uid AS id, source, min(delivered_at) AS ingested_at FROM records WHERE source IS NOT NULL AND source_uid IS NOT NULL GROUP BY 1, 2"
_REJ = "(rejected_reason IS NULL OR rejected_reason NOT LIKE '429:%')"
add("enriched_ids", lambda s, d: enrichment.enriched_ids(_e(s, d)), "SELECT DISTINCT doc_id FROM enrichments WHERE enrichment IS NOT NULL AND doc_id IS NOT NULL")
add("enriched_ids_suffix", lambda s, d: enrichment.enriched_ids(_e(s, d), marker="2"), "SELECT DISTINCT doc_id FROM enrichments WHERE enrichment IS NOT NULL AND doc_id IS NOT NULL AND right(schema_version, 1) = '2'")
add("rejections_by_model", lambda s, d: _e(s, d).select("rejected_model").filter("rejected_model is not null").distinct().groupBy().agg(F.min("rejected_model").alias("m")).join(_e(s, d), F.col("m") == F.col("rejected_model")).filter("doc_id is not null and (rejected_reason is null or rejected_reason not like '429:%')").select("doc_id").distinct(),
    f"SELECT DISTINCT doc_id FROM enrichments WHERE doc_id IS NOT NULL AND rejected_model = (SELECT min(rejected_model) FROM enrichments) AND {_REJ}")
add("enrichment_waiting", lambda s, d: enrichment.backlog(_docs(s, d), _e(s, d)).select("waiting", F.unix_micros("oldest").alias("oldest_us")),
    f"WITH d AS ({_DOCS}) SELECT count(*) AS waiting, min(epoch_us(ingested_at)) AS oldest_us FROM d WHERE NOT EXISTS (SELECT 1 FROM enrichments e WHERE e.doc_id = d.id AND (e.enrichment IS NOT NULL OR (e.rejected_at IS NOT NULL AND {_REJ})))")
add("enrichment_selection", lambda s, d: enrichment.selection_counts(enrichment.selection(_docs(s, d).withColumn("account", F.lit(None).cast("string")), _e(s, d), table(s, d, "source_list"), "none")),
    f"""WITH d AS ({_DOCS}), l AS (SELECT source, max(enrichable) AS may FROM source_list WHERE source IS NOT NULL GROUP BY source), x AS (SELECT d.id, l.source IS NULL AS undeclared, NOT coalesce(l.may, false) AS barred,
 EXISTS (SELECT 1 FROM enrichments e WHERE e.doc_id = d.id AND e.enrichment IS NOT NULL) AS done FROM d LEFT JOIN l ON l.source = d.source)
SELECT count(*) AS scanned, count(*) FILTER (WHERE NOT undeclared AND NOT barred AND NOT done) AS sent, count(*) FILTER (WHERE NOT undeclared AND NOT barred AND done) AS done, count(*) FILTER (WHERE undeclared OR barred) AS ineligible,
 count(*) FILTER (WHERE NOT undeclared AND barred) AS declined, count(*) FILTER (WHERE undeclared) AS undeclared FROM x""")  # fmt: skip
add("write_rejections", lambda s, d: enrichment.write(_one(s, d), _e(s, d).filter("rejected_at is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("rejected_at", "rejected_reason", "rejected_model")).alias("r")).select("doc_id", "r.*"), "rejection").agg(F.count("*").alias("n"), F.count("enriched_at").alias("enriched"), F.count("rejected_at").alias("rejected")),
    "WITH o AS (SELECT doc_id, max(enriched_at) AS at FROM enrichments WHERE enrichment IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id), r AS (SELECT DISTINCT doc_id FROM enrichments WHERE rejected_at IS NOT NULL AND doc_id IS NOT NULL) SELECT count(*) AS n, count(o.at) AS enriched, count(r.doc_id) AS rejected FROM o FULL JOIN r ON o.doc_id = r.doc_id")


def _one(s: SparkSession, d: str) -> DataFrame:
    """The newest enrichment of each document, as a table with a row a document."""
    rows = _e(s, d).filter("enrichment is not null and doc_id is not null")
    empty = {c: F.lit(None).cast(t) for c, t in (("rejected_reason", "string"), ("rejected_model", "string"), ("rejected_at", "timestamp"))}
    return rows.groupBy("doc_id").agg(F.max("enriched_at").alias("enriched_at")).withColumns(empty)


# Projection of facts and text.
_ISO = ", ".join(f"'{c}'" for c in sorted(COUNTRIES))
_PLACES = projection.Policy(redact=projection.Redaction("keep", "keep", "keep", "keep", "keep", "keep", "keep"))
add("projected_facts", lambda s, d: projection.project(projection.latest(_e(s, d)), _PLACES).filter("facts is not null").select("id", "facts.travel.start_date", "facts.travel.end_date", F.col("facts.travel.origin.country").alias("origin"), F.col("facts.travel.destination.country").alias("destination"), F.col("facts.travel.destination.name").alias("place"), "facts.travel.carrier"),
    _E[:-1] + rf""", t AS (SELECT doc_id AS id, enrichment.facts.travel AS t FROM e WHERE NOT (coalesce(enrichment.sensitivity_level = 'high', false) AND coalesce(len(enrichment.people), 0) = 0)),
 p AS (SELECT id, t.start_date AS start_date, t.end_date AS end_date, CASE WHEN upper(trim(t.origin.country)) IN ({_ISO}) THEN upper(trim(t.origin.country)) END AS origin, t.origin.name AS oname,
 CASE WHEN upper(trim(t.destination.country)) IN ({_ISO}) THEN upper(trim(t.destination.country)) END AS destination, t.destination.name AS place, CASE WHEN NOT regexp_matches(lower(strip_accents(t.carrier)), '{NO_CARRIER.replace("'", "''")}') THEN t.carrier END AS carrier FROM t)
SELECT id, start_date, end_date, origin, destination, place, carrier FROM p WHERE start_date IS NOT NULL OR end_date IS NOT NULL OR origin IS NOT NULL OR oname IS NOT NULL OR destination IS NOT NULL OR place IS NOT NULL OR carrier IS NOT NULL""")  # fmt: skip
add("projected_text", lambda s, d: projection.project(projection.latest(_e(s, d))).select("id", "one_line", "action_summary", F.to_json("organizations").alias("organizations")))
add("projected_redactions", lambda s, d: projection.project(projection.latest(_e(s, d))).join(projection.latest(_e(s, d), ["one_line"]).select(F.col("doc_id").alias("id"), F.col("enrichment.one_line").alias("was")), "id").groupBy((~F.col("one_line").eqNullSafe(F.col("was"))).alias("changed")).agg(F.count("*").alias("n")))
add("country_codes", lambda s, d: _e(s, d).select(F.upper(F.trim("enrichment.facts.travel.destination.country")).alias("country")).filter("country is not null").groupBy("country").agg(F.count("*").alias("n")).filter(F.col("country").isin(sorted(COUNTRIES))),
    f"SELECT upper(trim(enrichment.facts.travel.destination.country)) AS country, count(*) AS n FROM enrichments WHERE upper(trim(enrichment.facts.travel.destination.country)) IN ({_ISO}) GROUP BY 1")
add("organization_keys", lambda s, d: _e(s, d).select(F.explode("enrichment.organizations").alias("o")).groupBy(tx.name_key(F.col("o")).alias("key")).agg(F.count("*").alias("n")),
    r"WITH o AS (SELECT unnest(enrichment.organizations) AS o FROM enrichments), k AS (SELECT trim(regexp_replace(regexp_replace(replace(lower(o), '&', ' and '), '[^\w\s\p{L}\p{M}\p{N}]', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM o WHERE o IS NOT NULL), b AS (SELECT p, trim(regexp_replace(p, '\b(inc|ltd|llc|plc|gmbh|corp|corporation|limited|as|ab)$', '')) AS q FROM k) SELECT coalesce(nullif(q, ''), p) AS key, count(*) AS n FROM b GROUP BY 1")

# Changes of stored tables.
_MESSAGES = ("source", "domain", "importance", "policy_hash")
add("upsert_messages", lambda s, d: store.upsert(_slim(s, d), _slim(s, d).filter("importance = 'low'").withColumn("domain", F.lit("other"))).groupBy("domain", "importance").agg(F.count("*").alias("n")),
    _M + "SELECT CASE WHEN importance = 'low' THEN 'other' ELSE domain END AS domain, importance, count(*) AS n FROM m WHERE id IS NOT NULL GROUP BY 1, 2")
add("changed_messages", lambda s, d: store.changed(_slim(s, d), _slim(s, d).withColumn("importance", F.when(F.col("domain") == "travel", F.lit("high")).otherwise(F.col("importance"))), ["importance", "domain"]).select("id"),
    _M + "SELECT id FROM m WHERE id IS NOT NULL AND domain = 'travel' AND importance IS DISTINCT FROM 'high'")
add("delete_newsletters", lambda s, d: store.delete(_slim(s, d), held(s, d, "category").filter("category = 'newsletter'")).agg(F.count("*").alias("n")), _M + "SELECT count(*) AS n FROM m WHERE category IS DISTINCT FROM 'newsletter' AND id IS NOT NULL")
add("set_vectors", lambda s, d: store.set_vectors(held(s, d), held(s, d, "one_line").select("id", F.col("one_line").alias("embedded_text"), F.array(F.lit(0.5).cast("float")).alias("vector")), DIGEST).filter("size(summary_embedding) = 1").select("id"), _M + f"SELECT id FROM m WHERE policy_hash = '{DIGEST}' AND id IS NOT NULL")
add("stale_vectors", lambda s, d: projection.stale_vectors(held(s, d, "one_line", "sent_at", "policy_hash", "embedded_policy_hash"), DIGEST).select("id"), _M + f"SELECT id FROM m WHERE policy_hash = '{DIGEST}' AND embedded_policy_hash IS DISTINCT FROM policy_hash")
add("stale_vectors_first", lambda s, d: projection.stale_vectors(held(s, d, "one_line", "sent_at", "policy_hash", "embedded_policy_hash"), DIGEST, 25).select("id"), _M + f"SELECT id FROM m WHERE policy_hash = '{DIGEST}' AND embedded_policy_hash IS DISTINCT FROM policy_hash ORDER BY sent_at DESC NULLS LAST, id LIMIT 25")
add("stratified_items", lambda s, d: store.stratified(table(s, d, "eval_items").select("id", "labels.category"), "category", "id", 60).select("id", "category"),
    "SELECT id, category FROM (SELECT id, labels.category AS category, sha256(CAST(id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY labels.category ORDER BY sha256(CAST(id AS VARCHAR)), id) AS rn FROM eval_items) ORDER BY rn, category NULLS FIRST, h LIMIT 60")


def _slim(s: SparkSession, d: str) -> DataFrame:
    return held(s, d, *_MESSAGES).filter("id is not null")


# The archive.
_ALL = [archive.Folder("INBOX"), archive.Folder("Archive")]
add("purge_folders", lambda s, d: archive.purge_counts(archive.purge_plan(_docs(s, d), "imap:work", archive.FolderPolicy(excluded=frozenset({"archive"})), _ALL)),
    "WITH d AS (" + _DOCS + r"), f AS (SELECT id, regexp_extract(id, '^imap:work::(.+):[1-9][0-9]*:[1-9][0-9]*$', 1, 's') AS folder FROM d WHERE source = 'imap:work' AND regexp_full_match(id, 'imap:work::[^\x00-\x1f]+:[1-9][0-9]*:[1-9][0-9]*')) SELECT folder, count(*) AS n FROM f WHERE lower(folder) = 'archive' OR lower(folder) LIKE 'archive/%' OR (lower(folder) <> 'inbox' AND regexp_matches(lower(folder), '^(inbox/)?(junk|junk mail|junk e-mail|spam|trash|deleted items|deleted messages|søppelpost|slettede elementer|papirkurv|drafts|utkast)(/|$)')) GROUP BY folder ORDER BY folder")
add("vault_paths", lambda s, d: _docs(s, d).select("id", archive.vault_path(F.col("id")).alias("path")),
    "WITH d AS (" + _DOCS + r"), u AS (SELECT id, split_part(id, '::', 1) AS src, substr(id, strpos(id, '::') + 2) AS uid FROM d), k AS (SELECT *, CASE WHEN regexp_full_match(uid, '[A-Za-z0-9._-]{1,120}') THEN uid ELSE substr(sha1(id), 1, 24) END AS stem FROM u) SELECT id, replace(src, ':', '/') || '/' || substr(stem, 1, 2) || '/' || stem || '.md' AS path FROM k")

# Evaluation.
_latest = lambda s, d, *f: projection.latest(_e(s, d), list(f)).select(F.col("doc_id").alias("id"), *[F.col(f"enrichment.{x}").alias(x) for x in f])
_both = lambda s, d, c: _latest(s, d, c).withColumnRenamed(c, "gold").join(held(s, d, c).withColumnRenamed(c, "pred"), "id")
_P = lambda c: _M[:-1] + ", " + _E[5:-1] + f", p AS (SELECT m.id, e.enrichment.{c} AS gold, m.{c} AS pred FROM e JOIN m ON m.id = e.doc_id)\n"
add("metric_flag_precision", lambda s, d: metrics.ratio(_both(s, d, "requires_action").filter("pred").select(F.coalesce("gold", F.lit(False)).cast("int").alias("num"), F.lit(1).alias("den"))).select(F.round("value", 9).alias("value"), "n"),
    _P("requires_action") + "SELECT round(avg(CASE WHEN coalesce(gold, false) THEN 1.0 ELSE 0.0 END), 9) AS value, count(*) AS n FROM p WHERE pred")
_RANKED = "CASE {} WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"
add("metric_sensitivity", lambda s, d: metrics.ordinal_error(_both(s, d, "sensitivity_level").filter("gold is not null and pred is not null"), engine.sensitivity_rank).select(F.round("mae", 9).alias("mae"), F.round("under", 9).alias("under")),
    _P("sensitivity_level") + f"SELECT round(avg(CAST(abs({_RANKED.format('gold')} - {_RANKED.format('pred')}) AS DOUBLE)), 9) AS mae, round(avg(CASE WHEN {_RANKED.format('pred')} < {_RANKED.format('gold')} THEN 1.0 ELSE 0.0 END), 9) AS under FROM p WHERE gold IS NOT NULL AND pred IS NOT NULL")
add("metric_percentiles", lambda s, d: metrics.summary(table(s, d, "orders"), "o_totalprice").select(*[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95")], "n"),
    "SELECT round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, count(o_totalprice) AS n FROM orders")
add("metric_organizations", lambda s, d: metrics.multiset_overlap(_both(s, d, "organizations"), "gold", "pred"),
    _P("organizations") + "SELECT CAST(coalesce(sum(least(g, q)), 0) AS BIGINT) AS hits, CAST(coalesce(sum(g), 0) AS BIGINT) AS gold_n, CAST(coalesce(sum(q), 0) AS BIGINT) AS pred_n FROM (SELECT id, v, count(*) FILTER (WHERE side = 'g') AS g, count(*) FILTER (WHERE side = 'p') AS q FROM (SELECT id, 'g' AS side, unnest(gold) AS v FROM p UNION ALL SELECT id, 'p', unnest(pred) FROM p) GROUP BY id, v)")
add("metric_entities", lambda s, d: metrics.entity_overlap(_both(s, d, "organizations"), "gold", "pred"))
add("metric_org_recall", lambda s, d: metrics.ratio(_latest(s, d, "organizations", "one_line", "abstract").filter("size(organizations) > 0").select(F.size(F.filter("organizations", lambda o: F.contains(F.lower(F.concat_ws("\n", "one_line", "abstract")), F.lower(o)))).alias("num"), F.size("organizations").alias("den"))).select(F.round("value", 9).alias("value"), "n"),
    _E[:-1] + ", t AS (SELECT enrichment.organizations AS o, lower(concat_ws(chr(10), enrichment.one_line, enrichment.abstract)) AS x FROM e WHERE len(enrichment.organizations) > 0) SELECT round(CAST(sum(len(list_filter(o, lambda v: contains(x, lower(v))))) AS DOUBLE) / sum(len(o)), 9) AS value, count(*) AS n FROM t")
add("metric_travel", lambda s, d: metrics.travel_accuracy(_latest(s, d, "facts").join(held(s, d, "facts").withColumnRenamed("facts", "f"), "id").select("id", F.col("facts.travel").alias("gold"), F.col("f.travel").alias("pred"))).select(F.round("presence", 9).alias("presence"), F.round("fields", 9).alias("fields")),
    _M[:-1] + ", " + _E[5:-1] + """, p AS (SELECT e.enrichment.facts.travel AS g, m.facts.travel AS q FROM e JOIN m ON m.id = e.doc_id)
SELECT round(avg(CASE WHEN (g IS NOT NULL) = (q IS NOT NULL) THEN 1.0 ELSE 0.0 END), 9) AS presence, round(CAST(sum(CASE WHEN g IS NOT NULL THEN CAST(g.start_date IS NOT DISTINCT FROM q.start_date AS INT) + CAST(g.end_date IS NOT DISTINCT FROM q.end_date AS INT) + CAST(g.origin.country IS NOT DISTINCT FROM q.origin.country AS INT)
 + CAST(g.destination.country IS NOT DISTINCT FROM q.destination.country AS INT) + CAST(lower(trim(g.carrier)) IS NOT DISTINCT FROM lower(trim(q.carrier)) AS INT) END) AS DOUBLE) / (5 * count(g)), 9) AS fields FROM p""")  # fmt: skip
add("metric_disagreements", lambda s, d: metrics.disagreements(_runs(s, d), ["domain", "importance"]).select("id", "axes_n", F.array_join("axes", ",").alias("axes")),
    _M[:-1] + ", " + _E[5:-1] + ", p AS (SELECT m.id, e.enrichment.domain IS DISTINCT FROM m.domain AS a, e.enrichment.importance IS DISTINCT FROM m.importance AS b FROM e JOIN m ON m.id = e.doc_id) SELECT id, CAST(CAST(a AS INT) + CAST(b AS INT) AS INT) AS axes_n, concat_ws(',', CASE WHEN a THEN 'domain' END, CASE WHEN b THEN 'importance' END) AS axes FROM p WHERE a OR b")
add("metric_gaps", lambda s, d: metrics.gaps(table(s, d, "eval_items").select("labels.domain"), s.createDataFrame([(v,) for v in VOCABULARY["domain"]], "value string"), "domain"),
    "SELECT v.value, count(i.item_id) AS n FROM (SELECT unnest([" + ", ".join(f"'{v}'" for v in VOCABULARY["domain"]) + "]) AS value) v LEFT JOIN eval_items i ON i.labels.domain = v.value GROUP BY v.value")
add("metric_bootstrap", lambda s, d: metrics.bootstrap(_both(s, d, "domain").select("id", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int").alias("num"), F.lit(1).alias("den")), resamples=200).select(F.round("value", 9).alias("value"), "n"),
    _P("domain") + "SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 9) AS value, count(*) AS n FROM p")
add("metric_leaks", lambda s, d: metrics.leak_rate(_latest(s, d, "one_line", "people", "organizations").select(F.col("one_line").alias("text"), F.transform("people", lambda p: p["name"]).alias("people"), F.lit(None).cast("array<string>").alias("references"), "organizations")))
add("audit_units", lambda s, d: metrics.audit_units(_e(s, d).filter("secret_candidates is not null").select(F.col("doc_id").alias("id"), F.col("secret_candidates").alias("candidates"), F.create_map().cast("map<string,string>").alias("seeded"), "secret_audit.findings")).groupBy("type", "predicted").agg(F.count("*").alias("n")))


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Two runs over the same records: the enrichment's values and those of the tier."""
    a = _latest(s, d, "domain", "importance").join(held(s, d, "domain").select("id"), "id").withColumn("run", F.lit("a"))
    b = held(s, d, "domain", "importance").join(_latest(s, d, "domain").select("id"), "id").withColumn("run", F.lit("b"))
    return a.unionByName(b).withColumn("valid", F.lit(True))


