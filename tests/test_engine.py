"""The query model over the twelve rows of the golden fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmere.operators.projection import Policy
from postmere.plans import engine, served
from postmere.plans.spec import PRESETS, SANITIZED, SENSITIVE, Spec, day, instant

NOW = dt.datetime(2026, 6, 1, tzinfo=dt.UTC)
SCHEMA = """id string, domain string, sent_at timestamp, importance string, time_sensitive boolean, requires_action boolean, deadline date, sensitivity_level string, organizations array<string>,
one_line string, action_summary string, waiting_on string, sender_domain string, summary_embedding array<float>, policy_hash string, embedded_policy_hash string"""


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC) if text else None


@pytest.fixture(scope="module")
def rows(spark):
    def row(i, domain, sent, importance, vec, *, ts=False, act=False, due=None, sens="none", orgs=None, one=None, summary=None):
        return (i, domain, sent, importance, ts, act, due, sens, orgs, one, summary, "none", None, [float(x) for x in vec], "h", "h")

    data = [
        row("t1", "travel", at("2025-01-15 09:00"), "high", [1, 0], due=dt.date(2025, 1, 20), orgs=["ACME Travel AS"], one="Flight to Tromsø booked"),
        row("t2", "travel", at("2025-03-02 10:00"), "low", [0.9, 0.1], sens="low", orgs=["Fjordline"]),
        row("t3", "travel", at("2025-03-02 10:00"), "medium", [0.8, 0.2], sens="medium", summary="Pay the ferry deposit"),
        row("t4", "travel", at("2025-12-31 23:30"), "high", [0.7, 0.3], ts=True, sens="high"),
        row("t5", "travel", at("2024-12-31 23:59"), "low", [0, 1]), row("t6", "travel", at("2026-01-01 00:00"), "low", [0.1, 0.9]),
        row("w1", "work", at("2025-03-02 10:00"), "high", [0, 0], act=True, orgs=["acme corp"], due=dt.date(2025, 3, 10)), row("w2", "work", at("2025-03-02 10:00"), "high", [0, 0], act=True, due=dt.date(2025, 3, 10)),
        row("b1", "banking", NOW - dt.timedelta(days=3), "medium", [0, 0], due=(NOW + dt.timedelta(days=5)).date(), sens=None), row("b2", "banking", NOW - dt.timedelta(days=30), "medium", [0, 0], due=(NOW - dt.timedelta(days=20)).date()),
        row("n1", "other", None, "low", [0, 0]), row("n2", "other", None, "low", [0, 0]),
    ]
    return spark.createDataFrame(data, SCHEMA).cache()


GOLD = {
    "newest": "b1 b2 t6 t4 w2 w1 t3 t2 t1 t5 n2 n1", "oldest": "t5 t1 t2 t3 w1 w2 t4 t6 b2 b1 n1 n2",
    "priority": "t4 w1 w2 t1 b1 b2 t3 t6 t2 t5 n1 n2", "deadline": "t1 w1 w2 b2 b1 t4 t3 t6 t2 t5 n1 n2",
}


@pytest.mark.parametrize("order", GOLD)
@pytest.mark.parametrize("size", [1, 5, 100])
def test_pages_drain_to_the_whole_order(rows, order, size):
    tier, got, position = engine.Tier(rows, PRESETS), [], None
    while True:
        page = engine.page(tier, Spec(order=order, limit=size), NOW, position).select("id", F.unix_micros("sent_at").alias("us")).collect()
        got += [r["id"] for r in page[:size]]
        if len(page) <= size:
            break
        position = (page[size - 1]["us"], page[size - 1]["id"]) if order in ("newest", "oldest") else len(got)
    assert got == GOLD[order].split()


def ids(rows, **spec):
    return sorted(r["id"] for r in engine.matching(engine.Tier(rows, PRESETS), Spec(**spec), NOW).collect())


def test_filters_keep_three_valued_logic(rows):
    assert ids(rows, filters={"max_sensitivity": "low"}) == ["b2", "n1", "n2", "t1", "t2", "t5", "t6", "w1", "w2"]
    assert ids(rows, filters={"organization": "acme"}) == ["t1", "w1"]
    assert ids(rows, filters={"due": True}) == ["b1", "b2", "t1", "t4", "w1", "w2"]
    assert ids(rows, text="DEPOSIT") == ["t3"] and ids(rows, text="tromsØ") == ["t1"] and ids(rows, text="%") == []
    assert ids(rows, filters={"domain": "travel", "sent_at": {"since": "2025-01-01", "until": "2026-01-01"}}) == ["t1", "t2", "t3", "t4"]


def test_groups(rows):
    tier = engine.Tier(rows, PRESETS)
    spec = Spec(filters={"sent_at": {"since": "2025-01-01", "until": "2026-01-01"}}, group_by=("month", "domain"))
    assert [tuple(r)[:3] for r in engine.groups(tier, spec, NOW).collect()] == [("2025-01", "travel", 1), ("2025-03", "travel", 2), ("2025-03", "work", 2), ("2025-12", "travel", 1)]
    spec = Spec(filters={"domain": "travel"}, group_by=("organization",))
    assert [tuple(r)[:2] for r in engine.groups(tier, spec, NOW).collect()] == [("ACME Travel AS", 1), ("Fjordline", 1), (None, 4)]
    assert engine.total(tier, spec, NOW).first()["total"] == 6


def test_nearest_leaves_zero_vectors_last(rows):
    got = engine.nearest(engine.Tier(rows, PRESETS), Spec(semantic=(1.0, 0.0), limit=5), NOW).collect()
    assert [r["id"] for r in got] == ["t1", "t2", "t3", "t4", "t6", "t5"]  # one more than the limit tells that there are others


@pytest.mark.parametrize(
    "spec",
    [{"filters": {"domain": []}}, {"filters": {"domain": "space"}}, {"filters": {"nothing": 1}}, {"order": "random"}, {"limit": 0}, {"semantic": (1.0,), "order": "newest"}, {"group_by": ("domain", "domain")},
     {"filters": {"facts.travel.origin_country": "NOR"}}, {"filters": {"sent_at": {"after": "2025"}}}, {"text": ""}],
)
def test_bad_specs_are_refused(spec):
    with pytest.raises(ValueError):
        Spec(**spec)


def test_policy_refuses_by_name():
    for spec in (Spec(filters={"due": True}), Spec(group_by=("suggested_disposition",))):
        with pytest.raises(ValueError, match="not allowed"):
            SANITIZED.check(spec)
    with pytest.raises(ValueError, match="domain"):
        SENSITIVE.check(Spec(filters={"domain": "work"}))


def test_bounds():
    assert instant("14d", NOW) == NOW - dt.timedelta(days=14)
    assert instant("2025-01-01", NOW) == dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    assert day(at("2025-01-01 00:00"), True) == dt.date(2025, 1, 1) and day(at("2025-01-01 00:01"), True) == dt.date(2025, 1, 2)


def test_served_hides_stale_text(spark):
    cols = {c: F.lit(None).cast("string") for c in served.COLUMNS}
    base = spark.createDataFrame([("a", "travel", "x secret", "p1", "p1"), ("b", None, "y secret", "p0", "p0")], "id string, domain string, one_line string, policy_hash string, embedded_policy_hash string")
    rows = base.withColumns({c: v for c, v in cols.items() if c not in base.columns} | {"summary_embedding": F.lit(None).cast("array<float>")})
    got = {r["id"]: (r["one_line"], r["vector_current"]) for r in served.served(rows, "p1").collect()}
    assert got == {"a": ("x secret", True), "b": ("[pending redaction] other item", False)}


def test_policy_digest():
    assert Policy().digest() == "fab6fa4570f21e69"
