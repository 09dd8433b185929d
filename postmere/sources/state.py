"""Small states of runs: a source's cursor, stored tables with their columns, and the record of calls and runs."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CURSORS = "source string, fetch_cursor string, updated_at timestamp"


def cursor_of(state: DataFrame, source: str) -> str | None:
    """A source's cursor; of several rows the latest."""
    row = state.filter(F.col("source") == source).agg(F.max_by("fetch_cursor", F.struct("updated_at", "fetch_cursor")).alias("c")).first()
    return row["c"]


def with_cursor(state: DataFrame, source: str, cursor: str, now: dt.datetime) -> DataFrame:
    """The state with a source's cursor in place of earlier ones."""
    new = state.sparkSession.createDataFrame([(source, cursor, now)], CURSORS)
    return state.filter(~F.col("source").eqNullSafe(F.lit(source))).select("source", "fetch_cursor", "updated_at").unionByName(new)


def imap_cursor(folders: Mapping[str, tuple[int, int]]) -> str:
    """``{folder: "validity:uid"}`` of the greatest uid fetched of each folder."""
    return json.dumps({f: f"{v}:{u}" for f, (v, u) in sorted(folders.items())})


def since(cursor: str | None, folder: str, validity: int) -> int:
    """The first uid to fetch of a folder: behind the cursor's, or 1 for a new folder or another validity."""
    at = (json.loads(cursor) if cursor else {}).get(folder)
    was, _, uid = (at or "").partition(":")
    return int(uid) + 1 if uid.isdigit() and was == str(validity) else 1


def next_cursor(messages: DataFrame, cursor: str | None = None) -> str:
    """The cursor behind ``folder, uidvalidity, imap_uid``: per folder the greatest uid of its greatest validity. One row a folder comes to the driver."""
    rows = messages.filter("folder is not null").groupBy("folder").agg(F.max(F.struct("uidvalidity", "imap_uid")).alias("m")).collect()
    old = {f: tuple(map(int, v.split(":"))) for f, v in (json.loads(cursor) if cursor else {}).items()}
    return imap_cursor({**old, **{r["folder"]: max((r["m"][0], r["m"][1]), old.get(r["folder"], (0, 0))) for r in rows}})


def conform(stored: DataFrame, schema: str, copies: Mapping[str, str] | None = None) -> DataFrame:
    """A stored table in the columns of today's *schema*: missing ones are NULL, or a copy of another column (*copies*: new to old), further ones go."""
    have, copies = set(stored.columns), dict(copies or {})
    wanted = StructType.fromDDL(schema)
    of = lambda f: F.col(f.name) if f.name in have else F.col(copies[f.name]) if copies.get(f.name) in have else F.lit(None)
    return stored.select(*[of(f).cast(f.dataType).alias(f.name) for f in wanted])


def shape(value: Any) -> Any:
    """What an audit may say of an argument: its kind and size, never its text."""
    if isinstance(value, str):
        return {"str": len(value)}
    if isinstance(value, Mapping):
        return {str(k): shape(v) for k, v in sorted(value.items())}
    if isinstance(value, (list, tuple)):
        return {"list": len(value)}
    return value if value is None or isinstance(value, (bool, int, float)) else type(value).__name__


def audited(call: Callable[..., dict], tool: str, principal: str, sink: Callable[[dict], None], clock: Callable[[], float]) -> Callable[..., dict]:
    """*call* with an event to *sink* after each: who, which tool, the shapes of the arguments, rows, milliseconds, outcome."""

    def run(*args: Any, **kwargs: Any) -> dict:
        began, event = clock(), {"tool": tool, "principal": hashlib.sha256(principal.encode()).hexdigest()[:12], "arguments": shape({**{str(k): v for k, v in enumerate(args)}, **kwargs})}
        try:
            out = call(*args, **kwargs)
        except Exception as e:
            sink({**event, "outcome": type(e).__name__, "ms": round((clock() - began) * 1000)})
            raise
        sink({**event, "outcome": "ok", "rows": out.get("count"), "ms": round((clock() - began) * 1000)})
        return out

    return run


def gauges(actions: DataFrame) -> DataFrame:
    """``name, value`` of a run's ``action`` counts, a row each, as gauges are scraped."""
    return actions.groupBy(F.concat(F.lit("rows_"), "action").alias("name")).agg(F.count("*").alias("value"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
