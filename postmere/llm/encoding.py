"""Finding and undoing wrong character decoding.

Expectation-maximisation over latent encoding chains. A chain is the wrong decoding (or several) that a text went
through; undoing it gives the text it would have been. What right text looks like is a character model, and how
common each chain is in a source and field is a prior; both are unknown and estimated together from all records, so
that one doubtful letter in a short subject profits from everything its source sent. Then the chain of each text is
chosen by its posterior, over all its words at once.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.sources.tables import canonical, materialize, ship_package

FIELDS = ("subject", "content", "from_addr")
BITS = 18
#: Places of sources; rounds at most, and the change of a chain's share from which on no further round is needed.
SOURCES, ROUNDS, SETTLED = 4096, 8, 0.002
#: Share of a garbled text's words that may be right all the same, for texts garbled in part.
MIXED = 0.5
#: Log odds against right text whose characters happen to be valid UTF-8 byte for byte.
CHANCE = 4.0
#: A word with a character outside ASCII; the no-break space is part of garbled words.
TOKEN = r"[^ \t\r\n]*[^\x00-\x7F][^ \t\r\n]*"

# The decodings that a chain undoes, as (wrongly read as, written as), last step first.
_ONE = [("cp1252", e) for e in ("mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "iso8859_2", "cp1250")]
_ONE += [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252")]
_UTF8 = ("cp1252", "mac_roman", "cp1251", "koi8_r", "cp1250", "cp437", "cp850", "iso8859_2", "iso8859_15")
CHAINS: list[tuple[tuple[str, str], ...]] = [()]
CHAINS += [((w, "utf8"),) for w in _UTF8]
CHAINS += [(("cp1252", "utf8"),) * n for n in (2, 3)]
CHAINS += [((a, "utf8"), (b, "utf8")) for a, b in (("mac_roman", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"))]
CHAINS += [(p,) for p in _ONE]

_HIGH = re.compile(r"[^\x00-\x7f]+")
_MARKS = re.compile("[�\x80-\x84\x86-\x9f]")


@functools.cache
def _to_byte(codec: str) -> dict[int, int]:
    """Code point to byte of a single-byte codec; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b
    for b in range(128, 160):
        table.setdefault(b, b)
    return table


@functools.cache
def _step(wrong: str, true: str):
    """A function that undoes one wrong decoding in a run of characters outside ASCII, or gives None."""
    to = _to_byte(wrong)
    if true == "utf8":

        def undo(run: str) -> str | None:
            try:
                text = bytes([to[ord(c)] for c in run]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                return None
            # two right characters may be one of a remote script by chance
            return None if len(text) == 1 and ("\u0250" <= text <= "\u036f" or "\u0500" <= text <= "\u07ff") else text

        return undo
    back = {}
    for c, b in to.items():
        try:
            ch = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        if ch.isprintable() or ch == "\xa0":
            back[c] = ch
    return lambda run: "".join(back[ord(c)] for c in run) if all(ord(c) in back for c in run) else None


def undo(token: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """*token* with a chain undone in each run it fits, or None if it fits none."""
    changed = False
    for wrong, true in chain:
        fix = _step(wrong, true)
        hit = False

        def sub(m: re.Match, fix=fix) -> str:
            nonlocal hit
            got = fix(m.group())
            if got is None or got == m.group():
                return m.group()
            hit = True
            return got

        token = _HIGH.sub(sub, token)
        if not hit:
            return None
        changed = True
    return token if changed else None


@functools.lru_cache(100_000)
def candidates(token: str) -> tuple[tuple[int, str], ...]:
    """``(chain, text)`` of each chain that fits; chain 0 leaves the token as it is."""
    out = [(0, token)]
    for k, chain in enumerate(CHAINS[1:], 1):
        if (t := undo(token, chain)) is not None and not _MARKS.search(t):
            out.append((k, t))
    return tuple(out)


def is_utf8(token: str) -> bool:
    """Whether some of a token's characters are UTF-8 bytes in a wrong decoding."""
    return any(k and CHAINS[k][0][1] == "utf8" for k, _ in candidates(token))


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of a text's character triples and of their first two characters."""
    codes = np.frombuffer(("\x02\x02" + text + "\x03").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    mask = np.uint64((1 << BITS) - 1)
    two = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFFFFFF)
    three = two * np.uint64(31) + codes[2:] * np.uint64(0xC2B2AE3D)
    spread = lambda x: ((x ^ (x >> np.uint64(17))) * np.uint64(0xED5AD4BB) >> np.uint64(13)) & mask
    return spread(three), spread(two)


class Model:
    """Character counts in hashed tables of a fixed size, and chain priors by source and field."""

    def __init__(self, three: np.ndarray, two: np.ndarray, priors: dict[str, dict[int, float]]):
        self.three, self.two, self.priors = three, two, priors
        self._cache: dict[str, float] = {}
        self._options: dict[str, tuple[bool, list[tuple[int, float, str]]]] = {}

    def loglik(self, text: str) -> float:
        got = self._cache.get(text)
        if got is None:
            if len(self._cache) > 300_000:
                self._cache.clear()
            a, b = _grams(text)
            got = self._cache[text] = float(np.log((self.three[a] + 0.002) / (self.two[b] + 1.0)).sum())
        return got

    def as_is(self, token: str) -> float:
        """Log likelihood that a token is right text."""
        return self.loglik(token) - CHANCE * is_utf8(token)

    def prior(self, group: str, chain: int) -> float:
        """Log prior; a group seen rarely leans on all groups together."""
        every, own = self.priors.get("", {}), self.priors.get(group, {})
        n_all, n = sum(every.values()), sum(own.values())
        base = (every.get(chain, 0.0) + (20.0 if chain == 0 else 0.02)) / (n_all + 20.0 + 0.02 * (len(CHAINS) - 1))
        return math.log((own.get(chain, 0.0) + 50.0 * base) / (n + 50.0))

    def options(self, token: str) -> tuple[bool, list[tuple[int, float, str]]]:
        """Whether a token shows loss, and what each chain that fits it adds to the log likelihood of its text, in
        which a share of the words may be right all the same."""
        got = self._options.get(token)
        if got is None:
            if len(self._options) > 200_000:
                self._options.clear()
            same, found = self.as_is(token), []
            for k, text in candidates(token)[1:]:
                x, y = math.log(1 - MIXED) + self.loglik(text), math.log(MIXED) + same
                found.append((k, max(x, y) + math.log1p(math.exp(-abs(x - y))) - same, text))
            got = self._options[token] = (bool(_MARKS.search(token)), found)
        return got

    def posterior(self, token: str, group: str) -> list[tuple[int, str, float]]:
        found = candidates(token)
        if len(found) == 1:
            return [(0, token, 1.0)]
        scores = [self.prior(group, k) + (self.loglik(t) if k else self.as_is(token)) for k, t in found]
        top = max(scores)
        weights = [math.exp(s - top) for s in scores]
        total = sum(weights)
        return [(k, t, w / total) for (k, t), w in zip(found, weights, strict=True)]


def _first_guess(token: str, hint: int) -> list[tuple[int, str, float]]:
    """Before any model: text that is valid UTF-8 byte for byte is hardly so by chance, and a rare word that one
    chain turns into a common one is likely that one (*hint*, of :func:`_hints`)."""
    found = candidates(token)
    if hint:
        return [(0, token, 0.05), (hint, next(t for k, t in found if k == hint), 0.95)]
    multi = [(k, t) for k, t in found if k and CHAINS[k][0][1] == "utf8"]
    if not multi:
        return [(0, token, 1.0)]
    k, t = min(multi, key=lambda x: (len(x[1]), x[0]))
    return [(0, token, 0.05), (k, t, 0.95)]


def tokens_of(records: DataFrame) -> DataFrame:
    """``delivery_id, field, source, tokens``: the words with characters outside ASCII, of texts that have any."""
    # sources by their place in a table of a fixed size, which bounds the number of priors; sources at one place share theirs
    src = F.pmod(F.xxhash64(F.coalesce(canonical(F.col("source")), F.lit(""))), F.lit(SOURCES)).cast("string")
    one = lambda f: F.struct(F.lit(f).alias("field"), F.when(F.col(f).rlike(r"[^\x00-\x7F]"), F.regexp_extract_all(F.col(f), F.lit(TOKEN), F.lit(0))).alias("tokens"))
    rows = records.filter("delivery_id is not null").select("delivery_id", src.alias("source"), F.explode(F.array(*[one(f) for f in FIELDS])).alias("_x"))
    return rows.select("delivery_id", "source", "_x.field", "_x.tokens").filter("tokens is not null")


def _hints(counts: DataFrame, times: int = 3) -> DataFrame:
    """``token, hint``: the single-byte chain whose undoing gives a word at least *times* as common, if any."""
    total = counts.groupBy("token").agg(F.sum("count").alias("n"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, n, c, k) for t, n in zip(pdf["token"], pdf["n"], strict=True) if not is_utf8(t) for k, c in candidates(t) if k and not is_utf8(c)]
            yield pd.DataFrame(out, columns=["token", "own", "word", "chain"])

    tried = total.mapInPandas(spread, "token string, own bigint, word string, chain int")
    known = tried.join(total.withColumnRenamed("token", "word"), "word").filter(F.col("n") >= times * F.col("own"))
    return known.groupBy("token").agg(F.max_by("chain", F.struct("n", -F.col("chain"))).alias("hint"))


def fit(tokens: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimate model and priors from all tokens.

    A token's count in a source and field is all that a round needs, so tokens are counted once (combined before the
    shuffle). A round returns sums of a fixed size to the driver: two tables of 2**BITS places and a number for each
    chain in each field and place of sources. Rounds end when no chain's share changes by :data:`SETTLED`, at the latest after *rounds*.
    """
    spark = tokens.sparkSession
    counts = tokens.select(F.concat_ws("|", "field", "source").alias("group"), F.explode("tokens").alias("token")).groupBy("group", "token").count()
    counts = materialize(counts, "tokens")
    counts = materialize(counts.join(_hints(counts), "token", "left").select("group", "token", "count", F.coalesce("hint", F.lit(0)).alias("hint")), "hints")
    model: Model | None = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(None if model is None else (model.three, model.two, model.priors))

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now = None if shared.value is None else Model(*shared.value)
            three, two = np.zeros(1 << BITS), np.zeros(1 << BITS)
            chains: dict[tuple[str, int], float] = defaultdict(float)
            for pdf in batches:
                for group, token, n, hint in zip(pdf["group"], pdf["token"], pdf["count"], pdf["hint"], strict=True):
                    if "�" in token:
                        continue
                    for k, text, w in _first_guess(token, hint) if now is None else now.posterior(token, group):
                        if w < 1e-3:
                            continue
                        a, b = _grams(text)
                        # a word's weight grows slower than its count, else a few frequent words are the model
                        np.add.at(three, a, w * n**0.75)
                        np.add.at(two, b, w * n**0.75)
                        chains[group, k] += w * n
            for kind, table in (("3", three), ("2", two)):
                at = np.flatnonzero(table)
                yield pd.DataFrame({"kind": kind, "at": at.astype("int64"), "value": table[at]})
            if chains:
                yield pd.DataFrame({"kind": [g for g, _ in chains], "at": [k for _, k in chains], "value": list(chains.values())})

        sums = counts.mapInPandas(expect, "kind string, at bigint, value double").groupBy("kind", "at").agg(F.sum("value").alias("value")).toPandas()
        tables = []
        for kind in ("3", "2"):
            table, part = np.zeros(1 << BITS), sums[sums["kind"] == kind]
            table[part["at"].to_numpy()] = part["value"].to_numpy()
            tables.append(table)
        priors: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for r in sums[~sums["kind"].isin(["2", "3"])].itertuples(index=False):
            priors[r.kind][int(r.at)] += r.value
            priors[""][int(r.at)] += r.value
        was = _chain_shares(model)
        model = Model(*tables, {g: dict(p) for g, p in priors.items()})
        shared.unpersist()
        now_ = _chain_shares(model)
        if was is not None and max((abs(now_[k] - was[k]) for k in range(len(CHAINS))), default=0.0) < SETTLED:
            break
    return model


def _chain_shares(model: Model | None) -> list[float] | None:
    """The share of each chain among the words outside of right text, relative to all garbled words and 1 % of the others."""
    if model is None:
        return None
    every = model.priors.get("", {})
    total = sum(n for k, n in every.items() if k) + 0.01 * every.get(0, 0.0) + 1e-9
    return [every.get(k, 0.0) / total if k else 0.0 for k in range(len(CHAINS))]


_STATE: dict[str, tuple[Model, dict[str, set[str]]]] = {}


def _worker_state(shared) -> tuple[Model, dict[str, set[str]]]:
    """The model and the words found to be right, kept by a worker from task to task."""
    key, *tables = shared.value
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Model(*tables), defaultdict(set)
    return _STATE[key]


def judge(model: Model, group: str, tokens: list[str]) -> tuple[int, dict[str, str]] | None:
    """The chain of one text and what its garbled words should be, or None if the text is right.

    Chain -1: something is lost (replacement or control characters) and no chain explains the rest.
    """
    lost = False
    gains: dict[int, float] = {}
    for t in tokens:
        marked, options = model.options(t)
        lost = lost or marked
        for k, gain, _ in options:
            gains[k] = gains.get(k, 0.0) + gain
    best, chain = model.prior(group, 0), 0
    for k, gain in gains.items():
        if (score := model.prior(group, k) + gain) > best:
            best, chain = score, k
    if not chain:
        return (-1, {}) if lost else None
    fixes = {t: text for t in tokens for k, _, text in model.options(t)[1] if k == chain and model.loglik(text) > model.as_is(t)}
    if not fixes:
        return (-1, {}) if lost else None
    return chain, fixes


def find_garbled(records: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``delivery_id, field, chain, fixes``: each field that holds wrongly decoded text.

    ``chain`` names the wrong decodings, ``lost`` if none explains the text; ``fixes`` maps each garbled word to the
    word it was, as far as it survives. Null and empty fields and texts in ASCII are right; rows without ``delivery_id`` are left out. Escapes of transfer or
    HTML are ASCII and thus no case. Repeated rows are judged alike, each for itself; other columns are ignored.
    """
    spark = records.sparkSession
    ship_package(spark)
    tokens = tokens_of(records)
    model = fit(tokens, rounds)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model.three, model.two, model.priors))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clear = _worker_state(shared)
        for pdf in batches:
            out = []
            for i, source, field, text in zip(pdf["delivery_id"], pdf["source"], pdf["field"], pdf["tokens"], strict=True):
                toks = text.split("\n")
                group = f"{field}|{source}"
                sure = clear[group]
                if sure.issuperset(toks):
                    continue
                doubt = False
                for t in toks:
                    if t not in sure:
                        # surely right, whatever the rest of the text says
                        if _MARKS.search(t) or now.posterior(t, group)[0][2] <= 0.9999:
                            doubt = True
                            break
                        if len(sure) < 500_000:
                            sure.add(t)
                if doubt and (got := judge(now, group, toks)):
                    chain, fixes = got
                    out.append((i, field, "lost" if chain < 0 else "+".join(f"{w}>{e}" for w, e in CHAINS[chain]), list(fixes), list(fixes.values())))
            yield pd.DataFrame(out, columns=["delivery_id", "field", "chain", "bad", "good"])

    rows = tokens.select("delivery_id", "source", "field", F.array_join("tokens", "\n").alias("tokens")).mapInPandas(judged, "delivery_id bigint, field string, chain string, bad array<string>, good array<string>")
    return rows.select("delivery_id", "field", "chain", F.map_from_arrays("bad", "good").alias("fixes"))


def repaired(text, fixes):
    """A text column with each word that ``fixes`` has replaced, in one pass over whole words: neither a part of another word nor what a replacement
    put there is touched."""
    parts = F.split(text, r"(?<=[ \t\r\n])|(?=[ \t\r\n])")
    return F.coalesce(F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(fixes, w), w)), ""), text)
