"""Evaluation texts leaking into training text.

Latent semantic retrieval: passages of both sides become TF-IDF vectors over hashed words, a randomised singular value
decomposition of all of them, distributed, gives a space in which passages with the same words lie close whatever
became of some, a cosine search there gives candidate items for each passage, and an alignment of words decides.
"""

from __future__ import annotations

import html
import re
import uuid
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.sources.tables import materialize, ship_package

WIDTH = 15
#: Words of a passage that may differ: one in so many.
ONE_IN = 8
DIMS = 1 << 14
RANK = 128
MIN_COSINE = 0.45
#: Characters of items that are sent to executors at once, on average of the blocks.
CHARS_PER_BLOCK = 50_000_000

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_JUNK = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, markup, line marks and invisible characters."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return _JUNK.sub("", text).casefold().split()


def _place(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % DIMS


class _Places(dict):
    """The places of words seen, kept by a task up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = _place(word)
        return got


class Item:
    """An evaluation item's words and where their triples stand."""

    def __init__(self, item_id: int, words: list[str]):
        self.item_id, self.words = item_id, words
        self.triples: dict[tuple[str, str, str], list[int]] = defaultdict(list)
        for i, t in enumerate(zip(words, words[1:], words[2:], strict=False)):
            self.triples[t].append(i)


def _runs(words: list[str], item: Item) -> list[tuple[int, int, int]]:
    """``(place in item, place in text, length)`` of the longest common stretches of three words or more."""
    open_at: dict[int, list[int]] = {}
    runs = []
    for p, t in enumerate(zip(words, words[1:], words[2:], strict=False)):
        for i in item.triples.get(t, ()):
            run = open_at.get(i - p)
            if run and run[1] + run[2] == p + 2:
                run[2] += 1
            else:
                run = open_at[i - p] = [i, p, 3]
                runs.append(run)
    return sorted((i, p, n) for i, p, n in runs)


def _figure(word: str) -> bool:
    return any(c.isdigit() for c in word)


def _reach(body: list[str], text: list[str], i: int, p: int, step: int, most: int) -> list[int]:
    """For each number of errors up to *most*, how many body words can be gained from ``i, p`` on in the direction *step*, up to a word that agrees.

    The furthest places on each diagonal with so many changed, dropped or added words, as a whole: no alignment with as few errors
    gains more. A place where both state a figure, and not the same, is a wall: that is no error but another content.
    """
    n, m = (len(body) - i, len(text) - p) if step > 0 else (i + 1, p + 1)

    def slide(x: int, y: int) -> int:
        while x < n and y < m and body[i + step * x] == text[p + step * y]:
            x, y = x + 1, y + 1
        return x

    best = {0: slide(0, 0)}  # diagonal (body minus text words) to body words
    out = [best[0]]
    for _ in range(most):
        fresh: dict[int, int] = {}
        ended = out[-1]
        for d, x in best.items():
            y = x - d
            if x < n and y < m and _figure(body[i + step * x]) and _figure(text[p + step * y]):
                continue
            for e, u, v in ((d, x + 1, y + 1), (d + 1, x + 1, y), (d - 1, x, y + 1)):
                if u <= n and v <= m:
                    far = slide(u, v)
                    # where the last words are equal they agree in an alignment with no more errors
                    if far > ended and body[i + step * (far - 1)] == text[p + step * (far - e - 1)]:
                        ended = far
                    if fresh.get(e, -1) < far:
                        fresh[e] = far
        if not fresh:
            break
        best = fresh
        out.append(ended)
    return out


def longest_leak(words: list[str], item: Item, width: int = WIDTH, one_in: int = ONE_IN) -> tuple[int, int] | None:
    """``(body words, errors)`` of the longest stretch of at least *width* consecutive words of the item that stands in
    *words* with at most one word in *one_in* changed, dropped or added, and whose first and last words agree; None if there is none.

    A stretch of n words with e errors has a run of (n - e) / (e + 1) words without any, five or more for one error in eight. From
    each such run on, both sides are extended over as many errors as the item's length allows, and the best pair of
    extensions is taken; so every stretch is found, whatever stands in its gaps.
    """
    body, best = item.words, None
    most = len(body) // one_in
    # of n words with e errors, e + 1 runs make up n - e: one of them has at least so many
    least = max(3, min([width, *(-(-(max(width, e * one_in) - e) // (e + 1)) for e in range(1, most + 1))]))
    for i, p, n in _runs(words, item):
        if n < least:
            continue
        if best is not None and i >= best[2] and i + n <= best[2] + best[0] and p >= best[3] and p + n <= best[4]:
            continue  # within the best stretch
        left, right = _reach(body, words, i - 1, p - 1, -1, most), _reach(body, words, i + n, p + n, 1, most)
        for e1, gain1 in enumerate(left):
            for e2, gain2 in enumerate(right):
                size, errors = n + gain1 + gain2, e1 + e2
                if size >= width and errors * one_in <= size and (best is None or size > best[0]):
                    best = (size, errors, i - gain1, p - gain1 - e1, p + n + gain2 + e2)
    return best[:2] if best is not None else None


def _spans(words: list[str], vocabulary: set[str], width: int, least: int) -> list[tuple[int, int]]:
    """The parts of a text in which each window of *width* words has at least *least* of the vocabulary, with a margin."""
    n = len(words)
    if n < width - 1:
        return []
    hits = np.fromiter((w in vocabulary for w in words), dtype=np.int32, count=n)
    sums = np.concatenate(([0], np.cumsum(hits)))
    good = np.flatnonzero(sums[min(width, n) :] - sums[: n - min(width, n) + 1] >= least)
    spans: list[list[int]] = []
    for g in good:
        lo, hi = max(0, int(g) - 4), min(n, int(g) + width + 4)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    return [(a, b) for a, b in spans]


def _starts(n: int, width: int, stride: int) -> list[int]:
    last = max(0, n - width)
    return sorted({*range(0, last, stride), last})


def _passages(words: list[str], width: int, stride: int) -> list[list[str]]:
    return [words[a : a + width] for a in _starts(len(words), width, stride)]


def _rows(places: np.ndarray, width: int) -> np.ndarray:
    """The passages of a text, given as places of its words: one after the other, the last one back from the end; padded with -1."""
    n = len(places)
    if n <= width:
        return np.pad(places.astype(np.int64), (0, width - n), constant_values=-1)[None] if n else np.zeros((0, width), dtype=np.int64)
    whole = places[: n // width * width].reshape(-1, width)
    return np.concatenate([whole, places[None, n - width :]]).astype(np.int64) if n % width else whole.astype(np.int64)


def _vectors(at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of unit TF-IDF vectors of passages given by :func:`_rows`."""
    weight = np.where(at >= 0, idf[at], 0.0)
    weight /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)
    return np.maximum(at, 0), weight


def _placed(passages: list[list[str]], width: int) -> np.ndarray:
    return np.concatenate([_rows(np.array([_place(w) for w in p], dtype=np.int64), width)[:1] for p in passages]) if passages else np.zeros((0, width), dtype=np.int64)


def _times(at: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.empty((len(at), basis.shape[1]))
    for lo in range(0, len(at), 2000):
        out[lo : lo + 2000] = np.einsum("nw,nwk->nk", weight[lo : lo + 2000], basis[at[lo : lo + 2000]])
    return out


def _gathered(texts: DataFrame, own: np.ndarray, partial, columns: int) -> np.ndarray:
    """The sum over the passages of all documents (and of the items) of a DIMS x *columns* matrix that *partial* makes of a list of passages.

    Each task sends its sum in blocks of rows; blocks are added up in two steps, so a task holds a block from a few
    hundred others, never all. The result has a fixed size, whatever the documents.
    """
    rows = 512

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            passages = [_rows(np.frombuffer(x, dtype=np.int16), WIDTH) for x in pdf["places"] if len(x)]
            if passages:
                part = partial(np.concatenate(passages))
                total = part if total is None else total + part
        if total is not None:
            share = TaskContext.get().partitionId() % 64  # the same if the task runs again
            yield pd.DataFrame({"block": range(DIMS // rows), "share": share, "data": [total[b * rows : (b + 1) * rows].astype("float32").tobytes() for b in range(DIMS // rows)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype="float32").astype(float) for x in pdf["data"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "share": [0], "data": [total.astype("float32").tobytes()]})

    schema = "block int, share int, data binary"
    parts = texts.mapInPandas(run, schema).groupBy("block", "share").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    out = partial(own)
    for r in parts.collect():
        out[r["block"] * rows : (r["block"] + 1) * rows] += np.frombuffer(r["data"], dtype="float32").reshape(rows, columns)
    return out


def latent_space(texts: DataFrame, near: DataFrame, own: np.ndarray, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies and the leading right singular vectors of all passages' TF-IDF matrix, by a
    randomised range finder with one power iteration. *texts* has the places of each document's words, which give the frequencies, *near* those of the stretches that are
    searched, which with the items' passages (*own*) give the vectors."""
    one = np.ones(DIMS)

    def count(passages: np.ndarray) -> np.ndarray:
        each = np.sort(passages, axis=1)
        first = np.concatenate([np.ones((len(each), 1), dtype=bool), each[:, 1:] != each[:, :-1]], axis=1) & (each >= 0)
        return np.bincount(each[first], minlength=DIMS).astype(float)[:, None]

    df = _gathered(texts, own, count, 1)[:, 0]
    idf = np.log((df.max() + 1.0) / (df + 1.0)) + 0.1 * one
    basis = np.random.default_rng(seed).standard_normal((DIMS, rank + 8))
    for _ in range(2):

        def power(passages: np.ndarray, basis=basis) -> np.ndarray:
            at, weight = _vectors(passages, idf)
            image = _times(at, weight, basis)
            out = np.zeros_like(basis)
            for lo in range(0, len(at), 2000):
                flat = at[lo : lo + 2000].ravel()
                order = np.argsort(flat, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
                each = (weight[lo : lo + 2000, :, None] * image[lo : lo + 2000, None, :]).reshape(len(flat), -1)
                out[flat[order][first]] += np.add.reduceat(each[order], first, axis=0)
            return out

        basis = np.linalg.qr(_gathered(near, own, power, rank + 8))[0]
    return idf, basis[:, :rank]


def find_leaks(documents: DataFrame, items: DataFrame, width: int = WIDTH, one_in: int = ONE_IN, rank: int = RANK, min_cosine: float = MIN_COSINE, items_per_block: int = 20_000) -> DataFrame:
    """``doc_id, item_id, words, errors``: each document that holds at least *width* consecutive words of an item with at
    most one word in *one_in* changed, dropped or added, with the length and errors of the longest such stretch.

    Items go in blocks of at most *items_per_block* and of a bounded number of words against all documents, so what is sent to executors has a bound. A
    document is searched only where a window of *width* words has all but a few in the block's vocabulary: elsewhere
    no passage can stand. Null texts, bodies and ids give no row, nor do items of fewer words than *width*; copies of
    a document are found each for itself, rows that repeat a ``doc_id`` are one document.
    """
    spark = documents.sparkSession
    ship_package(spark)
    texts = documents.filter("text is not null and doc_id is not null").select("doc_id", "text")
    held = materialize(items.filter("body is not null and item_id is not null").select("item_id", "body"), "items")
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size["n"] // items_per_block), -(-size["chars"] // CHARS_PER_BLOCK)) if size["n"] else 0
    found = None
    for b in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == b).collect()
        part = _search_block(texts, [Item(r["item_id"], w) for r in rows if len(w := words_of(r["body"])) >= width], width, one_in, rank, min_cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words int, errors int")
    best = F.max(F.struct("words", -F.col("errors")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", F.col("_b.words").alias("words"), (-F.col("_b.col2")).alias("errors"))


_SEEN: dict[str, tuple] = {}


def _search_block(texts: DataFrame, items: list[Item], width: int, one_in: int, rank: int, min_cosine: float) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = spark.sparkContext.broadcast({w for it in items for w in it.words})
    least = width - width // one_in - 2

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Places()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ws = words_of(text)
                places, parts = np.array([known[w] for w in ws], dtype=np.int16), _spans(ws, vocabulary.value, width, least)
                out.append((i, places.tobytes(), [" ".join(ws[a:b]) for a, b in parts], [places[a:b].tobytes() for a, b in parts]))
            yield pd.DataFrame(out, columns=["doc_id", "places", "spans", "near"])

    cuts = materialize(texts.mapInPandas(cut, "doc_id bigint, places binary, spans array<string>, near array<binary>"), "spans")
    spans = cuts.select("doc_id", F.explode("spans").alias("words"))
    own = [(k, p) for k, it in enumerate(items) for p in _passages(it.words, width, 3)]
    if not own:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words int, errors int")
    mine = _placed([p for _, p in own], width)
    idf, basis = latent_space(cuts.select("places"), cuts.select(F.explode("near").alias("places")), mine, rank)
    at, weight = _vectors(mine, idf)
    latent = _times(at, weight, basis).astype("float32")
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, idf, basis.astype("float32"), latent, np.array([k for k, _ in own]), [(it.item_id, it.words) for it in items]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, idf, basis, latent, owner, plain = shared.value
        if key not in _SEEN:
            _SEEN.clear()
            _SEEN[key] = [Item(*x) for x in plain]
        known, known_places = _SEEN[key], _Places()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["words"], strict=True):
                ws = text.split(" ")
                starts = _starts(len(ws), width, 4)
                places = np.array([known_places[w] for w in ws], dtype=np.int64)
                at, weight = _vectors(np.stack([np.pad(places[a : a + width], (0, max(0, width - len(places) + a)), constant_values=-1) for a in starts]), idf)
                image = _times(at, weight, basis).astype("float32")
                image /= np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-9)
                close = image @ latent.T >= min_cosine
                near = np.flatnonzero(close.any(axis=0))
                for k in sorted(set(owner[near].tolist())):
                    # the stretch around the passages that met, wide enough for any alignment of the item
                    at = np.flatnonzero(close[:, owner == k].any(axis=1))
                    reach = len(known[k].words) * 9 // 8 + width
                    lo, hi = max(0, starts[int(at[0])] - reach), starts[int(at[-1])] + width + reach
                    if got := longest_leak(ws[lo:hi], known[k], width, one_in):
                        out.append((i, known[k].item_id, *got))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "errors"])

    # few small files, much work: a task for every few thousand stretches, and enough for the cluster
    stretches = spans.count()
    spread = spans.repartition(max(4 * spark.sparkContext.defaultParallelism, stretches // 2000 + 1))
    return materialize(spread.mapInPandas(search, "doc_id bigint, item_id bigint, words int, errors int"), "leaks")
