"""Keyword-stuffed and link-list pages.

A page is cut into lines, long lines into sentences, and each piece is measured: the share of function words, of the
page's own most frequent word pairs, of links, hashtags, product codes and numbers. Pieces that say something are
those with the function words of a language; how many that are at least is calibrated on all documents of that
language. Neighbouring short lines are judged as one piece. Two shares are of the whole page, that of repeated lines and
that of its most frequent words; from where on they count is calibrated by language on the pages that say something. A page without
known function words whose words the other pages don't use is of a language without a list: there sentences count as
such by their form. A page is spam if more than half of its characters stand in pieces that don't say anything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.sources.tables import materialize, ship_package

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in and is was for on with that it we i you be are as at by from or not this have has had will would please so but if they our your before until than who which what there been its my me he she them their can could should did do let i’ll don’t doesn’t won’t let’s let's doesn't how all any only",
    "de": "der die das und ist in zu den dem von mit für auf nicht ein eine einen wir sie ich es sich auch noch wird war aber oder als bei nach über wie dass ob nur bis im am um aus die dir du mir wenn zum zur schon sind hat haben hier darüber also seit denen sonst",
    "fr": "le la les de des du un une à est pour dans sur que qui nous vous il elle je ne pas plus par avec au aux ce se son sa ses et ou mais te n’a soit dont déjà encore  jusqu’à on y",
    "es": "el la los las de del un una por con para no se lo su es al más y en que a me te si nos ya o pero desde hasta muy sin ha hay así está entre esta este después mi",
    "nb": "og er på det en et for ikke vi å har som til av den med jeg kan om fra så de var men i får ble noe noen dem alt når hva ved sin et siden enn skal du hos ellers være eller bare dere",
    "ru": "и в не на что с по за из но мы до от как это для у же о бы ещё они он к ли все был была его то а или через только",
    "pl": "i w na z że się nie do o jest za po od już czy to mi ale co jak tu oraz a są dla mam być ma jeszcze raz tylko też bo we ze",
}
_FW = {w: tuple(k for k, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}

_BREAK = re.compile(r"\n|<br\s*/?>|</(?:li|p|tr|div)>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")
_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]{1,80}\]\([^)\s]+\)", re.I | re.S)
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|net|org|info|biz|shop|online|site|xyz|[a-z]{2})\b(?:/\S*)?", re.I)
_HASH = re.compile(r"#[^\W\d][\w-]*|#\d+-\w+")
_CODE = re.compile(r"\b(?:SKU|ART|REF|EAN|ASIN|MPN|ITEM)[-\s#]?[A-Z0-9]*\d[A-Z0-9]*\b", re.I)
_WORD = re.compile(r"[^\W_][\w’'-]*")
_QUOTE = re.compile(r"^[\s>|]+")
#: A sentence by its form: a capital or a letter without case first, a mark at its end.
_FORM = re.compile(r"^[\W\d]*[^\W\d_a-zà-öø-ÿа-я].{20,}[.!?…。！？][\"'”’»)]*$", re.S)
#: A line that counts, dates or lists things: a quantity, a time or a weekday, a bullet with a sentence.
_ENTRY = re.compile(r"^\s*(?:\d+\s?[x×]\s|\d{1,2}[:.]\d{2}\b|(?:mon|tue|wed|thu|fri|sat|sun)\w*\s+\d|\d{4}-\d\d-\d\d|[-*•]\s+\w+:)", re.I)
SEPARATORS = re.compile(r"[,;|/»·•>~]|\s-\s")


def pieces(text: str) -> list[str]:
    """Lines, and the sentences of long lines, without marks of quotation."""
    out = []
    for line in _BREAK.split(text):
        line = _QUOTE.sub("", line).strip()
        if len(line) > 160:
            out += _SENTENCE.split(line)
        elif line:
            out.append(line)
    return out


#: Words of a line that is judged with its neighbours; words that a page is counted to be dominated by.
SHORT, TOP = 8, 5


def _share(spoken: Counter[str], n: int, lang: str) -> tuple[str, float]:
    """The language of a piece of *n* words and the share of its function words."""
    speech = min(spoken, key=lambda k: (-spoken[k], k)) if spoken else lang
    return speech, spoken[speech] / n if n else 0.0


def measure(text: str) -> tuple[str, float, float, float, list[tuple]]:
    """Language by function words, their share in the text, the share of repeated lines in its characters and of its most
    frequent other words in its words, and for each piece: its language, characters, words, share
    of function words in that language, share of link characters, of hashtag characters, codes, whether it is an entry of a list, share of words
    in the page's most frequent pairs, separators per word, how often it stands in the page, words and share of function
    words of the run of short lines that it belongs to, whether it has the form of a sentence.

    A repeated line that has function words is repeated history, which says nothing about stuffing: it counts once.
    """
    parts = []
    langs: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    singles: Counter[str] = Counter()
    copies: Counter[str] = Counter()
    total = said_words = 0
    for piece in pieces(text):
        bare = _ANCHOR.sub(" ", piece)
        linked = len(piece) - len(bare)
        shown = bare
        bare = _LINK.sub(" ", bare)
        linked += len(shown) - len(bare)
        untagged = _HASH.sub(" ", bare)
        tagged = len(bare) - len(untagged)
        codes = len(_CODE.findall(untagged))
        words = [w.lower() for w in _WORD.findall(untagged)]
        spoken: Counter[str] = Counter()
        for w in words:
            spoken.update(_FW.get(w, ()))
        langs.update(spoken)
        total += len(words)
        said = " ".join(words)
        copies[said] += 1
        if copies[said] == 1 or not spoken:
            said_words += len(words)
            singles.update(w for w in words if w not in _FW and not w[0].isdigit())
            pairs.update((a, b) for a, b in zip(words, words[1:], strict=False) if not (a in _FW and b in _FW) and not (a[0].isdigit() and b[0].isdigit()))
        parts.append((piece, linked, tagged, codes, words, spoken, said))
    lang = min(langs, key=lambda k: (-langs[k], k)) if langs else ""
    top = {p for p, n in pairs.items() if n >= max(4, 0.015 * total)}
    out, known = [], langs[lang] if lang else 0
    entries = [bool(_ENTRY.match(x[0])) for x in parts]
    runs: list[tuple[int, float]] = [(0, 0.0)] * len(parts)
    k = 0
    while k < len(parts):
        end = k
        while end < len(parts) and len(parts[end][4]) < SHORT and not entries[end]:
            end += 1
        if end > k:
            spoken, n = sum((x[5] for x in parts[k:end]), Counter()), sum(len(x[4]) for x in parts[k:end])
            runs[k:end] = [(n, _share(spoken, n, lang)[1])] * (end - k)
        k = max(end, k + 1)
    repeated = 0
    for (piece, linked, tagged, codes, words, spoken, said), entry, (run, run_fw) in zip(parts, entries, runs, strict=True):
        n = len(words)
        speech, fw = _share(spoken, n, lang)
        if said and copies[said] > 1 and not spoken:
            repeated += len(piece)
        covered = set()
        for k, p in enumerate(zip(words, words[1:], strict=False)):
            if p in top:
                covered |= {k, k + 1}
        size = max(1, len(piece))
        out.append((speech, float(len(piece)), float(n), fw, linked / size, tagged / size, float(codes), float(entry), len(covered) / n if n else 0.0, len(SEPARATORS.findall(piece)) / max(1, n), float(copies[said]) if said else 1.0, float(run), run_fw, float(bool(_FORM.match(piece)))))
    frequent = sum(c for _, c in singles.most_common(TOP) if c >= 4)
    return lang, known / total if total else 0.0, repeated / max(1, sum(len(x[0]) for x in parts)), frequent / max(1, said_words), out


NAMES = ("lang", "chars", "words", "fw", "link", "tags", "codes", "entry", "pairs", "seps", "copies", "run", "run_fw", "form")


def features(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, fw, dup, top, pieces``: the measures of each document with a text."""
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [measure(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "lang": [r[0] for r in rows], "fw": [r[1] for r in rows], "dup": [r[2] for r in rows], "top": [r[3] for r in rows],
                "pieces": [[dict(zip(NAMES, p, strict=True)) for p in r[4]] for r in rows],
            })

    schema = "doc_id bigint, lang string, fw double, dup double, top double, pieces array<struct<" + ", ".join(f"{n}: {'string' if n == 'lang' else 'double'}" for n in NAMES) + ">>"
    return documents.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, schema)


def calibrate(feats: DataFrame, part: float = 0.25, least: float = 0.06) -> dict[str, float]:
    """For each language, below which share of function words a piece says nothing: a part of the median of its longer
    pieces, over all documents. One row a language with a word list comes to the driver."""
    each = feats.select(F.explode("pieces").alias("p")).select("p.*").filter("words >= 8")
    rows = each.groupBy("lang").agg(F.greatest(F.percentile_approx("fw", 0.5) * part, F.lit(least)).alias("floor")).collect()
    return {r["lang"]: r["floor"] for r in rows}


#: Least shares of repeated lines and of frequent words that count, and what counts in pages of no known language.
LEAST_DUP, LEAST_TOP = 0.3, 0.3


def calibrate_pages(feats: DataFrame, floors: dict[str, float], at: float = 0.99) -> dict[str, tuple[float, float]]:
    """For each language, from which share of repeated lines and of frequent words on a page counts as dominated by them:
    what nearly all of its pages that say something stay below. One row a language comes to the driver."""
    says = feats.filter(F.col("fw") >= F.coalesce(F.try_element_at(_map(floors, 0.06), F.col("lang")), F.lit(0.06)))
    rows = says.groupBy("lang").agg(*[F.greatest(F.percentile_approx(c, at), F.lit(low)).alias(c) for c, low in (("dup", LEAST_DUP), ("top", LEAST_TOP))]).collect()
    return {r["lang"]: (r["dup"], r["top"]) for r in rows}


def _map(values: dict[str, float], default: float):
    return F.create_map(*[F.lit(v) for kv in (values or {"": default}).items() for v in kv])


#: Places of the table of words that pages in known languages use; pages from which on a place counts as used.
PLACES, USED = 1 << 21, 2
#: Share of a page's words in that table below which its language is one without a list.
FOREIGN = 0.3


def known_words(documents: DataFrame, feats: DataFrame, floors: dict[str, float]) -> DataFrame:
    """``place``: the hashed words that at least :data:`USED` pages use whose function words are those of a known language. A table of at most
    :data:`PLACES` rows, counted over all pages and combined before the shuffle."""
    says = feats.filter(F.col("fw") >= F.coalesce(F.try_element_at(_map(floors, 0.06), F.col("lang")), F.lit(0.06))).select("doc_id")
    words = documents.filter("doc_id is not null and text is not null").select("doc_id", "text").join(says, "doc_id", "left_semi").select(F.explode(_places("text")).alias("place"))
    return words.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") >= USED).select("place")


def _places(text: str):
    """The hashed words of a text, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\p{L}{2,}"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int")))


def foreign(documents: DataFrame, feats: DataFrame, floors: dict[str, float]) -> DataFrame:
    """``doc_id`` of pages without the function words of a known language, most of whose words no page in a known language uses."""
    silent = feats.filter(F.col("fw") < F.coalesce(F.try_element_at(_map(floors, 0.06), F.col("lang")), F.lit(0.06))).select("doc_id")
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "text").join(materialize(silent.distinct(), "silent"), "doc_id", "left_semi")
    each = texts.select("doc_id", F.explode(_places("text")).alias("place")).groupBy("doc_id", "place").agg(F.lit(1).alias("one"))
    known = F.broadcast(known_words(documents, feats, floors).withColumn("known", F.lit(1)))  # at most PLACES rows of a number
    share = each.join(known, "place", "left").groupBy("doc_id").agg((F.count("known") / F.count("*")).alias("share"))
    return share.filter(F.col("share") < FOREIGN).select("doc_id")


def spam_share(piece, floor, repeats, dominated, strange):
    """Characters of a piece that count as spam: all or none. *repeats*, *dominated*: whether the page is one of repeated
    lines, or of a few words; *strange*: whether it is of a language without a list."""
    p = lambda n: piece[n]
    sentence = strange & (p("form") == 1) & (p("seps") < 0.25) & (p("pairs") < 0.3)
    empty = (p("fw") < floor) & ~sentence
    list_of_links = (p("link") >= 0.6) | ((p("link") >= 0.2) & (empty | (p("words") <= 6)))
    tags = p("tags") >= 0.5
    product = (p("codes") >= 1) & (empty | (p("pairs") >= 0.2))
    run = empty & (p("words") >= 8) & (p("entry") == 0)
    strung = empty & (p("seps") >= 0.25) & (p("words") >= 5) & (p("entry") == 0)
    stuffed = (p("pairs") >= 0.3) & (p("words") >= 4) & ((p("entry") == 0) | (p("pairs") >= 0.6)) & ~(strange & (p("form") == 1) & ~dominated)
    short = (p("run_fw") < floor) & (p("run") >= SHORT) & ~sentence
    listed = short & ((p("pairs") >= 0.3) | dominated)
    again = repeats & empty & (p("copies") > 1)
    return F.when(list_of_links | tags | product | run | strung | stuffed | listed | again, p("chars")).otherwise(0.0)


def score_pages(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, spam_share, is_spam`` of each document with a text.

    ``lang`` is found by function words, not taken from the table. A text without letters or digits has share 0.
    Null texts and ids give no row; repeated rows are judged each for itself; copied texts alike; columns besides
    ``doc_id`` and ``text`` are ignored. Whole texts are read.
    """
    feats = materialize(features(documents), "pages")
    floors = calibrate(feats)
    floor = lambda x: F.coalesce(F.try_element_at(_map(floors, 0.06), x["lang"]), F.lit(0.06))
    cuts = calibrate_pages(feats, floors)
    over = lambda c, k, low: F.col(c) >= F.coalesce(F.try_element_at(_map({x: v[k] for x, v in cuts.items()}, low), F.col("lang")), F.lit(low))
    repeats, dominated = over("dup", 0, LEAST_DUP), over("top", 1, LEAST_TOP)
    feats = feats.join(foreign(documents, feats, floors).withColumn("strange", F.lit(True)), "doc_id", "left").withColumn("strange", F.coalesce("strange", F.lit(False)))
    total = F.aggregate("pieces", F.lit(0.0), lambda acc, x: acc + x["chars"])
    bad = F.aggregate(F.transform("pieces", lambda x: spam_share(x, floor(x), repeats, dominated, F.col("strange"))), F.lit(0.0), lambda acc, x: acc + x)
    rows = feats.select("doc_id", "lang", F.coalesce(F.try_divide(bad, total), F.lit(0.0)).alias("spam_share"))
    return rows.withColumn("is_spam", F.col("spam_share") > 0.5)
