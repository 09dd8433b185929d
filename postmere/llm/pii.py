"""Personal information inside free text.

A skip-chain conditional random field over the candidate spans of a document: numbers, mail and street addresses and
capitalised words are nodes with potentials from their shape, checks, lexicon and context; neighbours on a line and
spans of equal or similar value anywhere in the document share potentials; loopy message passing settles the labels, so
that a number named once as an identity number is one wherever it stands, a word that greets someone is a name in the
signature too, and a word that stands in a mail address is likely a name. The weights of the edges are fitted on all
texts, from how often spans agree that are sure by themselves; the texts are read once, and what depends on the weights is kept until they are known.
"""

from __future__ import annotations

import bisect
import gc
import json
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.llm.encoding import candidates, is_utf8
from postmere.sources.tables import materialize, ship_package

TYPES = ("email", "phone", "national_id", "address", "name")
BITS = 22
#: Weights of the field before they are fitted: what neighbours, equal and similar spans of one label add.
CHAIN, SKIP, SIMILAR = 0.8, 1.6, 0.9
#: Rounds of message passing; score from which on a node is sure, for the fit of the weights, and their bounds.
ROUNDS, SURE, LEAST_WEIGHT, MOST_WEIGHT = 6, 1.2, 0.5, 2.0

_SP = r"[ \xa0]"
#: Spaces of a number whose no-break spaces were decoded wrongly.
_GAP = r"(?:[ \xa0.-]|[^\x00-\x7f\d]{1,24})"
_EMAIL = re.compile(r"[\w.+%'’-]+@[\w-]+(?:\.[\w-]+)+")
_SPELLED = re.compile(
    r"[\w+%-]+(?:(?:\.| ?[\[({]\s?dot\s?[\])}] ?| dot )[\w+%-]+)*(?: ?[\[({<]\s?(?:at|a|ät|@)\s?[\])}>] ?| at )[\w-]+(?:(?:\.| ?[\[({]\s?dot\s?[\])}] ?| dot | punkt | point )[\w-]+)+", re.I)
_PHONE = re.compile(
    rf"(?<![\w.+/-])(?:\+\d{{1,3}}{_GAP}?(?:\(\d{{1,4}}\){_GAP}?)?\d{_GAP}?(?:\d{_GAP}?){{5,11}}\d|"
    rf"\(0\d{{2,5}}\){_SP}?\d{{3,4}}{_SP}?\d{{3,4}}|00\d{{2}}{_SP}?(?:\(0\){_SP}?)?\d{{1,4}}(?:{_SP}?[/-]?{_SP}?\d{{2,6}}){{1,4}}|"
    rf"0\d{{4}}{_SP}\d{{6}}|0\d{{9,10}}|0\d(?:(?:{_SP}|\.)\d{{2}}){{4}}|(?:\(\d{{3}}\){_SP}?|\d{{3}}[-. ])\d{{3}}[-.]\d{{4}}|"
    rf"0\d{{1,3}}[-/]\d{{2,3}}(?:{_SP}\d{{2,3}}){{2,3}}|0\d{{2,4}}{_SP}?/{_SP}?\d{{4,8}}(?:-\d{{1,4}})?|"
    rf"8{_SP}?\(?\d{{3}}\)?{_SP}?\d{{3}}-\d{{2}}-\d{{2}}|\d{{2}}(?:{_SP}\d{{2}}){{3}}|\d{{3}}{_SP}\d{{2}}{_SP}\d{{3}}|\d{{3}}{_SP}\d{{3}}{_SP}\d{{3}}|\d{{8,9}})(?![\w-]|[.,/]\d)")  # fmt: skip
_ID = re.compile(
    rf"(?<![\w.+/-])(?:\d{{3}}(?:-\d{{2}}-|{_SP}\d{{2}}{_SP})\d{{4}}|\d{{6}}{_SP}?\d{{5}}|(?:19|20)?\d{{6}}[-+A]\d{{3}}[0-9A-FHJ-NPR-Y]|"
    rf"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?[A-D]|QQ{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?[A-D]|"
    rf"[12]{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?\d{{3}}{_SP}?\d{{3}}(?:{_SP}?\d{{2}})?|[XYZ]?\d{{7,8}}-?[A-HJ-NP-TV-Z])(?![\w-]|[.,/]\d)")  # fmt: skip
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Row|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Terrace|Mews|Close|Way|Place|Pl|Square|Crescent|Gardens|Grove|Hill)"
_ADDRESS = re.compile(
    rf"\b\d{{1,5}}[A-Z]?{_SP}(?:[A-ZÀ-ÞŁŚŻ][^\s.,;]*{_SP}){{1,3}}(?:{_STREET}|{_STREET.upper()})\b|"
    rf"\b\d{{1,4}}(?:{_SP}(?:bis|ter|BIS))?,?{_SP}(?:[Rr]ue|[Aa]venue|[Aa]v\.|[Aa]ll(?:é|�|\S{{1,8}})e|[Qq]uai|[Bb]oulevard|[Bb]d|[Cc]hemin|[Ii]mpasse|[Cc]ours|RUE|AVENUE|ALLÉE|QUAI|BOULEVARD){_SP}\S|"
    rf"(?:C/|c/|\b[Cc]alle|\b[Aa]vda\.?|\b[Aa]venida|\b[Pp]aseo|\b[Pp]laza){_SP}?[^,\n]{{2,40}},{_SP}?\d+|"
    rf"\b[^\W\d_]\S*?(?:stra(?:ß|ss|\S{{1,4}})e|str\.|weg|gasse|allee|damm|steig|ufer|STR\.|WEG|GASSE){_SP}\d{{1,4}}\b|"
    rf"\b(?:Am|An{_SP}der|An{_SP}den|Im|Zum|Zur|Auf{_SP}dem|AM){_SP}(?:[A-ZÄÖÜ]\S*{_SP}){{1,2}}\d{{1,4}}\b|"
    rf"\b[^\W\d_a-z]\S*?(?:veien|vegen|gata|gaten|gate|bakken|faret|stien|svingen|plassen|torget|VEIEN|GATE|GATA|BAKKEN|FARET){_SP}\d{{1,4}}{_SP}?[A-Z]?\b|"
    rf"\b(?:ул\.|улица|пр\.|проспект|ul\.|al\.|os\.){_SP}?\S+(?:{_SP}\S+){{0,2}}?,?{_SP}(?:д\.{_SP}?)?\d+")  # fmt: skip
_STREET_HINTS = tuple(
    "street| st|road| rd|lane| ln| row|ave|boulevard|blvd|drive| dr|court| ct|terrace|mews|close| way|place| pl|square|crescent|gardens|grove|hill|rue |quai|all|chemin|impasse|cours|c/|calle|paseo|plaza|"
    "stra|str.|weg|gasse|damm|steig|ufer|am |an de|im |zu|auf dem|veien|vegen|gat|bakken|faret|stien|svingen|plassen|torget|ул|пр|ul.|al.|os.".split("|")
)
_CAPITAL = re.compile(r"[^\W\d_a-zà-öø-ÿ](?:[\w’'�-]|[^\x00-\x7f](?=\w))*|[^\x00-\x7f\s][^\s<>\"(),;:!?@]*\w")
# Words that speak for or against a reading of a number.
_PHONE_WORDS = re.compile(r"(?:\bt(?:el|lf|elefon|elephone)?\b\.?:?|\bm(?:ob|obil|obile)\b|☎|\bcall me\b|\bring meg\b|portable|\bfax\b|\bphone\b|answers|\bm[ay] number \(|nummer ist jetzt|reach me|тел|telefon|questions\?|fragen\?|spørsmål\?|\bcall\b)\W*$", re.I)
_ID_WORDS = re.compile(r"(?:\bssn|\bni number|\bid|fødselsn\w*|personnum\w*(?: er)?|\bpesel|\bdni|\bnie\b|national (?:id|insurance)\w*|social security\w*|sécurité sociale|identi\w+(?: number)?|henkilötunnus|it is|they need|give number|\buse|asks for my number,? it is)\W*$", re.I)
_AGAINST = re.compile(r"(?:order|ordre|bestellung|commande|booking|case(?: number)?|invoice|rechnung|kvittering|receipt|faktura|tracking(?: code)?|parcel|shelf|code|kid|meter|version|gate|row|chapter|page|room|no\.|nr\.|kundenr|konto\w*|account|ticket|ref\w*|issue|#)\W*(?:no\.?)?\W*$", re.I)
_MONEY = re.compile(r"^(?:,\d\d|\.\d\d)?\s*(?:€|\$|£|kr|nok|sek|dkk|usd|eur|gbp|euro|zł|kwh|kroner|евро|%)", re.I)
_ROLE = r"^(?:no-?reply|news|post|billing|service|info|support|office|admin|mail|contact|hello|team|newsletter|notifications?|kundeservice|lists?|postmaster)\b"
#: Score of a capitalised word that is in no lexicon and has no evidence: near zero, so that its repeats don't outvote the one place that has some.
BARE = -0.1
_TITLES = frozenset("mr mrs ms dr prof herr herrn frau hr fru mme mlle monsieur madame señor señora sr sra sa doña don pan pani panie г-н г-жа господин госпожа".split())
_GREETING = re.compile(r"^\W*(?:hi|hello|hey|dear|(?:good )?(?:morning|afternoon|evening)|hei|heisann|kjære|god (?:dag|morgen)|hallo|liebe[rs]?|sehr geehrte[rs]?|moin|guten (?:tag|morgen)|bonjour|salut|cher|chère|hola|querid[oa]|estimad[oa]|buenos días|привет|здравствуйте|уважаем\w+|дорог\w+|cześć|dzień dobry|witaj|drogi|droga)(?: (?:mr|mrs|ms|dr|herr|frau|fru|pan|pani)\.?)? ", re.I)
_GREETED_END = re.compile(r"^(?: [^\W\d_a-zà-öø-ÿ][\w’'-]*){0,2}\s*[,!.:–-]*\s*$")
_SIGN_OFF = re.compile(r"^[>\s|]*(?:(?:(?:kind|best|warm|with kind) )?regards|best|all the best|best wishes|many thanks|thanks|thank you|cheers|yours(?: sincerely| truly)?|sincerely|take care|love|(?:med )?(?:vennlig|beste) hilsen|hilsen|mvh|(?:mit )?(?:viele|liebe|freundlichen?|beste|herzliche|schöne) grüßen?|gruß|mfg|lg|(?:bien )?cordialement|amicalement|bises|(?:un )?(?:abrazo|saludo)|saludos(?: cordiales)?|atentamente|с уважением|всего доброго|pozdrawiam|z poważaniem)\s*[,.!–-]*\s*$", re.I)
_NAME_LINE = re.compile(r"^[>\s|]*(?:[^\W\d_a-zà-öø-ÿ][\w’'.-]*)(?: [^\W\d_a-zà-öø-ÿ][\w’'.-]*){0,2}\s*[,.]?\s*$")
#: Whom one greets without a name, and words of firms under a sign-off.
_NOBODY = frozenset("""hi hello hey hei hallo moin bonjour salut hola all everyone everybody team folks both sir madam customer customers friends friend colleagues member neighbours neighbors there alle sammen dere kunde kunden kundin zusammen damen herren kollegen freunde team
toutes tous client clients amis madame monsieur todos todas cliente amigos equipo всем коллеги друзья клиент wszyscy państwo klient the your our support service kundeservice mr mrs ms dr prof herr frau hr fru pan pani""".split())
_THINGS = tuple(f" {w}" for w in "Prize House Street Award Room Bank Energy Insurance Clinic Hosting Sport Travel Books Mobile Rail Parking Ferries Schools Air Dental Telecom Eiendom Versand Reisen Sparekasse Library Apteka Works AS GmbH Ltd Inc".split()) + (" & ",)


def _check_norwegian(d: str) -> bool:
    """Date with the offsets of synthetic and D numbers, and both check digits."""
    day, month = int(d[:2]), int(d[2:4])
    if not (1 <= (day - 40 if day > 40 else day) <= 31 and 1 <= (month - 80 if month > 80 else month - 40 if month > 40 else month) <= 12):
        return False
    for weights in ((3, 7, 6, 1, 8, 9, 4, 5, 2, 1), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1)):
        if sum(int(x) * w for x, w in zip(d, weights, strict=False)) % 11:
            return False
    return True


def _id_score(text: str, before: str) -> float:
    d = re.sub(r"\D", "", text)
    score = -1.5
    if re.fullmatch(r"\d{6}\s?\d{5}", text):
        score = 5.5 if _check_norwegian(d) else -2.5
    elif re.match(r"[A-Z]{2}", text) or re.search(r"\d[-+A]\d{3}[A-Z]$", text):
        score = 2.5
    elif re.fullmatch(r"\d{3}\D\d{2}\D\d{4}", text):
        score = 1.2
    elif re.fullmatch(r"\d{6}-\d{4}", text):
        day, month = int(d[:2]), int(d[2:4])
        score = 1.5 if (1 <= day <= 31 and 1 <= month <= 12) or 1 <= month <= 12 else -1.0
    elif len(d) in (13, 15) and text[0] in "12":
        score = 1.0 if len(d) == 15 and (97 - int(d[:13]) % 97) == int(d[13:]) else -2.5
    elif re.fullmatch(r"\d{8}-?[A-Z]", text):
        score = 2.0 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == text[-1] else -2.5
    if _ID_WORDS.search(before):
        score += 3.0
    if _AGAINST.search(before):
        score -= 4.0
    return score


def _phone_score(text: str, before: str, after: str, alone: bool) -> float:
    d = re.sub(r"\D", "", text)
    if not 7 <= len(d) <= 15:
        return -5.0
    score = -2.5
    if text[0] == "+" or text.startswith(("00", "(")):
        score = 3.0
    elif text[0] == "0":
        score = 2.0 if re.search(r"\D", text) or len(d) == 11 and d.startswith("07") else 0.0
    elif re.fullmatch(r"\d{3}[-.]\d{3}[-.]\d{4}", text):
        score = 2.0
    elif not re.search(r"\D", text):
        score = -3.0
    if _PHONE_WORDS.search(before):
        score += 3.5
    elif alone:
        score += 1.5
    if _AGAINST.search(before):
        score -= 4.0
    if _MONEY.match(after):
        score -= 5.0
    return score


def _place(word: str) -> int:
    return xxhash.xxh64_intdigest(word) & ((1 << BITS) - 1)


class Lexicon:
    """Names as places of a table of a fixed size, with the judgement of each word kept, and of each line."""

    def __init__(self, places: set[int], firms: set[int] = frozenset(), weights: tuple[float, float, float] = (CHAIN, SKIP, SIMILAR)):
        self.places, self.firms, self.weights = places, firms, weights
        self.words: dict[str, tuple[bool, bool, bool, str, str, tuple[str, ...]]] = {}
        self.lines: dict[tuple[str, bool], tuple] = {}

    def firm(self, word: str) -> bool:
        """Whether addresses of roles use the word more than persons do."""
        return _place(word.lower()) in self.firms

    def word(self, word: str) -> tuple[bool, bool, bool, str, str, tuple[str, ...]]:
        """Whether a capitalised word is a known name, whether it can be none, whether it is a firm's, its folded spelling, and its keys of equal and of similar ones."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 300_000:
                self.words.clear()
            w = word.lower()
            forms = {w, w.replace("’", "'")} if word[0].isupper() or not word[0].isalpha() else set()
            for end in ("'s", "’s", "s"):
                if w.endswith(end) and len(w) > len(end) + 2:
                    forms.add(w[: -len(end)])
            broken = not word.isascii() and (not word.isalpha() or is_utf8(word))
            if broken:
                forms.update(t.lower().strip("\"'.,") for _, t in candidates(word) if t[:1].isupper())
            known = any(len(f) > 1 and _place(f) in self.places for f in forms)
            never = not word[0].isupper() or not word.isascii() and is_utf8(word) or w in _NOBODY
            plain = w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w.translate(_FOLD)) if not unicodedata.combining(c))
            plain = re.sub(r"['’]s$", "", plain)
            got = self.words[word] = known, never, self.firm(word), plain, w, (plain,) if len(plain) > 2 else ()
        return got

    def score(self, word: str) -> float:
        """Log odds that a capitalised word is a name."""
        return 2.2 if self.word(word)[0] else -3.0


_FOLD = str.maketrans({"ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "þ": "th", "ð": "d"})


def _agree(a: str, b: str, cross: bool) -> bool:
    """Whether two labels agree: equal ones, and across an edge between different types any two that are not none."""
    return a == b or cross and bool(a) and bool(b)


def _settle(scores: list[dict[str, float]], edges: list[tuple[int, int, float]]) -> list[str]:
    """The labels of a field by loopy sum-product message passing; label ``""`` is none."""
    labels = [("", *s) for s in scores]
    own = [[1.0, *(math.exp(max(-20.0, min(20.0, v))) for v in s.values())] for s in scores]
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    messages = {(a, b): [1.0] * len(labels[b]) for a in near for b, _ in near[a]}
    for _ in range(ROUNDS):
        fresh = {}
        for a, links in near.items():
            for b, w in links:
                gain = math.exp(w)
                base = list(own[a])
                for c, _ in near[a]:
                    if c != b:
                        m = messages[c, a]
                        base = [x * y for x, y in zip(base, m, strict=True)]
                cross = not set(scores[a]) & set(scores[b])
                out = [sum(x * (gain if _agree(la, lb, cross) else 1.0) for x, la in zip(base, labels[a], strict=True)) for lb in labels[b]]
                total = sum(out)
                fresh[a, b] = [x / total for x in out]
        messages = fresh
    result = []
    for k, base in enumerate(own):
        for c, _ in near[k]:
            base = [x * y for x, y in zip(base, messages[c, k], strict=True)]
        result.append(labels[k][max(range(len(base)), key=base.__getitem__)])
    return result


def _settle_pairs(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """:func:`_settle` where every node has one type to choose: a message is then one number, the log odds of the type."""
    near: list[list[tuple[int, float]]] = [[] for _ in scores]
    for a, b, w in edges:
        near[a].append((b, math.exp(w)))
        near[b].append((a, math.exp(w)))
    messages = {(a, b): 0.0 for a, links in enumerate(near) for b, _ in links}
    own = [max(-20.0, min(20.0, x)) for x in scores]
    for _ in range(ROUNDS):
        sums = [own[a] + sum(messages[c, a] for c, _ in links) for a, links in enumerate(near)]
        fresh = {}
        for a, links in enumerate(near):
            for b, gain in links:
                odds = math.exp(max(-60.0, min(60.0, sums[a] - messages[b, a])))
                fresh[a, b] = math.log((odds * gain + 1.0) / (odds + gain))
        messages = fresh
    return [own[a] + sum(messages[c, a] for c, _ in links) > 0 for a, links in enumerate(near)]


def _certain(scores: list[dict[str, float]], edges: list[tuple]) -> tuple[list[str], list[tuple[list[int], list[tuple]]]]:
    """The labels of a field's nodes by themselves, and its connected parts (nodes, edges between their places) where messages
    may turn some. Where all have one type to choose and scores of one sign, every message has that sign too and can't turn any."""
    found = [max(s, key=s.__getitem__) if max(s.values()) > 0 else "" for s in scores]
    if not edges:
        return found, []
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    for a, b, _ in edges:
        root[top(a)] = top(b)
    members: dict[int, list[int]] = defaultdict(list)
    for k in sorted(root):
        members[top(k)].append(k)
    open_ = []
    for nodes in members.values():
        if len(nodes) > 1 and (any(len(scores[k]) > 1 for k in nodes) or len({found[k] != "" for k in nodes}) > 1):
            place = {k: n for n, k in enumerate(nodes)}
            open_.append((nodes, [(place[a], place[b], w) for a, b, w in edges if a in place]))
    return found, open_


def _turned(scores: list[dict[str, float]], edges: list[tuple[int, int, float]]) -> list[str]:
    """The labels of a connected part by messages."""
    if all(len(x) == 1 for x in scores):
        return [next(iter(x)) if yes else "" for x, yes in zip(scores, _settle_pairs([next(iter(x.values())) for x in scores], edges), strict=True)]
    return _settle(scores, edges)


def _labels(scores: list[dict[str, float]], edges: list[tuple[int, int, float]]) -> list[str]:
    """The labels of a field: those that are certain, and the others by messages."""
    found, open_ = _certain(scores, edges)
    for nodes, links in open_:
        for k, t in zip(nodes, _turned([scores[k] for k in nodes], links), strict=True):
            found[k] = t
    return found


_DIGIT = re.compile(r"\d")
_LEAD = re.compile(r"[>|\s]*")
_LOCAL = re.compile(r"[^\W\d_]{3,}")


class Part:
    """The candidates of a line: their places in it, types with scores, keys of equal ones and keys of similar ones; apart from them the loose
    ones, which have nothing to speak for them but neighbours and repeats; whether one is a name or mail address by itself, and whether the line is a sign-off."""

    __slots__ = ("nodes", "scores", "keys", "alike", "loose", "strong", "closes")

    def __init__(self):
        self.nodes: list[tuple[int, int]] = []
        self.scores: list[dict[str, float]] = []
        self.keys: list[str] = []
        self.alike: list[tuple[str, ...]] = []
        self.loose: list[tuple[int, int, dict[str, float], str, tuple[str, ...]]] = []
        self.strong = self.closes = False

    def add(self, a: int, b: int, scores: dict[str, float], key: str, alike: tuple[str, ...] = ()) -> None:
        self.nodes.append((a, b))
        self.scores.append(scores)
        self.keys.append(key)
        self.alike.append(alike)


#: Lines without a candidate, by whether they are a sign-off.
_PLAIN = Part(), Part()
_PLAIN[1].closes = True


def _mails(line: str, low: str, part: Part) -> list[tuple[int, int]]:
    busy: list[tuple[int, int]] = []
    if "@" in line:
        busy += [m.span() for m in _EMAIL.finditer(line)]
    if "at" in low and ("dot" in low or "[at" in low or "(at" in low or "{at" in low or "punkt" in low or "point" in low) or "ät" in low or "[a" in low or "(a" in low or "{a" in low or "<a" in low:
        for m in _SPELLED.finditer(line):
            if re.search(r"[\[({<]|@| dot | punkt | point ", m.group(), re.I) and not any(a < m.end() and m.start() < b for a, b in busy):
                busy.append(m.span())
    for a, b in busy:
        text = low[a:b]
        local = re.split(r"@| at |[\[({<]", text)[0]
        part.add(a, b, {"email": 4.0 if "@" in text else 3.0}, re.sub(r"[^\w]|\b(?:at|dot|punkt|point|ät)\b", "", text), tuple(_LOCAL.findall(local)))
    return busy


def _numbers(line: str, low: str, part: Part, busy: list[tuple[int, int]]) -> None:
    free = lambda a, b: not any(x < b and a < y for x, y in busy)
    for h in _STREET_HINTS:
        if h not in low:
            continue
        for m in _ADDRESS.finditer(line):
            if free(*m.span()):
                busy.append(m.span())
                part.add(*m.span(), {"address": 3.0}, re.sub(r"\W+", " ", m.group().lower()))
        break
    first = len(part.nodes)
    for kind, pattern in (("national_id", _ID), ("phone", _PHONE)) if len(_DIGIT.findall(line)) >= 6 else ():
        for m in pattern.finditer(line):
            a, b = m.span()
            if not free(a, b):
                continue
            before, after = line[:a], line[b : b + 12]
            s = _phone_score(m.group(), before, after, not before.strip(" >|:\t") and not after.strip(" .\r")) if kind == "phone" else _id_score(m.group(), before)
            if s < -4.5:
                continue
            key = re.sub(r"\D", "", m.group())[-8:]
            same = next((k for k in range(first, len(part.nodes)) if part.nodes[k][0] < b and a < part.nodes[k][1]), None)
            if same is None:
                part.add(a, b, {kind: s}, key)
            elif part.nodes[same] == (a, b):
                part.scores[same][kind] = s
            elif s > max(part.scores[same].values()):
                part.nodes[same], part.scores[same], part.keys[same] = (a, b), {kind: s}, key


def _capitals(line: str, part: Part, busy: list[tuple[int, int]], lexicon: Lexicon, ends_mail: bool) -> None:
    words, met = [], lexicon.words
    for m in _CAPITAL.finditer(line):
        a, b = m.span()
        if b - a > 1 and not (busy and any(x < b and a < y for x, y in busy)):
            w = m.group()
            words.append((a, b, met.get(w) or lexicon.word(w)))
    if not words:
        return
    signed = ends_mail and bool(_NAME_LINE.match(line)) and not any(firm or key in _NOBODY for _, _, (_, _, firm, _, key, _) in words)
    greeting = _GREETING.match(line)
    greeted = greeting.end() if greeting else -1
    for k, (a, b, (known, never, firm, _, key, alike)) in enumerate(words):
        bare = False
        if known:
            s = 2.2
            beside = (k and words[k - 1][2][0] and a - words[k - 1][1] <= 3) or (k + 1 < len(words) and words[k + 1][2][0] and words[k + 1][0] - b <= 3)
            if not beside and (line.startswith(_THINGS, b) or line.endswith("the ", 0, a)):
                s -= 3.5
        elif never:
            continue
        else:
            s = BARE
            title = line[line.rfind(" ", 0, a - 1) + 1 : a - 1].lower().strip(".,(>") if a > 1 and line[a - 1] == " " else ""
            titled = title in _TITLES and not (title == "dr" and line[a - 3 : a - 1].lower() == "dr" and re.match(r" ?\d", line[b:]))
            if signed or titled or greeted == a and _GREETED_END.match(line[b:]):
                s += 3.5
            if firm:
                s -= 1.5
            if line.startswith(_THINGS, b) or line.endswith("the ", 0, a):
                s -= 3.5
            bare = s <= 0
        if a and line[a - 1] in "@#":
            s -= 6.0
        if bare:
            part.loose.append((a, b, _LOOSE if s == BARE else {"name": s}, key, alike))
        else:
            part.add(a, b, {"name": s}, key, alike)


_LOOSE = {"name": BARE}


def _scan(line: str, ends_mail: bool, lexicon: Lexicon) -> Part:
    """The candidates of a line without its marks of quotation; *ends_mail*: whether it stands below a sign-off."""
    if len(lexicon.lines) > 50_000:
        lexicon.lines.clear()
    part, low = Part(), line.lower()
    busy = _mails(line, low, part)
    if _DIGIT.search(line):
        _numbers(line, low, part, busy)
    _capitals(line, part, busy, lexicon, ends_mail)
    closes = len(line) < 60 and bool(_SIGN_OFF.match(line))
    if part.nodes or part.loose:
        part.strong = any(max(x.values()) > 0 and ("name" in x or "email" in x) for x in part.scores)
        part.closes = closes
    else:
        part = _PLAIN[closes]
    lexicon.lines[line, ends_mail] = part
    return part


def field_of(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, int]], list[dict[str, float]], list[tuple[int, int, str]]]:
    """The nodes of a text's field with their scores, and its edges, each ``chain``, ``skip`` or ``similar``.

    Neighbours are tied, each span to the last one of its value, however far, and to the last one that is similar: a word to its
    inflection or other spelling, a name to the mail address that has it.
    """
    nodes: list[tuple[int, int]] = []
    scores: list[dict[str, float]] = []
    keys: list[str] = []
    alike: list[tuple[str, ...]] = []
    loose: list[tuple[int, Part]] = []
    start, closed, known, lines = 0, False, False, lexicon.lines
    for line in text.split("\n"):
        if line:
            lead = 0 if line[0].isalnum() else _LEAD.match(line).end()
            said = line[lead:] if lead else line
            if said:
                part = lines.get((said, closed)) or _scan(said, closed, lexicon)
                at = start + lead
                if part.nodes:
                    nodes += [(a + at, b + at) for a, b in part.nodes]
                    scores += part.scores
                    keys += part.keys
                    alike += part.alike
                    known = known or part.strong
                if part.loose:
                    loose.append((at, part))
                if said != "\r":
                    closed = part.closes
        start += len(line) + 1
    first = len(nodes)
    bare: set[int] = set()
    if loose and known:  # without a name or mail address in the text, or where the word is also written small, nothing can turn a loose one
        plain, at = [], 0  # a mail address writes every word small
        held: set[str] = set()
        for (a, b), x, forms in zip(nodes, scores, alike, strict=True):
            if "email" in x:
                held.update(forms)
                if a >= at:
                    plain.append(text[at:a])
                    at = b
        spoken = set(_SMALL.findall(" ".join([*plain, text[at:]])))
        for at, part in loose:
            for a, b, x, key, forms in part.loose:
                if key not in spoken:
                    nodes.append((a + at, b + at))
                    scores.append(x)
                    keys.append(key)
                    alike.append(forms)
        bare = {k for k in range(first, len(nodes)) if held.isdisjoint(alike[k])} if held else set(range(first, len(nodes)))
    edges: list[tuple[int, int, str]] = []
    if len(nodes) < 2:
        return nodes, scores, edges
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    for x, y in zip(order, order[1:], strict=False):
        # a bare word is a surname after a name, but no neighbour before one
        if nodes[y][0] - nodes[x][1] <= 3 and set(scores[x]) & set(scores[y]) and (y not in bare or "name" in scores[x] and text[nodes[x][1] : nodes[y][0]] == " ") and (x not in bare or y in bare):
            edges.append((x, y, "chain"))
    last: dict[str, int] = {}
    near: dict[str, int] = {}
    for k in order:  # the chain carries on from there
        if keys[k] in last:
            edges.append((last[keys[k]], k, "skip"))
        for form in alike[k]:
            for stem in {form, form[:-1], form[:-2]} if len(form) > 5 and "name" in scores[k] else (form,):
                if stem in near and keys[near[stem]] != keys[k]:
                    edges.append((near[stem], k, "similar"))
                    break
        last[keys[k]] = k
        for form in alike[k]:
            near[form] = k
    return nodes, scores, edges


_SMALL = re.compile(r"(?<![\w@.])[^\W\d_A-ZÀ-ÖØ-Þ][\w’'-]*")


def find_spans(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of the personal information in a text, in order, without overlaps."""
    nodes, scores, edges = field_of(text, lexicon)
    weight = dict(zip(("chain", "skip", "similar"), lexicon.weights, strict=True))
    found = _labels(scores, [(a, b, weight[kind]) for a, b, kind in edges])
    return sorted((a, b, t) for (a, b), t in zip(nodes, found, strict=True) if t)


KINDS = ("chain", "skip", "similar")


def _tally(scores: list[dict[str, float]], edges: list[tuple[int, int, str]], counts: list[int]) -> None:
    """Count a field: nodes sure to be something, all sure ones (a score of :data:`SURE` or more, either way), and of each
    kind of edge those between sure ends that disagree and agree."""
    top = [max(x.values()) for x in scores]
    counts[0] += sum(x >= SURE for x in top)
    counts[1] += sum(abs(x) >= SURE for x in top)
    for a, b, kind in edges:
        if abs(top[a]) >= SURE and abs(top[b]) >= SURE:
            counts[2 + 2 * KINDS.index(kind) + ((top[a] > 0) == (top[b] > 0))] += 1


def _weights(counts: list[int]) -> tuple[float, float, float]:
    """The weights of chain, skip and similar edges from the counts of :func:`_tally`: half the log of how much likelier two tied
    spans agree than two that are not tied, within the bounds that are set. A kind of edge seen fewer than 20 times keeps its weight."""
    yes, total = counts[:2]
    share = yes / total if total else 0.5
    chance = min(0.95, max(0.5, share**2 + (1 - share) ** 2))
    out = []
    for k, now in enumerate((CHAIN, SKIP, SIMILAR)):
        no, same = counts[2 + 2 * k : 4 + 2 * k]
        odds = (same + 1) / (no + 1) / (chance / (1 - chance))
        out.append(now if no + same < 20 else min(MOST_WEIGHT, max(LEAST_WEIGHT, 0.5 * math.log(odds))))
    return tuple(out)


def fit_weights(texts: Iterable[str], lexicon: Lexicon) -> tuple[float, float, float]:
    """The weights of chain, skip and similar edges (:func:`_weights`), from the edges of *texts* whose ends are both sure by themselves."""
    counts = [0] * (2 + 2 * len(KINDS))
    for text in texts:
        _, scores, edges = field_of(text, lexicon)
        _tally(scores, edges, counts)
    return _weights(counts)


def name_lexicon(records: DataFrame) -> tuple[set[int], set[int]]:
    """The words of senders' names, and those that firms use more, as places of a table of ``2**BITS``, from all records.

    Names are the shown ones, and of bare addresses the parts of ``first.last``. Addresses of roles belong to firms: a word that
    they use more than persons do speaks against a name, but does not rule it out. The result is bounded by the table.
    """
    address = F.col("from_addr")
    local = F.regexp_extract(address, r"([^\s<>@]+)@", 1)
    shown = F.regexp_extract(address, r"^([^<@]*)<", 1)
    firm = F.lower(local).rlike(_ROLE)
    parts = F.when(~firm & local.rlike(r"^[^\W\d_]{2,}[._][^\W\d_]{2,}$"), F.regexp_replace(local, "[._]", " "))
    rows = records.filter(address.isNotNull()).select(F.when(F.trim(shown) != "", shown).otherwise(parts).alias("shown"), firm.alias("firm")).filter("shown <> ''").groupBy("shown", "firm").count()
    words = rows.select("firm", "count", F.explode(F.regexp_extract_all("shown", F.lit(r'[^\s,"<>();]+'), F.lit(0))).alias("w")).select("firm", "count", F.lower("w").alias("w"))
    words = words.filter((F.length("w") > 1) & ~F.col("w").rlike(r"[0-9.&/|]")).groupBy("w").agg(F.sum(F.when(F.col("firm"), -F.col("count")).otherwise(F.col("count"))).alias("n")).select("w", (F.col("n") <= 0).alias("firm"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for w, f in zip(pdf["w"], pdf["firm"], strict=True):
                out.add((_place(w), f))
                if not w.isascii():  # as it looks where its letters were lost
                    out.add((_place(re.sub(r"[^\x00-\x7f]", "�", w)), f))
                    out.add((_place(re.sub(r"[^\x00-\x7f]", "��", w)), f))
            yield pd.DataFrame(sorted(out), columns=["place", "firm"])

    places = words.mapInPandas(hashed, "place bigint, firm boolean").distinct().toPandas()
    return set(places["place"][~places["firm"].astype(bool)].tolist()), set(places["place"][places["firm"].astype(bool)].tolist())


_LEXICA: dict[int, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    key, (places, firms) = shared.value
    if key not in _LEXICA:
        _LEXICA.clear()
        _LEXICA[key] = Lexicon(places, firms)
        gc.set_threshold(50_000)  # the lines that are kept hold no cycles
    return _LEXICA[key]


def texts_of(records: DataFrame, messages: DataFrame) -> DataFrame:
    """``tbl, row_key, field, text`` of the fields that may hold personal information; of messages the holding rows."""
    mails = records.filter("delivery_id is not null and content is not null and content <> ''").select(F.lit("records").alias("tbl"), F.col("delivery_id").cast("string").alias("row_key"), F.lit("content").alias("field"), F.col("content").alias("text"))
    held = messages.filter("id is not null").groupBy("id").agg(F.max_by(F.struct("one_line", "action_summary"), F.struct(*[c for c in ("synced_at", "enriched_at", "policy_hash") if c in messages.columns])).alias("_h"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_h.{f}").alias("text")) for f in ("one_line", "action_summary")]))
    short = held.select("id", each.alias("_x")).filter("_x.text is not null and _x.text <> ''")
    return mails.unionByName(short.select(F.lit("messages").alias("tbl"), F.col("id").alias("row_key"), "_x.field", "_x.text"))


def _lines_of(ends: list[int], a: int, b: int) -> range:
    """The lines of a span, of a text with these places of line ends."""
    return range(bisect.bisect_left(ends, a), bisect.bisect_left(ends, b) + 1)


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    at, parts = 0, []
    for a, b, t in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"[{t.upper()}]"]
            at = b
    return "".join([*parts, text[at:]])


FIELDS = "tbl string, row_key string, field string, lines array<int>, types array<string>, text string, open string, counts array<bigint>"


def read_fields(rows: DataFrame, names: tuple[set[int], set[int]], with_text: bool = False) -> DataFrame:
    """The fields of the texts of :func:`texts_of`, as far as they don't depend on the weights: ``lines`` and ``types`` of
    certain labels (*with_text* instead ``text``, with placeholders unless something is open), and ``open``, JSON of the other parts of the
    field: their spans as first and last line (*with_text* as start and end), scores and edges, and *with_text* the certain spans. A row
    with ``counts`` (:func:`_tally`) only stands for each batch.
    """
    import uuid

    shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        schema = pa.schema([("tbl", pa.string()), ("row_key", pa.string()), ("field", pa.string()), ("lines", pa.list_(pa.int32())), ("types", pa.list_(pa.string())), ("text", pa.string()), ("open", pa.string()), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            counts, out = [0] * (2 + 2 * len(KINDS)), []
            for tbl, key, field, text in zip(*[batch.column(c).to_pylist() for c in ("tbl", "row_key", "field", "text")], strict=True):
                nodes, scores, edges = field_of(text, lexicon)
                if not nodes:
                    if with_text:
                        out.append((tbl, key, field, None, None, text, None, None))
                    continue
                _tally(scores, edges, counts)
                found, open_ = _certain(scores, edges)
                for part, _ in open_:
                    for k in part:
                        found[k] = ""
                spans = [(a, b, t) for (a, b), t in zip(nodes, found, strict=True) if t]
                if with_text:
                    parts = [([nodes[k] for k in part], [scores[k] for k in part], links) for part, links in open_]
                    out.append((tbl, key, field, None, None, text, json.dumps([spans, parts]), None) if parts else (tbl, key, field, None, None, _replaced(text, spans), None, None))
                elif spans or open_:
                    ends = [m.start() for m in re.finditer("\n", text)] if field == "content" else []
                    seen = list({(n, t) for a, b, t in spans for n in _lines_of(ends, a, b)})
                    at = [_lines_of(ends, *x) for x in nodes] if open_ else []
                    parts = [([(at[k][0], at[k][-1]) for k in part], [scores[k] for k in part], links) for part, links in open_]
                    out.append((tbl, key, field, [n for n, _ in seen], [t for _, t in seen], None, json.dumps(parts) if parts else None, None))
            out.append((None,) * 7 + (counts,))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, FIELDS)


def _turn(parts: list, weights: tuple[float, float, float]) -> list[tuple[int, int, str]]:
    """The spans of a field's open parts that have a label."""
    weight = dict(zip(KINDS, weights, strict=True))
    return [(a, b, t) for spans, scores, links in parts for (a, b), t in zip(spans, _turned(scores, [(x, y, weight[kind]) for x, y, kind in links]), strict=True) if t]


def find_personal(records: DataFrame, messages: DataFrame, with_text: bool = False) -> DataFrame:
    """``tbl, row_key, field, line_no, entity_type``: each line and type found in it; with *with_text* instead one row a
    text with ``redacted``, in which each span is a placeholder of its type.

    Null and empty texts and null ids give no row. Rows that repeat a ``delivery_id`` give each line once, messages count once an
    id. Whole texts are read, and the weights are fitted on all of them; other columns are ignored.
    """
    ship_package(records.sparkSession)
    fields = materialize(read_fields(texts_of(records, messages), name_lexicon(records), with_text), "fields")
    counted = fields.filter("counts is not null").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    counts = {r["k"]: r["n"] for r in counted.collect()}
    weights = _weights([counts.get(k, 0) for k in range(2 + 2 * len(KINDS))])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tbl, key, field, parts in pdf.itertuples(index=False, name=None):
                out += [(tbl, key, field, n, t) for n, t in {(n, t) for a, b, t in _turn(json.loads(parts), weights) for n in range(a, b + 1)}]
            yield pd.DataFrame(out, columns=["tbl", "row_key", "field", "line_no", "entity_type"])

    def redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, open_ in zip(pdf["text"], pdf["open"], strict=True):
                spans, parts = json.loads(open_)
                texts.append(_replaced(text, [*map(tuple, spans), *_turn(parts, weights)]))
            yield pdf[["tbl", "row_key", "field"]].assign(redacted=texts)

    open_ = fields.filter("open is not null")
    if with_text:
        certain = fields.filter("text is not null and open is null").select("tbl", "row_key", "field", F.col("text").alias("redacted"))
        return certain.unionByName(open_.select("tbl", "row_key", "field", "text", "open").mapInPandas(redacted, "tbl string, row_key string, field string, redacted string"))
    certain = fields.select("tbl", "row_key", "field", F.explode(F.arrays_zip("lines", "types")).alias("x")).select("tbl", "row_key", "field", F.col("x.lines").alias("line_no"), F.col("x.types").alias("entity_type"))
    turned = open_.select("tbl", "row_key", "field", "open").mapInPandas(lines, "tbl string, row_key string, field string, line_no int, entity_type string")
    return certain.unionByName(turned).distinct()
