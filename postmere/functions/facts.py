"""Facts of an enrichment: country codes, carriers, travel."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The assigned ISO 3166-1 alpha-2 codes, a row for each first letter.
ISO_CODES = """
AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ
BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ
CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ
DE DJ DK DM DO DZ
EC EE EG EH ER ES ET
FI FJ FK FM FO FR
GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY
HK HM HN HR HT HU
ID IE IL IM IN IO IQ IR IS IT
JE JM JO JP
KE KG KH KI KM KN KP KR KW KY KZ
LA LB LC LI LK LR LS LT LU LV LY
MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ
NA NC NE NF NG NI NL NO NP NR NU NZ
OM
PA PE PF PG PH PK PL PM PN PR PS PT PW PY
QA
RE RO RS RU RW
SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ
TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ
UA UG UM US UY UZ
VA VC VE VG VI VN VU
WF WS
YE YT
ZA ZM ZW
"""
COUNTRIES = frozenset(ISO_CODES.split())
# Letters that folding replaces, and what marks a carrier as an address or a possessive (on folded text).
FOLDED = {"ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}
STREET = r"(?:\w*(?:gata|gate|gaten|veien|vegen|vei|veg|strasse|plass)|street|st|road|rd|avenue|ave|lane|ln|boulevard|blvd|rue|via|calle|alle)"
NO_CARRIER = rf"\w['’]s\b|\ws['’](?:\s|$)|\d+[a-z]?\s+(?:\w+\s+){{0,2}}{STREET}\b|\b{STREET}\s+\d+"
_NO_CARRIER = re.compile(NO_CARRIER)


def fold_char(c: str) -> str:
    """A character without accents and case; empty for a combining one."""
    if c.isascii():
        return c.lower()
    return "".join(x for x in unicodedata.normalize("NFKD", FOLDED.get(c, c)) if not unicodedata.combining(x)).casefold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(fold_char, text))


def carrier(name: str | None) -> str | None:
    """A carrier's name, unless it reads as an address or somebody's."""
    return None if name is None or _NO_CARRIER.search(fold(name)) else name


def country_code(code: Column) -> Column:
    """A code in upper case, or NULL if no country has it."""
    up = F.upper(F.trim(code))
    return F.when(up.isin(sorted(COUNTRIES)), up)
