"""Message identifiers: their grammar and their one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of a message reference and of each kind's provider uid.
ID_PATTERN = r"^([a-z0-9_-]{1,32}):([a-z0-9_-]{1,32})::([\s\S]+)$"
UID_PATTERNS = {
    "gmail": r"^[0-9a-f]{8,32}\z",
    "imap": r"^[^\x00-\x1f]+:[1-9][0-9]*:[1-9][0-9]*\z",
    "jmap": r"^[A-Za-z0-9_-]{1,255}\z",
    "graph": r"^[A-Za-z0-9_=+/-]{1,512}\z",
}
_EDGES = r"^[\s ]+|[\s ]+$"


def parse_id(ref: Column) -> Column:
    """Struct ``kind, mailbox, uid, folder, uidvalidity, imap_uid`` of a message reference; NULL outside the grammar.

    The folder and the two numbers are read from the right and are NULL for other kinds than IMAP.
    """
    part = lambda k: F.regexp_extract(ref, ID_PATTERN, k)
    kind, uid = part(1), part(3)
    valid = F.lit(False)
    for name, pattern in UID_PATTERNS.items():
        valid = valid | ((kind == name) & uid.rlike(pattern))
    imap = r"^([\s\S]+):([0-9]+):([0-9]+)\z"
    of = lambda k: F.when(kind == "imap", F.regexp_extract(uid, imap, k))
    fields = F.struct(
        kind.alias("kind"), part(2).alias("mailbox"), uid.alias("uid"),
        of(1).alias("folder"), of(2).try_cast("long").alias("uidvalidity"), of(3).try_cast("long").alias("imap_uid"),
    )
    return F.when(ref.rlike(ID_PATTERN) & valid, fields)


def document_id(source: Column, uid: Column) -> Column:
    """``<source>::<uid>``."""
    return F.concat(source, F.lit("::"), uid)


def canonical_source(source: Column) -> Column:
    """A source in the grammar's spelling: no outer white space, lower case."""
    return F.lower(F.regexp_replace(source, _EDGES, ""))


def canonical_uid(source: Column, uid: Column) -> Column:
    """A provider uid in the one spelling its kind allows; *source* is canonical.

    Outer white space goes everywhere; Gmail's hexadecimal digits are lower case; IMAP's two numbers carry no
    leading zeros. Case stays in the other kinds, whose ids distinguish it.
    """
    bare = F.regexp_replace(uid, _EDGES, "")
    imap = F.regexp_replace(bare, r"^([\s\S]*):\s*0*([1-9][0-9]*):0*([1-9][0-9]*)\z", "$1:$2:$3")
    return F.when(source.startswith("gmail:"), F.lower(bare)).when(source.startswith("imap:"), imap).otherwise(bare)


def canonical_message_id(header: Column) -> Column:
    """A Message-ID without outer blanks and angle brackets; NULL if nothing is left."""
    return F.nullif(F.regexp_replace(header, r"^[\s <>]+|[\s <>]+$", ""), F.lit(""))
