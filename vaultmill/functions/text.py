"""Text functions as Column expressions, and their twins for the query string on the driver.

Terms: lower case, Latin diacritics removed, maximal runs of letters, numbers, private-use
characters and marks; no stemming, no stop words.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"  # what str.strip() and \s mean for Python strings
NOT_TERM = r"[^\p{L}\p{N}\p{Co}\p{M}]+"
NOT_PLAIN = "[^a-z0-9]+"  # the same in lower-case ASCII


def _plain_letters() -> dict[str, str]:
    """Letters that are an ASCII letter with one mark -> that letter; lone marks -> nothing."""
    out = {}
    for cp in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            out[chr(cp)] = parts[0].lower()
    return out | {chr(cp): "" for cp in range(0x300, 0x370)}


PLAIN = _plain_letters()
_keep = [c for c in PLAIN if PLAIN[c]]
_from = "".join(_keep) + "".join(c for c in PLAIN if not PLAIN[c])
_to = "".join(PLAIN[c] for c in _keep)
_table = str.maketrans(PLAIN)


def terms(text: Column) -> Column:
    """The terms of a text in order. ASCII, where no letter has a mark, is split by a plain class of letters."""
    low = F.lower(text)
    ascii_only = F.octet_length(text) == F.length(text)
    return F.filter(F.when(ascii_only, F.split(low, NOT_PLAIN)).otherwise(F.split(F.translate(low, _from, _to), NOT_TERM)), lambda t: t != "")


def terms_of(text: str) -> list[str]:
    if text.isascii():
        return re.findall("[a-z0-9]+", text.lower())
    out, word = [], []
    for c in [*text.lower().translate(_table), " "]:
        if unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Co":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def strip(text: Column) -> Column:
    """Without blanks at both ends. Texts without any there, which are most, are not searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(BLANK), F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")).otherwise(text)


def doc_id(path: Column) -> Column:
    """A stable id: the first 16 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)^(.+)\.[^.]+$", "$1")


def parent(path: Column) -> Column:
    """The folder with a closing slash; empty at the top."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))


# lower-case letters that full case folding changes further (sharp s, final sigma, ligatures and the like)
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c != c.casefold()}


def fold(text: Column) -> Column:
    """Key for names: stripped, without case. Letters that lower() leaves are looked up singly, in texts that have any."""
    low = F.lower(strip(text))
    table = F.str_to_map(F.lit(",".join(f"{c}:{to}" for c, to in FOLDED.items())), F.lit(","), F.lit(":"))  # a constant
    full = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when((F.octet_length(low) > F.length(low)) & low.rlike(f"[{''.join(FOLDED)}]"), full).otherwise(low)


# fixed values: characters and words of the query language that free text is freed of, and the marks
# that the query language does not take even so
OPERATORS = r'["*():^\-=\[\]{}<>~+|?,/;!@#$%&_]'
KEYWORDS = r"\b(?:AND|OR|NOT|NEAR)\b"
REFUSED = ".'`\\"


def query_tokens(text: str) -> list[str]:
    return re.sub(KEYWORDS, " ", re.sub(OPERATORS, " ", text)).split()


def sanitize(text: str) -> str:
    """Free text as a disjunction: tokens joined by OR; empty if none is left."""
    return " OR ".join(query_tokens(text))


def sanitized(text: Column) -> Column:
    """The same for a column."""
    plain = F.regexp_replace(F.regexp_replace(text, OPERATORS.replace(r"\[\]", r"\[\]"), " "), f"(?U){KEYWORDS}", " ")
    return F.array_join(F.filter(F.split(plain, rf"{BLANK}+"), lambda t: t != ""), " OR ")


def excerpt(text: Column, most: int = 280) -> Column:
    """One line, at most ``most`` characters."""
    line = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)
