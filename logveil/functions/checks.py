"""Checks of candidate values, as Column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logveil.functions.lists import FQDN_STOP_ENDS, FQDN_STOP_WORDS, HASH_RADIUS, HASH_WORDS, NIL_GUID, PATH_WORDS, UNP_LETTERS, UNP_WEIGHTS, WELL_KNOWN_SIDS

_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _chars(value: Column) -> Column:
    """Characters of a string as an array."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def is_ip(value: Column) -> Column:
    """IPv4 without leading zeros, or IPv6 in full or with one `::`."""
    four = value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    shaped = value.rlike(r"^[0-9A-Fa-f:]+$") & ~value.rlike(r"[0-9A-Fa-f]{5}") & ~value.rlike(r":::")
    full = shaped & ~value.contains("::") & (groups == 8) & (F.size(F.split(value, ":")) == 8)
    doubles = F.size(F.split(value, "::", -1)) - 1
    short = shaped & (doubles == 1) & (groups <= 7) & ~value.rlike(r"^:[^:]") & ~value.rlike(r"[^:]:$")
    return four | full | short


def hash_is_plausible(value: Column) -> Column:
    """Hex with a letter and at least four distinct characters."""
    return value.rlike("[A-Fa-f]") & (F.size(F.array_distinct(_chars(F.lower(F.trim(value))))) >= 4)


def hash_has_context(text: Column, start: Column, end: Column, radius: int = HASH_RADIUS, short_hash_len: int | None = None) -> Column:
    """A word about hashes within `radius` characters of [start, end); whole hashes of pseudonyms count as short ones."""
    low = F.greatest(start - radius, F.lit(0))
    if short_hash_len is not None:
        near = lambda part: F.regexp_replace(part, rf"(\[[A-Z][A-Z0-9_:]*_[0-9a-f]{{{short_hash_len}}})[0-9a-f]+\]", "$1]")
        before, behind = near(F.left(text, start)), near(F.substring(text, end + 1, F.length(text)))
        return F.concat(F.right(before, F.lit(radius)), F.substring(text, start + 1, end - start), F.left(behind, F.lit(radius))).rlike(HASH_WORDS)
    return F.substring(text, low + 1, end + radius - low).rlike(HASH_WORDS)


def fqdn_is_plausible(value: Column, more_stop_words: list[str] | tuple[str, ...] = ()) -> Column:
    labels = F.filter(F.split(F.lower(value), r"\."), lambda x: x != "")
    stops = [*FQDN_STOP_WORDS, *(w.lower() for w in more_stop_words)]
    last = F.element_at(labels, -1)
    return (F.size(labels) >= 2) & ~F.get(labels, F.lit(0)).isin(*stops) & ~(last.isin(*stops) & last.isin(*FQDN_STOP_ENDS))


def is_in_hash(value: Column) -> Column:
    """Whether a rule for numbers has matched a whole hash, as it does to pass over it."""
    return value.rlike("[A-Fa-f]")


def phone_is_plausible(value: Column) -> Column:
    return ~is_in_hash(value) & F.length(F.regexp_replace(value, r"(?U)\D", "")).between(10, 15)


def login_is_plausible(value: Column) -> Column:
    r"""DOMAIN\user with a domain of two characters and no part of a path on either side."""
    domain, user = F.substring_index(value, "\\", 1), F.substring(value, F.instr(value, "\\") + 1, F.length(value))
    paths = lambda c: F.lower(c).isin(*PATH_WORDS)
    return value.contains("\\") & (F.length(domain) >= 2) & (F.length(user) > 0) & ~paths(domain) & ~paths(user)


def unp_is_valid(value: Column) -> Column:
    """Tax id of nine characters: weighted sum of eight modulo 11 equals the ninth."""
    raw = F.upper(F.trim(value))
    raw = F.when(raw.startswith("BY") & (F.length(raw) == 11), F.substring(raw, 3, 9)).otherwise(raw)
    letters = F.create_map(*(F.lit(x) for pair in UNP_LETTERS.items() for x in pair))
    number = lambda i: F.coalesce(F.substring(raw, i + 1, 1).try_cast("int"), letters[F.substring(raw, i + 1, 1)])
    total = sum((number(i) * w for i, w in enumerate(UNP_WEIGHTS)), F.lit(0))
    shape = raw.rlike(r"^[0-9ABCEHKMOPT]{2}[0-9]{7}$")
    return F.coalesce(shape & (total % 11 == F.substring(raw, 9, 1).try_cast("int")), F.lit(False))


def pan_is_plausible(value: Column) -> Column:
    """13 to 19 digits that are not all alike, with a right Luhn digit."""
    d = digits(value)
    return ~is_in_hash(value) & F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & F.call_function("luhn_check", d)


def iban_is_valid(value: Column) -> Column:
    """BY IBAN whose rearranged digits are 1 modulo 97."""
    raw = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(raw, 5, 40), F.substring(raw, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    rest = F.aggregate(_chars(moved), F.lit(0), lambda s, c: F.when(code(c) < 10, (s * 10 + code(c)) % 97).otherwise((s * 100 + code(c)) % 97).cast("int"))
    return raw.rlike(r"^BY\d{2}[A-Z0-9]{24}$") & (rest == 1)


def personal_id_is_shaped(value: Column) -> Column:
    return F.trim(value).rlike(r"^\d{7}[A-Za-z]\d{3}[A-Za-z]{2}\d$")


def allowed_form(value: Column) -> Column:
    """A value as it is looked up in an allowlist: blanks and case do not count."""
    return F.lower(F.trim(value))


def is_allowed(value: Column, allowlist: list[str] | tuple[str, ...]) -> Column:
    """Whether a value stands in a small allowlist; for a table see detect.without_allowed and mask.mask_text_allowing."""
    words = sorted({w.strip().lower() for w in allowlist if w.strip()})
    return allowed_form(value).isin(*words) if words else F.lit(False)


def sid_is_exempt(value: Column, sids: list[str] | tuple[str, ...] = tuple(WELL_KNOWN_SIDS)) -> Column:
    return F.upper(value).isin(*(s.upper() for s in sids))


def guid_is_nil(value: Column) -> Column:
    return F.lower(value) == NIL_GUID


#: Pseudonyms as they are written, collision suffix included.
PSEUDONYM = r"\[[A-Z][A-Z0-9_:]*_[0-9a-f]+(?:_\d+)?\]"


def own_pseudonym(tags: list[str], *hash_lens: int) -> str:
    """The pattern of pseudonyms with one of these tags and a hash part of one of these lengths."""
    parts = "|".join(f"[0-9a-f]{{{n}}}" for n in sorted(set(hash_lens), reverse=True))
    return rf"\[(?:{'|'.join(re.escape(t) for t in sorted(tags))})_(?:{parts})(?:_\d+)?\]"


def holds_pseudonym(value: Column) -> Column:
    return value.rlike(PSEUDONYM)


def is_pseudonym(value: Column) -> Column:
    return F.trim(value).rlike(rf"^{PSEUDONYM}$")
