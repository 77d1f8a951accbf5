"""The detection rules in the order in which they run, planned from options.

Masking applies them one after the other, each to what the one before left, so
key=value rules come before formats and the organisation's names come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logveil.functions import checks
from logveil.functions.lists import CASE_SENSITIVE, CEF_USER_FIELDS, CLASS_ORDER
from logveil.functions.regex import alternatives, unicode
from logveil.plans.options import Options

# ---- fixed values: formats of sensitive values ----
JWT = r"eyJ[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_=]+\.?[A-Za-z0-9\-_.+/=]*"
URL = r"""(?i)\b(?:https?|ftps?|ssh|git|ftp|ws|wss)://[^\s<>"']+"""
TOKEN = rf"(?i)\b(?:gh[pousr]_[A-Za-z0-9_]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}}|xox[baprs]-[A-Za-z0-9\-]{{10,}}|ya29\.[A-Za-z0-9\-_]+|{JWT})\b"
CLOUD_SECRET = r"""(?i)\b(?:aws[_-]?secret[_-]?access[_-]?key|aws[_-]?access[_-]?key[_-]?id|azure[_-]?storage[_-]?key|google[_-]?api[_-]?key|sessiontoken|accountkey|clientsecret|oauth_token|access_token|refresh_token)\s*[:=]\s*["']?([A-Za-z0-9/+=_.:\-]{8,})"""
_KEY_KINDS = "(?:OPENSSH|RSA|DSA|EC|PGP)"
SSH_KEY = rf"(?s)-----BEGIN {_KEY_KINDS} PRIVATE KEY-----.*?-----END {_KEY_KINDS} PRIVATE KEY-----"
_CONN_PART = r"(?:Data Source|Server|Host|User Id|Uid|Pwd|Database|Initial Catalog|ConnectionString)\s*=\s*[^;\n\r,\s]+"
CONN_STR = rf"""(?i)\b(?:mongodb(?:\+srv)?://[^\s"'<>]+|(?:postgres(?:ql)?|mysql|mssql|amqp|redis|oracle|jdbc|snowflake|redshift)://[^\s"'<>]+|{_CONN_PART}(?:;\s*{_CONN_PART})+)"""
B64_CMD = r"(?i)(-(?:e|enc|encodedcommand)\s+)([A-Za-z0-9+/=]{20,2000})"
AUTH_USER = r"""(?i)(\b(?:accepted|failed)\s+password\s+for\s+(?:invalid\s+user\s+)?|\binvalid\s+user\s+|\bauthentication\s+failure\s+for\s+(?:user\s+)?|\bsession\s+(?:opened|closed)\s+for\s+user\s+|\bfor\s+user\s+["']|'su\s+(?:-\s+)?|\bUser\s+'|\buser\s+["']|\blogin\s+["'])([A-Za-z0-9_.$@\-]+)"""
_NAME = r"[A-Za-z0-9_.\-]+"
AUTH_SU_FROM = rf"(?i)('su\s+[^']*'\s+(?:failed\s+)?for\s+)({_NAME})(?=\s+on\b)"
AUTH_CISCO = rf"(?i)(\bby\s+(?={_NAME}\s+on\s+vty)|\bfrom\s+user\s+|\bUser\s+(?={_NAME}\s+(?:failed|logged|connected|authenticated)\b))({_NAME})"
AUTH_SUDO = rf"(?i)(\bsudo:\s+)({_NAME})(?=\s*:)"
AUTH_WIN = r"(?i)(\bAccount\s+Name:\s*)([A-Za-z0-9_.$@\\\-]+)"
USER_PATH = r"(?i)([A-Za-z]:\\Users\\|/home/|/Users/)([A-Za-z0-9._\-]+)"
SID = r"\bS-\d-\d+(?:-\d+)+\b"
HASH = r"\b[0-9a-fA-F]{32}\b|\b[0-9a-fA-F]{40}\b|\b[0-9a-fA-F]{64}\b"
UUID = r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IBAN = r"(?i)\bBY\d{2}[A-Z0-9]{24}\b"
UNP = r"(?i)(?<![A-Za-z0-9])[0-9ABCEHKMOPT]{2}\d{7}(?![A-Za-z0-9])"
BY_ID = r"(?<![A-Za-z0-9])\d{7}[A-Za-z]\d{3}[A-Za-z]{2}\d(?![A-Za-z0-9])"
#: A whole hash, with a letter.  Rules for numbers match it first and their checks leave it, as no digits within a hash are a number.
_IN_HASH = r"\b(?=[0-9]*[a-fA-F])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"
PAN = rf"{_IN_HASH}|(?<!\d)(?:\d[ \-]*?){{13,19}}(?!\d)"
LOGIN = r"(?<!\\)\b[A-Za-z0-9_\-]+\\[A-Za-z0-9._\-]+\b"
MAC = r"\b(?:[0-9a-fA-F]{4}\.[0-9a-fA-F]{4}\.[0-9a-fA-F]{4}|(?:[0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2})\b"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IP_NET = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}(?:/\d{{1,2}}|:\d{{1,5}})\b"
IP = rf"{IPV4}|(?<![0-9a-fA-F:.])(?:[0-9a-fA-F]{{0,4}}:){{2,7}}[0-9a-fA-F]{{0,4}}(?![0-9a-fA-F:])"
#: Words before a field name that make it prose.
NOT_A_FIELD = ["invalid ", "wrong ", "bad ", "incorrect "]
RFC5424_HOST = r"(?m)^(<\d+>\d+\s+\S+\s+)(\S+)(?=\s+.*$)"
def key_value(fields: tuple[str, ...], longest: int) -> str:
    """name=value or name: value, quoted or not; prose about a field is none."""
    guard = "".join(f"(?<!{w})" for w in NOT_A_FIELD)
    n = f"{{1,{longest}}}"
    return rf"""(?i){guard}(\b(?:{alternatives(list(fields))})\b\s*[:=]\s*)(?:"([^"]{n})"|'([^']{n})'|([^\s,;()\[\]{{}}`'"]{n}))"""


def cef_value(fields: tuple[str, ...], longest: int) -> str:
    return rf"(?i)(\b(?:{alternatives(list(fields))})=[\"']?)([^\s,;()\[\]{{}}\"']{{1,{longest}}})"


def phone(prefixes: tuple[str, ...]) -> str:
    return rf"{_IN_HASH}|(?:{alternatives(list(prefixes))})(?:[\s()./\-]*\d){{7,12}}\b"


def fqdn(tlds: tuple[str, ...]) -> str:
    return rf"(?i)\b(?:[a-zA-Z0-9\-]+\.)+(?:{alternatives(list(tlds))})\b"


# ---- fixed values: rules that look for leftovers in masked text ----
RESIDUAL = {
    "EMAIL": EMAIL,
    "USER": r"(?<!\\)\b[A-Za-z0-9_\-]{2,}\\[A-Za-z0-9._\-]+\b",
    "IP": IPV4,
    "JWT": rf"\b{JWT}",
    "PHONE": rf"{_IN_HASH}|" r"(?:\+375|80(?:29|33|44|25|17))\s*\(?\d{2,3}\)?[\s.\-]?\d{3}[\s.\-]?\d{2}[\s.\-]?\d{2}\b",
    "UNP": UNP,
    "BY_ID": BY_ID,
    "IBAN": IBAN,
}
# ---- end of fixed values ----


def residual_pan(shortest: int) -> str:
    return rf"{_IN_HASH}|(?<!\d)\d{{{max(12, shortest)},19}}(?!\d)"


#: Strings of which every match of a rule holds one.  Where case does not count they are in lower case and free of i, k and s, which other characters fold to.
HINTS: dict[str, tuple[str, ...]] = {
    "JWT": ("eyJ",),
    "URL": ("://",),
    "TOKEN": ("gh", "hub_pat_", "xox", "ya29.", "eyj"),
    "CLOUD_SECRET": ("acce", "torage", "google", "ontoken", "account", "ecret", "_token"),
    "SSH_KEY": ("-----BEGIN",),
    "CONN_STR": ("://", ";"),
    "BASE64_CMD": ("-e",),
    "CEF_KV": ("=",),
    "SECRET": ("=", ":"),
    "USER_FIELD": ("=", ":"),
    "AUTH_USER": ("for", "nval", "'", '"'),
    "AUTH_USER_SU_FROM": ("'",),
    "AUTH_USER_CISCO": ("vty", "from", "fa", "ogged", "onnected", "uthent"),
    "AUTH_USER_SUDO": ("udo:",),
    "AUTH_USER_WIN": ("ccount",),
    "USER_PATH": ("/home/", ":\\u", "/u"),
    "SID": ("S-",),
    "UUID": ("-",),
    "EMAIL": ("@",),
    "IBAN": ("by",),
    "FQDN": (".",),
    "USER": ("\\",),
    "MAC": (":", "-", "."),
    "IP": (".", ":"),
}

#: Plain patterns of which every match that counts holds one; they cost less than a rule's own, which begins with a look behind or many words.
NEEDED: dict[str, str] = {
    "HASH": r"[0-9a-fA-F]{32}",
    "UNP": r"(?U)\d{7}",
    "BY_ID": r"(?U)\d{7}",
    "PAN": r"(?U)\d(?:[ \-]*\d){11}",
    "PHONE": r"(?U)\d(?:[\s()./\-]*\d){6}",
    "MAC": r"(?:[0-9a-fA-F]{2}[:\-]){5}|[0-9a-fA-F]{4}\.[0-9a-fA-F]{4}\.",
    "IP": r"[0-9]\.[0-9]|:[0-9a-fA-F]{0,4}:",
}

#: What a check sees of a match: (value, text, start, end).
Check = Callable[[Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """One kind of sensitive value.

    value: the groups that can hold the value (0: the whole match); what stands around it in the match is kept.
    forced: the tag of the pseudonym; None: classified by format, with `default` for values of no format.
    """

    tag: str
    pattern: str
    value: tuple[int, ...] = (0,)
    forced: str | None = None
    default: str = "VALUE"
    check: Check | None = None
    strategy: str = "full"
    canonical: str | None = None
    #: whether `default` is USER only after certain field names (group 1)
    user_fields: tuple[str, ...] = ()
    detects: bool = True
    #: strings in lower case of which, where case does not count, every match in an ASCII text holds one
    words: tuple[str, ...] = ()

    def regex(self) -> str:
        return unicode(self.pattern)

    def may_match(self, text: Column) -> Column:
        """Whether the text can hold a match that counts: tests for fixed strings and plain patterns, which are cheap, and then the pattern."""
        return may_hold(text, self.tag, self.pattern.startswith("(?i)"), self.words) & text.rlike(self.regex())


def may_hold(text: Column, tag: str, any_case: bool = False, words: tuple[str, ...] = ()) -> Column:
    """The cheap tests of a tag: its strings, its plain pattern and, in ASCII texts, its words."""
    some = F.lit(True)
    if hints := HINTS.get(tag):
        body = F.lower(text) if any_case and any(c.isalpha() for w in hints for c in w) else text
        some = reduce(Column.__or__, (body.contains(w) for w in hints))
    if tag in NEEDED:
        some = some & text.rlike(NEEDED[tag])
    if words and all(w.isascii() for w in words):
        # other characters fold to ASCII letters too
        body = F.lower(text)
        some = some & ((F.octet_length(text) != F.length(text)) | reduce(Column.__or__, (body.contains(w) for w in words)))
    return some


def shortest(words: Iterable[str]) -> tuple[str, ...]:
    """Words in lower case without those that hold another one."""
    low = sorted({w.lower() for w in words}, key=lambda w: (len(w), w))
    return tuple(w for i, w in enumerate(low) if not any(v in w for v in low[:i]))


def organisation(options: Options) -> str | None:
    """The pattern of the organisation's names, the longest first."""
    names: dict[str, str] = {}
    for name in (options.org_name, *options.org_aliases):
        if name.strip():
            names.setdefault(name.strip().lower(), name.strip())
    ordered = sorted(names.values(), key=len, reverse=True)
    return rf"(?i)\b(?:{alternatives(ordered)})\b" if ordered else None


def rules(options: Options) -> list[Rule]:
    """All rules in order; custom ones first, the highest priority first."""
    only = lambda f: lambda v, text, a, b: f(v)
    simple = lambda tag, pattern, check=None: Rule(tag, pattern, forced=tag, check=check, strategy=options.strategy(tag))
    user = lambda tag, pattern: Rule(tag, pattern, value=(2,), forced="USER")
    custom = sorted((r for r in options.custom_rules if r.enabled and r.pattern), key=lambda r: -r.priority)
    n = options.max_token_len

    def hash_check(value: Column, text: Column, start: Column, end: Column) -> Column:
        plausible = checks.hash_is_plausible(value)
        return plausible & checks.hash_has_context(text, start, end, short_hash_len=options.short_hash_len) if options.hash_requires_context else plausible

    found = [Rule(r.tag, r.pattern, forced=r.tag, strategy=r.strategy) for r in custom]
    found += [
        simple("JWT", JWT),
        simple("URL", URL),
        simple("TOKEN", TOKEN),
        simple("CLOUD_SECRET", CLOUD_SECRET),
        simple("SSH_KEY", SSH_KEY),
        simple("CONN_STR", CONN_STR),
        Rule("BASE64_CMD", B64_CMD, value=(2,), forced="B64_CMD"),
        Rule("CEF_KV", cef_value(options.cef_fields, n), value=(2,), user_fields=options.cef_user_fields, words=shortest(f"{f}=" for f in options.cef_fields)),
        Rule("SECRET", key_value(options.secret_fields, n), value=(2, 3, 4), default="SECRET", words=shortest(options.secret_fields)),
        Rule("USER_FIELD", key_value(options.user_fields, n), value=(2, 3, 4), default="USER", words=shortest(options.user_fields)),
        user("AUTH_USER", AUTH_USER),
        user("AUTH_USER_SU_FROM", AUTH_SU_FROM),
        user("AUTH_USER_CISCO", AUTH_CISCO),
        user("AUTH_USER_SUDO", AUTH_SUDO),
        user("AUTH_USER_WIN", AUTH_WIN),
        user("USER_PATH", USER_PATH),
        simple("SID", SID, only(lambda v: ~checks.sid_is_exempt(v, options.well_known_sids))),
        simple("HASH", HASH, hash_check),
        simple("UUID", UUID, only(lambda v: ~checks.guid_is_nil(v))),
        simple("EMAIL", EMAIL),
        simple("IBAN", IBAN, only(checks.iban_is_valid)),
        simple("UNP", UNP, only(checks.unp_is_valid)),
        simple("BY_ID", BY_ID, only(checks.personal_id_is_shaped)),
        simple("PAN", PAN, only(checks.pan_is_plausible)),
        simple("PHONE", phone(options.phone_prefixes), only(checks.phone_is_plausible)),
        replace(simple("FQDN", fqdn(options.fqdn_tlds), only(lambda v: checks.fqdn_is_plausible(v, options.fqdn_stop_words))), words=shortest(f".{t}" for t in options.fqdn_tlds)),
        simple("USER", LOGIN, only(checks.login_is_plausible)),
        simple("MAC", MAC),
        # an address with a length or a port is masked as an address; the tag is for classified values
        Rule("IP_NET", IP_NET, forced="IP_NET", check=only(lambda v: F.lit(False)), detects=True),
        simple("IP", IP, only(checks.is_ip)),
    ]
    if (names := organisation(options)) is not None:
        words = shortest(n.strip() for n in (options.org_name, *options.org_aliases) if n.strip())
        found.append(Rule("ORG", names, forced="ORG", canonical=options.org_name if options.org_aliases_share_pseudonym else None, words=words))
    return found


def pseudonyms(options: Options) -> str:
    """The pattern of what masking writes, which no rule looks into."""
    tags = {*CLASS_ORDER, *CASE_SENSITIVE, *options.key_hints.values(), "VALUE", "SENSITIVE", "ORG", "CARD"}
    tags |= {rule.forced for rule in rules(options) if rule.forced} | {rule.tag.upper() for rule in options.context_rules}
    return checks.own_pseudonym(sorted(tags), options.key.hash_len, options.short_hash_len or options.key.hash_len)


assert set(CEF_USER_FIELDS) <= set(Options().cef_fields)
