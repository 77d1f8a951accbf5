"""Options of detection and masking."""

from __future__ import annotations

from dataclasses import dataclass, field

from logveil.functions import lists
from logveil.functions.hashing import Key


#: Digits of a whole keyed hash, which no two values share.
WHOLE_HASH = 64


@dataclass(frozen=True)
class CustomRule:
    """A rule of the user's own; `pattern` is a Java regular expression.  Without a name it goes by its type."""

    name: str
    pattern: str
    type: str | None = None
    strategy: str = "full"
    priority: int = 0
    enabled: bool = True

    @property
    def tag(self) -> str:
        return f"CUSTOM:{(self.name or self.type or 'CUSTOM').upper()}"


@dataclass(frozen=True)
class ContextRule:
    """Masks string values of JSON fields by exact key, by path or by a regular expression on keys."""

    field: str | None = None
    path: str | None = None
    field_pattern: str | None = None
    tag: str = "SENSITIVE"
    strategy: str = "full"
    enabled: bool = True


@dataclass(frozen=True)
class Options:
    #: derived from a salt for pseudonyms that runs share; else a random one
    key: Key = field(default_factory=Key.random)
    org_name: str = ""
    org_aliases: tuple[str, ...] = ()
    org_aliases_share_pseudonym: bool = False
    allowlist: tuple[str, ...] = ()
    custom_rules: tuple[CustomRule, ...] = ()
    context_rules: tuple[ContextRule, ...] = ()
    strategies: dict[str, str] = field(default_factory=lambda: dict(lists.STRATEGIES))
    cef_fields: tuple[str, ...] = tuple(lists.CEF_FIELDS)
    cef_user_fields: tuple[str, ...] = tuple(lists.CEF_USER_FIELDS)
    user_fields: tuple[str, ...] = tuple(lists.USER_FIELDS)
    secret_fields: tuple[str, ...] = tuple(lists.SECRET_FIELDS)
    phone_prefixes: tuple[str, ...] = tuple(lists.PHONE_PREFIXES)
    fqdn_tlds: tuple[str, ...] = tuple(lists.FQDN_TLDS)
    fqdn_stop_words: tuple[str, ...] = ()
    well_known_sids: tuple[str, ...] = tuple(lists.WELL_KNOWN_SIDS)
    hash_requires_context: bool = True
    mask_structured_hosts: bool = True
    max_token_len: int = 500
    min_digit_run: int = 12
    #: of a run under whole hashes: the digits of the names that texts carry in the end
    short_hash_len: int | None = None
    sensitive_keys: tuple[str, ...] = tuple(k for names in lists.KEY_HINTS.values() for k in names if k not in lists.HINTS_ONLY) + tuple(lists.KEYS_WITHOUT_HINT)
    key_hints: dict[str, str] = field(default_factory=lambda: {k: tag for tag, names in lists.KEY_HINTS.items() for k in names})

    def strategy(self, tag: str) -> str:
        return self.strategies.get(tag, "full")
