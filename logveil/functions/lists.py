"""Word lists, field names, weights and tags that results depend on."""

# ---- fixed values: names of fields in key=value text ----
CEF_FIELDS = ["src", "dst", "suser", "duser", "cs1", "cs2", "cs3", "cs4", "shost", "dhost", "src_ip", "dst_ip", "srcip", "dstip", "orig", "origin", "peer_gateway"]
CEF_USER_FIELDS = ["suser", "duser"]
USER_FIELDS = [
    "user", "username", "login", "account", "subject.account.name", "uname", "subject", "src_user", "dst_user",
    "srcuser", "dstuser", "target_user", "targetuser", "accountname", "object.account.name", "usr", "xauth_user",
    "srcname", "dstname", "user.name", "src_user_name", "dst_user_name", "account_name", "subject.account.id",
    "object.account.id", "event_src.host", "event_src.ip",
]
SECRET_FIELDS = ["password", "passwd", "secret", "api_key", "apikey", "token", "auth_key", "bearer"]

# ---- fixed values: formats ----
PHONE_PREFIXES = ["+375", "375", "8029", "8033", "8044", "8025", "8017", "+7", "+380", "+48", "+370", "+371", "+372", "+1", "+44"]
FQDN_TLDS = ["by", "com", "ru", "org", "net", "lan", "corp", "local", "internal", "gov", "io", "info", "edu", "mil", "biz", "co"]
WELL_KNOWN_SIDS = ["S-1-1-0", "S-1-5-18", "S-1-5-19", "S-1-5-20", "S-1-5-32-544", "S-1-5-32-545", "S-1-5-32-546", "S-1-5-32-547", "S-1-5-32-551"]
NIL_GUID = "00000000-0000-0000-0000-000000000000"
FQDN_STOP_WORDS = [
    "a", "an", "the", "for", "from", "with", "this", "that", "not", "and", "or", "but", "all", "any", "new", "old",
    "get", "set", "put", "use", "via", "per", "see", "info", "report", "file", "data", "test", "true", "false",
    "none", "null", "type", "name", "src", "dst", "to", "in", "on", "at", "by", "of", "as", "is", "be", "no", "ok", "id",
]
FQDN_STOP_ENDS = ["info", "file", "data"]
PATH_WORDS = ["windows", "system32", "syswow64", "users", "program", "files", "appdata", "temp", "tmp", "winnt", "drivers", "driver", "programfiles", "documents", "downloads", "desktop"]
RESIDUAL_PATH_WORDS = ["windows", "system32", "users", "program", "files"]
HASH_WORDS = r"(?i)(?:hash|md5|sha-?1|sha-?256|sha-?512|ntlm|digest|checksum|thumbprint|fingerprint)"
HASH_RADIUS = 48
UNP_WEIGHTS = [29, 23, 19, 17, 13, 7, 5, 3]
UNP_LETTERS = {"A": 10, "B": 11, "C": 12, "E": 13, "H": 14, "K": 15, "M": 16, "O": 17, "P": 18, "T": 19}

# ---- fixed values: tags ----
CLASS_ORDER = ["JWT", "SID", "HASH", "UUID", "MAC", "IP_NET", "IP", "EMAIL", "IBAN", "UNP", "BY_ID", "PAN", "USER", "FQDN", "PHONE", "URL", "TOKEN", "CLOUD_SECRET", "SSH_KEY", "CONN_STR"]
CASE_SENSITIVE = ["SECRET", "B64_CMD"]
FAMILIES = {
    "IP": ["IP", "IP_NET"],
    "USER": ["USER", "USER_FIELD", "AUTH_USER", "AUTH_USER_CISCO", "AUTH_USER_SU_FROM", "AUTH_USER_SUDO", "AUTH_USER_WIN", "USER_PATH"],
    "SECRET": ["SECRET", "TOKEN", "CLOUD_SECRET", "SSH_KEY", "CONN_STR", "BASE64_CMD", "B64_CMD", "SENSITIVE"],
    "PAN": ["PAN", "CARD"],
}
STRUCTURAL = ["CEF_KV", "SECRET", "USER_FIELD", "AUTH_USER", "AUTH_USER_CISCO", "AUTH_USER_SU_FROM", "AUTH_USER_SUDO", "AUTH_USER_WIN", "USER_PATH", "BASE64_CMD"]
STRATEGIES = {"PHONE": "partial", "PAN": "partial", "CARD": "partial", "IBAN": "partial", "UNP": "full", "BY_ID": "partial"}
RISK = {"JWT": 25, "SECRET": 25, "PAN": 20, "IBAN": 20, "UNP": 18, "BY_ID": 18, "EMAIL": 12, "USER": 12, "PHONE": 10, "IP": 8}
RISK_OTHER = 10

# ---- fixed values: sensitive keys of JSON documents, with the tag of values that have no format of their own ----
KEY_HINTS = {
    "IP": ["ip", "ipaddress", "srcip", "destip", "dstip", "sourceip", "destinationip", "clientip", "calleripaddress", "sourceipaddress", "ipaddressorproxy", "src.ip", "dst.ip", "src.ip.v4", "src.ip.v6", "dst.ip.v4", "dst.ip.v6", "event_src.ip", "recv_ipv4", "recv_ipv6", "asset.ip"],
    "EMAIL": ["email", "subject.email", "object.email"],
    "FQDN": ["domain", "computername", "host", "hostname", "srchost", "dsthost", "workstationname", "src.host", "dst.host", "src.hostname", "dst.hostname", "src.fqdn", "dst.fqdn", "event_src.host", "event_src.hostname", "event_src.fqdn", "recv_host", "asset", "asset.name", "asset.fqdn"],
    "USER": ["user", "username", "login", "account", "subjectaccountname", "targetusername", "objectaccountname", "subjectaccountdomain", "objectaccountdomain", "userprincipalname", "upn", "displayname", "mailnickname", "subjectusername", "targetdomainname", "subjectdomainname", "principalid", "sessionissuer", "accountname", "srcusername", "dstusername", "subject.account.id", "object.account.id", "subject.account.session_id", "subject.account.privileges", "subject.name", "object.name", "subject.id", "object.id"],
    "SECRET": ["password", "passwd", "secret", "token", "apikey", "authorization", "accesskeyid", "arn", "accountnumber"],
    "PHONE": ["phone", "mobile", "msisdn", "subject.phone", "object.phone"],
    "UNP": ["unp", "vat", "taxid", "payerid"],
    "IBAN": ["iban"],
    "PAN": ["pan", "card", "cardnumber"],
    "BY_ID": ["personalnumber", "passport", "passportnumber"],
    "MAC": ["src.mac", "dst.mac", "event_src.mac"],
    "VALUE": ["logon_service", "external_id"],
}
#: Sensitive keys without a hint.
KEYS_WITHOUT_HINT = ["initiatedby", "recipientaccountid", "useridentity", "src.geo", "dst.geo"]
#: Keys that only have a hint.
HINTS_ONLY = ["destip"]
# ---- end of fixed values ----


def family(tag: str) -> str:
    """The family that a tag belongs to."""
    if tag.startswith("CUSTOM:"):
        return "CUSTOM"
    return next((name for name, tags in FAMILIES.items() if tag in tags), tag)
