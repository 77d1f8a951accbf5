"""Registered queries of the masking operators, with SQL that gives the same rows.

Most run on log lines built from the table `events`, whose masked form SQL can write
down part by part; others on documents, pages, conversations and customers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.functions import checks
from logveil.functions.hashing import Key, pseudonym
from logveil.operators import detect, diff, jsondocs, mapping, mask, records, reports
from logveil.operators.classify import classified, pseudonym_type
from logveil.plans.options import Options
from logveil.sources.shared import checkpoint_folder, spread, written
from logveil.streaming import streams

KEY = Key.derive("demo-salt", 1000)
OPTIONS = Options(key=KEY, org_name="Bank of Example", org_aliases=("BoE",), org_aliases_share_pseudonym=True)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(value: str, key: Key = KEY) -> str:
    """SQL of a value's shortened keyed hash."""
    inner, outer = (p.hex() for p in key.pads())
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value})))), 1, {key.hash_len})"


def token(tag: str, value: str, key: Key = KEY) -> str:
    """SQL of a pseudonym."""
    return f"('[{tag}_' || {hashed(value, key)} || ']')"


#: Kinds of log lines: Spark SQL that DuckDB understands too.
LINES = {
    "kv": "'src=10.' || user_id % 200 || '.' || event_id % 250 || '.7 user=u' || user_id || ' action=' || event_type",
    "sshd": "'sshd[1]: Accepted password for u' || user_id || ' from 10.0.0.' || event_id % 250 || ' port 22'",
    "sudo": "'sudo: u' || user_id || ' : TTY=pts/0'",
    "path": "'open /home/u' || user_id || '/x.log'",
    "sid": "CASE WHEN user_id % 5 = 0 THEN 'SID S-1-5-18' ELSE 'SID S-1-5-21-1-2-3-' || user_id END",
    "mac": "'nic 00:1A:2B:3C:4D:' || upper(lpad(hex(user_id % 256), 2, '0'))",
    "hash": "CASE WHEN user_id % 2 = 0 THEN 'md5 ' ELSE 'req ' END || md5(CAST(user_id AS STRING))",
    "mail": "'contact u' || user_id || '@bank.com'",
    "org": "CASE WHEN user_id % 3 = 0 THEN 'ticket for BoE closed' ELSE 'ticket for bank of example closed' END",
    "host": "'<34>1 2026-01-01T00:00:00Z h' || user_id % 50 || '.bank.local app - - - ok'",
    "cef": "'CEF:0|V|P|1|100|N|5|src=10.0.0.1 suser=u' || user_id",
    "none": "'step ' || event_id || ' of HTTP/1.1 at 12:30:45 done'",
}
#: Their masked forms.
MASKED = {
    "kv": f"'src=' || {token('IP', "'10.' || user_id % 200 || '.' || event_id % 250 || '.7'")} || ' user=' || {token('USER', "'u' || user_id")} || ' action=' || event_type",
    "sshd": f"'sshd[1]: Accepted password for ' || {token('USER', "'u' || user_id")} || ' from ' || {token('IP', "'10.0.0.' || event_id % 250")} || ' port 22'",
    "sudo": f"'sudo: ' || {token('USER', "'u' || user_id")} || ' : TTY=pts/0'",
    "path": f"'open /home/' || {token('USER', "'u' || user_id")} || '/x.log'",
    "sid": f"CASE WHEN user_id % 5 = 0 THEN 'SID S-1-5-18' ELSE 'SID ' || {token('SID', "'s-1-5-21-1-2-3-' || user_id")} END",
    "mac": f"'nic ' || {token('MAC', "'00:1a:2b:3c:4d:' || lower(lpad(hex(user_id % 256), 2, '0'))")}",
    "hash": f"CASE WHEN user_id % 2 = 0 THEN 'md5 ' || {token('HASH', 'md5(CAST(user_id AS STRING))')} ELSE 'req ' || md5(CAST(user_id AS STRING)) END",
    "mail": f"'contact ' || {token('EMAIL', "'u' || user_id || '@bank.com'")}",
    "org": f"'ticket for ' || {token('ORG', "'bank of example'")} || ' closed'",
    "host": f"'<34>1 2026-01-01T00:00:00Z ' || {token('FQDN', "'h' || user_id % 50 || '.bank.local'")} || ' app - - - ok'",
    "cef": f"'CEF:0|V|P|1|100|N|5|src=' || {token('IP', "'10.0.0.1'")} || ' suser=' || {token('USER', "'u' || user_id")}",
    "none": LINES["none"],
}
#: (tag, original, count of occurrences where) of replacements by kind.
REPLACED = {
    "kv": [("IP", "'10.' || user_id % 200 || '.' || event_id % 250 || '.7'", "true"), ("USER", "'u' || user_id", "true")],
    "sshd": [("USER", "'u' || user_id", "true"), ("IP", "'10.0.0.' || event_id % 250", "true")],
    "sudo": [("USER", "'u' || user_id", "true")],
    "path": [("USER", "'u' || user_id", "true")],
    "sid": [("SID", "'S-1-5-21-1-2-3-' || user_id", "user_id % 5 <> 0")],
    "mac": [("MAC", "'00:1A:2B:3C:4D:' || upper(lpad(hex(user_id % 256), 2, '0'))", "true")],
    "hash": [("HASH", "md5(CAST(user_id AS STRING))", "user_id % 2 = 0")],
    "mail": [("EMAIL", "'u' || user_id || '@bank.com'", "true")],
}
#: The rules that each kind needs.
TAGS = {"kv": ["CEF_KV", "USER_FIELD"], "sshd": ["AUTH_USER", "IP"], "sudo": ["AUTH_USER_SUDO"], "path": ["USER_PATH"], "sid": ["SID"], "mac": ["MAC"], "hash": ["HASH"], "mail": ["EMAIL"], "org": ["ORG"], "host": ["RFC5424"], "cef": ["CEF_KV"], "none": ["IP"]}


def log_lines(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(event_id, user_id, kind, line), a line of each kind per event."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(LINES[k]).alias("line")) for k in kinds or LINES))
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")
    return events.select("event_id", "user_id", F.explode(rows).alias("l")).select("event_id", "user_id", "l.kind", "l.line")


def _sql(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


def lines_sql(columns: str = "event_id, user_id, kind, line", forms: dict[str, str] | None = None, *kinds: str) -> str:
    rows = " UNION ALL ".join(f"SELECT event_id, user_id, event_type, '{k}' AS kind, {_sql((forms or LINES)[k])} AS line FROM events" for k in kinds or LINES)
    return f"SELECT {columns} FROM ({rows}) AS lines"


def replaced_sql(columns: str, kinds: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT event_id, '{k}' AS kind, '{tag}' AS tag, {_sql(value)} AS original FROM events WHERE {when}" for k in kinds for tag, value, when in REPLACED[k])
    return f"SELECT {columns} FROM ({rows}) AS r"


# ---- masking by rule ----
def _register_rule(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mask.mask_text(log_lines(spark, sf_dir, kind), OPTIONS, "line", tags=TAGS[kind]).select("event_id", F.col("line").alias("masked"))

    run.__name__, run.__doc__ = f"mask_{kind}", f"Lines of kind {kind} masked by their rules."
    query(lines_sql("event_id, line AS masked", MASKED, kind))(run)


for _kind in LINES:
    _register_rule(_kind)


@query(lines_sql("event_id, kind, line AS masked", MASKED))
def mask_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of lines under the whole chain of rules."""
    return mask.mask_text(log_lines(spark, sf_dir), OPTIONS, "line").select("event_id", "kind", F.col("line").alias("masked"))


def _b1_sql(text: str, pattern: str, tag: str) -> str:
    p = pattern.replace("'", "''")
    out = f"list_transform(regexp_extract_all({text}, '{p}'), lambda v: {token(tag, 'lower(v)')})"
    return f"array_to_string(list_transform(string_split_regex({text}, '{p}'), lambda g, i: g || coalesce(({out})[i], '')), '')"


_EMAIL_RE2 = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_IP_RE2 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
_URL_RE2 = r"""(?i)\b(?:https?|ftps?|ssh|git|ftp|ws|wss)://[^\s<>"']+"""


@query(f"SELECT doc_id, {_b1_sql('text', _EMAIL_RE2, 'EMAIL')} AS masked FROM documents")
def mask_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_text(table(spark, sf_dir, "documents"), OPTIONS, tags=["EMAIL"]).select("doc_id", F.col("text").alias("masked"))


@query(f"SELECT doc_id, {_b1_sql('text', _IP_RE2, 'IP')} AS masked FROM documents")
def mask_ip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_text(table(spark, sf_dir, "documents"), OPTIONS, tags=["IP"]).select("doc_id", F.col("text").alias("masked"))


@query(f"SELECT page_id, {_b1_sql('url', _URL_RE2, 'URL')} AS masked FROM pages")
def mask_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_text(table(spark, sf_dir, "pages"), OPTIONS, "url", tags=["URL"]).select("page_id", F.col("url").alias("masked"))


@query(f"SELECT conv_id, turn, role, {_b1_sql('text', _EMAIL_RE2, 'EMAIL')} AS masked FROM conversations")
def mask_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_text(table(spark, sf_dir, "conversations"), OPTIONS, tags=["EMAIL"]).select("conv_id", "turn", "role", F.col("text").alias("masked"))


@query(f"SELECT c_custkey, {token('USER', 'lower(c_name)')} AS masked FROM customer")
def mask_column_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_column(table(spark, sf_dir, "customer"), "c_name", "USER", OPTIONS).select("c_custkey", F.col("c_name").alias("masked"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', '9', 'g') AS masked FROM customer")
def mask_format_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask.masked_value(F.col("c_name"), "USER", OPTIONS, "format")["out"].alias("masked"))


_PHONE = "'+37529' || lpad(CAST(c_custkey AS STRING), 7, '0')"


@query(f"SELECT c_custkey, '+3' || {token('PHONE', f'substr({_sql(_PHONE)}, 3, 9)')} || substr({_sql(_PHONE)}, 12, 2) AS masked FROM customer")
def mask_phone_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PHONE).alias("p"))
    return mask.mask_text(rows, OPTIONS, "p", tags=["PHONE"]).select("c_custkey", F.col("p").alias("masked"))


# digits of a key, weighted so that about one in ten passes the check
_PAN = "'4' || lpad(CAST(c_custkey * 7919 AS STRING), 15, '0')"
_LUHN = " + ".join(f"(CASE WHEN {2 - i % 2} * CAST(substr(p, {i + 1}, 1) AS INT) > 9 THEN {2 - i % 2} * CAST(substr(p, {i + 1}, 1) AS INT) - 9 ELSE {2 - i % 2} * CAST(substr(p, {i + 1}, 1) AS INT) END)" for i in range(16))


@query(f"SELECT c_custkey, ({_LUHN}) % 10 = 0 AS valid FROM (SELECT c_custkey, {_sql(_PAN)} AS p FROM customer) AS t")
def check_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", checks.pan_is_plausible(F.expr(_PAN)).alias("valid"))


@query(f"SELECT c_custkey, CASE WHEN ({_LUHN}) % 10 = 0 THEN {token('PAN', 'substr(p, 1, 12)')} || substr(p, 13, 4) ELSE p END AS masked FROM (SELECT c_custkey, {_sql(_PAN)} AS p FROM customer) AS t")
def mask_pan_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PAN).alias("p"))
    return mask.mask_text(rows, OPTIONS, "p", tags=["PAN"]).select("c_custkey", F.col("p").alias("masked"))


_UNP = "lpad(CAST((c_custkey * 104729) % 1000000000 AS STRING), 9, '0')"
_UNP_SUM = " + ".join(f"{w} * CAST(substr(p, {i + 1}, 1) AS INT)" for i, w in enumerate((29, 23, 19, 17, 13, 7, 5, 3)))


@query(f"SELECT c_custkey, ({_UNP_SUM}) % 11 = CAST(substr(p, 9, 1) AS INT) AS valid FROM (SELECT c_custkey, {_sql(_UNP)} AS p FROM customer) AS t")
def check_unp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", checks.unp_is_valid(F.expr(_UNP)).alias("valid"))


_IBAN = "'BY' || lpad(CAST(c_custkey % 97 AS STRING), 2, '0') || 'AKBB' || lpad(CAST(c_custkey AS STRING), 20, '0')"


@query(f"SELECT c_custkey, CAST('10201111' || substr(p, 9, 20) || '1134' || substr(p, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM (SELECT c_custkey, {_sql(_IBAN)} AS p FROM customer) AS t")
def check_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", checks.iban_is_valid(F.expr(_IBAN)).alias("valid"))


_IPV4 = "c_custkey % 300 || '.' || c_custkey % 7 || '.0' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '5' END || '.1'"


@query(f"SELECT c_custkey, c_custkey % 300 < 256 AND c_custkey % 2 = 0 AS valid FROM customer WHERE {_sql(_IPV4)} IS NOT NULL")
def check_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", checks.is_ip(F.expr(_IPV4)).alias("valid"))


_VALUES = "CASE c_custkey % 8 WHEN 0 THEN '10.0.0.' || c_custkey % 256 WHEN 1 THEN 'u' || c_custkey || '@bank.com' WHEN 2 THEN 'h' || c_custkey || '.bank.local' WHEN 3 THEN 'S-1-5-21-' || c_custkey WHEN 4 THEN 'md5' || c_custkey WHEN 5 THEN 'https://x.com/' || c_custkey WHEN 6 THEN '10.0.0.' || c_custkey % 256 || '/24' ELSE '00:1A:2B:3C:4D:' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') END"
_CLASSES = ["IP", "EMAIL", "FQDN", "SID", "VALUE", "URL", "IP_NET", "MAC"]


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_CLASSES)) + " END AS tag FROM customer")
def classify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", classified(F.expr(_VALUES), OPTIONS).alias("tag"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'CUSTOM:TEAM' ELSE 'USER' END AS tag FROM customer WHERE length({token('USER', 'c_name')}) > 0")
def pseudonym_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("c_custkey") % 2 == 0, "CUSTOM:TEAM").otherwise("USER")
    return table(spark, sf_dir, "customer").select("c_custkey", pseudonym_type(pseudonym(F.col("c_name"), tag, KEY)).alias("tag"))


# ---- findings ----
_FOUND_TAGS = ["EMAIL", "MAC", "SID", "FQDN", "HASH", "USER_PATH"]
_FOUND = {"EMAIL": ("mail", "true"), "MAC": ("mac", "true"), "SID": ("sid", "user_id % 5 <> 0"), "HASH": ("hash", "user_id % 2 = 0"), "USER_PATH": ("path", "true")}
_FOUND_SQL = " UNION ALL ".join([f"SELECT '{t}' AS tag FROM events WHERE {w}" for t, (_, w) in _FOUND.items()] + ["SELECT 'FQDN' AS tag FROM events", "SELECT 'FQDN' AS tag FROM events"])
_FOUND_KINDS = ["mail", "mac", "sid", "hash", "path", "host", "none"]


@query(f'SELECT tag, count(*) AS "count" FROM ({_FOUND_SQL}) AS f GROUP BY tag')
def findings_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by(detect.findings(log_lines(spark, sf_dir, *_FOUND_KINDS), OPTIONS, "line", _FOUND_TAGS), "tag")


@query(f"""SELECT CASE WHEN tag = 'USER_PATH' THEN 'USER' ELSE tag END AS family, count(*) AS "count" FROM ({_FOUND_SQL}) AS f GROUP BY 1""")
def findings_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by(detect.findings(log_lines(spark, sf_dir, *_FOUND_KINDS), OPTIONS, "line", _FOUND_TAGS), "family")


@query("SELECT event_id, 'EMAIL' AS tag, 'u' || user_id || '@bank.com' AS value, 8 AS start, CAST(8 + length('u' || user_id || '@bank.com') AS INT) AS \"end\", 1 AS line_no, 'contact u' || user_id || '@bank.com' AS snippet FROM events")
def findings_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.findings(log_lines(spark, sf_dir, "mail").withColumnRenamed("line", "text"), OPTIONS, "text", ["EMAIL", "FQDN"], non_overlapping=True)
    return detect.with_snippet(found).select("event_id", "tag", "value", "start", "end", F.col("line").alias("line_no"), "snippet")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL_RE2}')) AS n FROM documents WHERE len(regexp_extract_all(text, '{_EMAIL_RE2}')) > 0")
def findings_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.findings(table(spark, sf_dir, "documents").select("doc_id", "text"), OPTIONS, tags=["EMAIL"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'u' || user_id || '@bank.com' AS value FROM events WHERE user_id % 10 <> 3")
def findings_without_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.findings(log_lines(spark, sf_dir, "mail"), OPTIONS, "line", ["EMAIL"])
    allowed = table(spark, sf_dir, "events").where("user_id % 10 = 3").select(F.expr("' U' || user_id || '@BANK.com '").alias("value"))
    return detect.without_allowed(found.select("event_id", "value"), allowed)


_RISK = {"kv": 8, "sshd": 8, "sudo": 0, "path": 0, "sid": 0, "mac": 0, "mail": 12, "cef": 8}


@query("SELECT kind, CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RISK.items()) + f" END AS risk, count(*) AS n FROM ({lines_sql('kind', None, *_RISK)}) AS l GROUP BY 1, 2")
def residual_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_lines(spark, sf_dir, *_RISK).withColumn("risk", detect.risk(detect.residual(F.col("line"), OPTIONS)))
    return rows.groupBy("kind", "risk").agg(F.count(F.lit(1)).alias("n"))


_LEFT = {"kv": "IP; RESIDUAL: IP", "mail": "EMAIL; FQDN; RESIDUAL: EMAIL", "mac": "MAC", "org": "ORG", "none": "", "host": "FQDN"}


@query("SELECT kind, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEFT.items()) + f" END AS issues, kind = 'none' AS safe, count(*) AS n FROM ({lines_sql('kind', None, *_LEFT)}) AS l GROUP BY 1, 2, 3")
def verify_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = detect.verify(log_lines(spark, sf_dir, *_LEFT), OPTIONS, "line")
    return judged.groupBy("kind", F.array_join("issues", "; ").alias("issues"), "safe").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, count(*) AS n FROM ({lines_sql('kind')}) AS l GROUP BY kind")
def gate_masked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All masked lines pass the gate."""
    safe, _ = reports.gate(mask.mask_text(log_lines(spark, sf_dir), OPTIONS, "line"), OPTIONS, "line")
    return safe.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- dictionary ----
_MAPPED = list(REPLACED)
_MAPPING_SQL = f"SELECT DISTINCT tag, original, lower(original) AS normalized, {token('@', 'lower(original)').replace("'[@_'", "'[' || tag || '_'")} AS pseudonym FROM ({replaced_sql('tag, original', _MAPPED)}) AS d"


def _mapped(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    tags = [t for k in kinds or _MAPPED for t in TAGS[k]]
    masked = mask.mask_text(log_lines(spark, sf_dir, *(kinds or _MAPPED)), OPTIONS, "line", replacements="found", tags=tags)
    return mapping.replacements(masked, "found", ["event_id", "kind"])


@query(_MAPPING_SQL)
def mapping_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.build(_mapped(spark, sf_dir), ["event_id", "kind"])


_SHORT = replace(KEY, hash_len=4)
_COLLIDED = f"SELECT 'USER' AS tag, c_name AS original, lower(c_name) AS normalized, '[USER_' || h || CASE WHEN k > 1 THEN '_' || k ELSE '' END || ']' AS pseudonym FROM (SELECT c_name, h, row_number() OVER (PARTITION BY h ORDER BY lower(c_name)) AS k FROM (SELECT c_name, {hashed('lower(c_name)', _SHORT)} AS h FROM customer) AS a) AS b"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.lit("USER").alias("tag"), name.alias("original"), F.lower(name).alias("normalized"), pseudonym(name, "USER", _SHORT).alias("base"))


@query(_COLLIDED)
def mapping_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.resolved(_customers(spark, sf_dir).drop("c_custkey"))


@query(_COLLIDED)
def mapping_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three workers' dictionaries merged."""
    rows = _customers(spark, sf_dir)
    return mapping.merge([mapping.resolved(rows.where(F.col("c_custkey") % 3 == k).drop("c_custkey")) for k in range(3)])


@query(f"SELECT c_custkey % 3 AS worker, count(*) AS n FROM (SELECT c_custkey, original, m.pseudonym AS new, '[USER_' || h || CASE WHEN k > 1 THEN '_' || k ELSE '' END || ']' AS old FROM (SELECT c_custkey, c_name, h, row_number() OVER (PARTITION BY c_custkey % 3, h ORDER BY lower(c_name)) AS k FROM (SELECT c_custkey, c_name, {hashed('lower(c_name)', _SHORT)} AS h FROM customer) AS a) AS w JOIN ({_COLLIDED}) AS m ON m.original = w.c_name) AS x WHERE old <> new GROUP BY 1")
def mapping_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pseudonyms of each worker the merge changes."""
    rows = _customers(spark, sf_dir)
    own = [mapping.resolved(rows.where(F.col("c_custkey") % 3 == k).drop("c_custkey")) for k in range(3)]
    merged = mapping.merge(own)
    parts = [mapping.rewrites(m, merged).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).cast("long").alias("worker"), "n") for k, m in enumerate(own)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n > 0")


@query(f"SELECT pseudonym, 'USER' AS prefix, substr(pseudonym, 7, 4) AS hash, CASE WHEN length(pseudonym) > 11 THEN CAST(substr(pseudonym, 12, length(pseudonym) - 12) AS INT) ELSE 1 END AS suffix FROM ({_COLLIDED}) AS m")
def mapping_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_collisions(spark, sf_dir).select("pseudonym", mapping.parse(F.col("pseudonym")).alias("p")).select("pseudonym", "p.*")


@query("SELECT c_name AS original FROM customer WHERE c_name LIKE '%7%'")
def mapping_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.search(mapping.resolved(_customers(spark, sf_dir).drop("c_custkey")).withColumn("pseudonym", F.lit("")), "7", "USER").select("original")


_SECRET = "SELECT c_custkey, c_name AS original, true AS hidden FROM customer"


@query(_SECRET)
def mapping_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals come back with the right passphrase and with no other."""
    rows = _customers(spark, sf_dir).withColumn("pseudonym", F.col("base"))
    sealed = mapping.protect(rows, "pass", "salt")
    wrong = mapping.unprotect(sealed, "other", "salt").select("c_custkey", F.col("original").isNull().alias("hidden"))
    return mapping.unprotect(sealed, "pass", "salt").select("c_custkey", "original").join(wrong, "c_custkey")


_ROUND = ["kv", "sshd", "mail", "none"]


@query(lines_sql("event_id, kind, line", None, *_ROUND))
def reidentify_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked lines with their originals put back."""
    tags = [t for k in _ROUND for t in TAGS[k]]
    # the dictionary and both sides of the join read the masked lines
    masked = written(mask.mask_text(log_lines(spark, sf_dir, *_ROUND), OPTIONS, "line", replacements="found", tags=tags), "masked")
    known = mapping.build(mapping.replacements(masked, "found"))
    return mapping.reidentify(masked.select("event_id", "kind", "line"), known, "line", "event_id")


_SKEWED = "CASE WHEN event_id % 2 = 0 THEN 'contact root@bank.com' ELSE 'contact u' || event_id || '@bank.com' END"


@query(f"SELECT event_id, {_SKEWED} AS line FROM events")
def reidentify_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which half hold one value, with their originals put back."""
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_SKEWED).alias("line"))
    masked = written(mask.mask_text(lines, OPTIONS, "line", replacements="found", tags=["EMAIL"]), "masked")
    known = mapping.build(mapping.replacements(masked, "found"))
    return mapping.reidentify(masked.select("event_id", "line"), known, "line", "event_id")


@query("SELECT min(c_name) AS name FROM (SELECT c_name, substr(c_name, 1, 14) AS g FROM customer) AS t GROUP BY lower(g)")
def first_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.substring("c_name", 1, 14).alias("g"), F.col("c_name"))
    return mapping.first_spellings(rows.withColumnRenamed("c_name", "o"), "g", "o").select(F.col("o").alias("name"))


# ---- counts and reports ----
@query(f'SELECT kind, tag, count(*) AS "count" FROM ({replaced_sql("kind, tag", _MAPPED)}) AS r GROUP BY kind, tag')
def stats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by(_mapped(spark, sf_dir), "kind", "tag")


@query(f"SELECT count(*) AS replacement_occurrences, count(DISTINCT tag || ' ' || lower(original)) AS unique_values FROM ({replaced_sql('tag, original', _MAPPED)}) AS r")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(_mapped(spark, sf_dir))


@query(f"""SELECT path, sum(strlen(line) + 1) AS size_bytes, count(*) AS line_count, count(*) AS changed_lines, count(*) AS replacements, count(DISTINCT user_id) AS unique_values, 'EMAIL=' || count(*) AS stats, true AS safe FROM (SELECT 'f' || event_id % 7 AS path, user_id, line FROM ({lines_sql("event_id, user_id, line", None, "mail")}) AS l) AS t GROUP BY path""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir, "mail").withColumn("path", F.expr("'f' || event_id % 7"))
    found = reports.scan_files(lines, OPTIONS)
    stats = F.array_join(F.transform(F.map_entries("stats_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("path", "size_bytes", "line_count", "changed_lines", "replacements", "unique_values", stats.alias("stats"), "safe")


@query("SELECT count(*) AS tp, 0 AS fn, 0 AS fp, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS precision_proxy FROM events")
def corpus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines labelled with what must go (the address) and what must stay."""
    rows = log_lines(spark, sf_dir, "mail").select("event_id", F.col("line").alias("input"), F.array(F.lit("contact")).alias("must_keep"), F.array(F.expr("'u' || user_id || '@bank.com'")).alias("must_not_contain"))
    return reports.score_corpus(rows, OPTIONS)


@query("SELECT event_id, 'EMAIL' AS found, false AS safe, 12 AS risk FROM events")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.quality(log_lines(spark, sf_dir, "mail"), OPTIONS, "line")
    return rows.select("event_id", F.get("quality.found", F.lit(0))["tag"].alias("found"), "quality.safe", F.col("quality.residual_risk").alias("risk"))


# ---- records ----
@query("SELECT event_id, '<34>1 2026-01-01T00:00:00Z ' AS pri, 'h' || user_id % 50 || '.bank.local' AS host, ' app - - - ok' AS rest FROM events")
def rfc5424_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir, "host").select("event_id", records.rfc5424(F.col("line")).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, '' AS prefix, 'CEF:0|V|P|1|100|N|5' AS head, 'src=10.0.0.1 suser=u' || user_id AS ext FROM events")
def cef_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir, "cef").select("event_id", records.cef(F.col("line")).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, 'x ' AS prefix, 'LEEF:2.0|V|P|1|' || event_type AS head, 'usr=u' || user_id AS ext FROM events")
def leef_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("'x LEEF:2.0|V|P|1|' || event_type || '|usr=u' || user_id")
    return table(spark, sf_dir, "events").select("event_id", records.leef(line).alias("r")).select("event_id", "r.*")


@query("SELECT 'p' || event_id % 50 AS path, event_id * 3 AS line_no, 'err ' || event_id || ' at f more' AS line FROM events")
def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = F.array(F.struct((F.col("event_id") * 3).alias("n"), F.expr("'err ' || event_id").alias("t")), F.struct((F.col("event_id") * 3 + 1).alias("n"), F.lit("  at f\\").alias("t")), F.struct((F.col("event_id") * 3 + 2).alias("n"), F.lit("more").alias("t")))
    lines = events.select(F.expr("'p' || event_id % 50").alias("path"), F.explode(rows).alias("r")).select("path", F.col("r.n").alias("line_no"), F.col("r.t").alias("line"))
    return records.join_continued(lines)


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, l AS line FROM (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS i FROM documents) AS t")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'json' WHEN event_id % 4 = 1 THEN 'ndjson' WHEN event_id % 4 = 2 THEN 'text' ELSE 'empty' END AS kind FROM events")
def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"a": ' || event_id || '}' WHEN 1 THEN '{"a": 1}\n{"b": ' || event_id || '}' WHEN 2 THEN 'plain {' || event_id ELSE ' ' END""")
    return table(spark, sf_dir, "events").select("event_id", records.doc_kind(text).alias("kind"))


_DOCUMENT = """'{"user":"u' || user_id || '","src":{"ip":"10.0.0.' || event_id % 250 || '"},"n":' || event_id || '}'"""


@query("SELECT event_id, '$.user' AS path, 'user' AS key, 'u' || user_id AS leaf FROM events UNION ALL SELECT event_id, '$.src.ip', 'ip', '10.0.0.' || event_id % 250 FROM events UNION ALL SELECT event_id, '$.n', 'n', CAST(event_id AS VARCHAR) FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsondocs.flatten(table(spark, sf_dir, "events").select("event_id", F.expr(_DOCUMENT).alias("doc")), "doc", "event_id")


@query("SELECT event_id, path, CASE WHEN path = '$.user' THEN 'USER' WHEN path = '$.src.ip' THEN 'IP' END AS hint FROM (SELECT event_id, unnest(['$.user', '$.src.ip', '$.n']) AS path FROM events) AS t")
def json_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsondocs.with_hints(json_flatten(spark, sf_dir), OPTIONS).select("event_id", "path", "hint")


_JSON_MASKED = f"""'{{"user": "' || {token('USER', "'u' || user_id")} || '", "src": {{"ip": "' || {token('IP', "'10.0.0.' || event_id % 250")} || '"}}, "n": ' || event_id || '}}'"""


@query(f"SELECT event_id, {_JSON_MASKED} AS doc FROM events")
def json_mask_schemaless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_DOCUMENT).alias("doc"))
    return jsondocs.mask_schemaless(rows, OPTIONS, "doc", "event_id")


@query(f"SELECT event_id, {token('USER', "'u' || user_id")} AS user_name, {token('IP', "'10.0.0.' || event_id % 250")} AS ip, 'mail ' || {token('EMAIL', "'u' || user_id || '@bank.com'")} AS first_note, event_id AS n FROM events")
def json_mask_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.expr("'u' || user_id")
    doc = F.struct(F.struct(F.struct(user.alias("name")).alias("account")).alias("subject"), F.struct(F.expr("'10.0.0.' || event_id % 250").alias("ip")).alias("src"), F.array(F.struct(F.concat(F.lit("mail "), user, F.lit("@bank.com")).alias("note"))).alias("notes"), F.col("event_id").alias("n"))
    masked = jsondocs.mask_typed(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), OPTIONS, ["doc"])
    return masked.select("event_id", F.col("doc.subject.account.name").alias("user_name"), F.col("doc.src.ip").alias("ip"), F.col("doc.notes")[0]["note"].alias("first_note"), F.col("doc.n").alias("n"))


@query("SELECT c_custkey, replace(replace(replace(lower(k), '_', ''), '-', ''), '.', '') AS key, lower(regexp_replace('$.' || k || '[0]/b', '[^0-9A-Za-z]+', '', 'g')) AS path FROM (SELECT c_custkey, c_name || '.Src_IP-' || c_custkey AS k FROM customer) AS t")
def json_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("c_name || '.Src_IP-' || c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", records.key_name(k).alias("key"), records.path_name(F.concat(F.lit("$."), k, F.lit("[0]/b"))).alias("path"))


# ---- before and after ----
@query(f"SELECT kind, count(*) AS n FROM ({lines_sql('kind', None, 'mail', 'mac')}) AS l GROUP BY kind")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines by kind; lines without a value do not change."""
    lines = log_lines(spark, sf_dir, "mail", "mac", "none").withColumnRenamed("kind", "path").withColumnRenamed("event_id", "line_no")
    after = mask.mask_text(lines, OPTIONS, "line", tags=["EMAIL", "MAC"])
    return diff.changed_lines(lines, after).groupBy(F.col("path").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'p' || event_id % 50 AS path, event_id AS line_no, op, CASE op WHEN '+' THEN 'contact ' || {token('EMAIL', "'u' || user_id || '@bank.com'")} ELSE 'contact u' || user_id || '@bank.com' END AS text FROM (SELECT *, unnest(['-', '+']) AS op FROM events) AS e")
def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir, "mail").select(F.expr("'p' || event_id % 50").alias("path"), F.col("event_id").alias("line_no"), "line")
    return diff.diff_rows(lines, mask.mask_text(lines, OPTIONS, "line", tags=["EMAIL"]))


@query("SELECT event_id, 31 AS start, CAST(31 + length('u' || user_id) AS INT) AS \"end\", 'u' || user_id AS value, 'USER' AS tag FROM events")
def value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir, "sshd")
    values = lines.select(F.expr("'u' || user_id").alias("value"), F.lit("USER").alias("tag")).distinct()
    return diff.value_spans(lines, values, "line", "event_id")


@query("""SELECT doc_id, CAST(s AS INT) AS start, CAST(s + length(lang) AS INT) AS "end", lang AS value, upper(lang) AS tag FROM (
SELECT doc_id, lang, text, sum(length(part) + length(lang)) OVER (PARTITION BY doc_id, lang ORDER BY i) - length(lang) AS s, i < n AS ends FROM (
SELECT doc_id, lang, text, unnest(string_split(text, lang)) AS part, generate_subscripts(string_split(text, lang), 1) AS i, len(string_split(text, lang)) AS n FROM (SELECT doc_id, text FROM documents) AS d, (SELECT DISTINCT lang AS lang FROM documents WHERE lang IS NOT NULL) AS l (lang)) AS b) AS c
WHERE ends AND NOT regexp_matches(substr(text, CAST(s AS BIGINT), 1), '^[\\p{L}\\p{M}\\p{N}_]$') AND NOT regexp_matches(substr(text, CAST(s + length(lang) + 1 AS BIGINT), 1), '^[\\p{L}\\p{M}\\p{N}_]$')""")
def value_spans_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the codes of the corpus's languages stand as words in its texts (whole texts, few and frequent values)."""
    docs = table(spark, sf_dir, "documents")
    return diff.value_spans(docs, docs.select(F.col("lang").alias("value"), F.upper("lang").alias("tag")).distinct())


_SPAN_ROWS = "SELECT l_orderkey, CAST(l_linenumber * 7 - l_quantity % 5 AS INT) AS s, CAST(l_linenumber * 7 + l_quantity % 9 AS INT) AS e FROM lineitem"
_ISLANDS = f"SELECT l_orderkey, min(s) AS start, max(e) AS \"end\" FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM ({_SPAN_ROWS}) AS a) AS b) AS c GROUP BY l_orderkey, g"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("CAST(l_linenumber * 7 - l_quantity % 5 AS INT)").alias("start"), F.expr("CAST(l_linenumber * 7 + l_quantity % 9 AS INT)").alias("end"))


@query(_ISLANDS)
def merge_span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.merge_span_rows(_spans(spark, sf_dir), "l_orderkey", 1)


@query(_ISLANDS)
def merge_span_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return rows.select("l_orderkey", F.explode(diff.merge_spans(F.col("s"), 1)).alias("m")).select("l_orderkey", "m.start", "m.end")


# ---- streams ----
def _stream_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select("event_id", "user_id", F.expr(LINES[kind]).alias("line"))


def _written(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows of a stream, by way of files in the shared checkpoint folder."""
    folder = checkpoint_folder(spark, "stream")
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The result of a stream of few rows, such as totals, by way of the driver."""
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


@query('SELECT \'EMAIL\' AS tag, count(*) AS "count" FROM events')
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = streams.count_stream(_stream_lines(spark, sf_dir, "mail"), OPTIONS)
    return _drained(spark, counted, "logveil_stream_counts", "complete")


@query(lines_sql("event_id, line", MASKED, "sudo"))
def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = streams.mask_stream(_stream_lines(spark, sf_dir, "sudo"), OPTIONS).select("event_id", "line")
    return _written(spark, masked)


_PIECES = """SELECT 'p' || event_id % 20 AS path, count(*) AS n, count(*) FILTER (WHERE kind = 'json') AS json FROM (SELECT event_id, unnest(['json', 'text']) AS kind FROM events) AS t GROUP BY 1"""


@query(_PIECES)
def json_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over three lines between lines of text, put together again."""
    parts = F.array(*(F.struct((F.col("event_id") * 4 + k).alias("n"), F.expr(t).alias("t")) for k, t in enumerate(("'{\"a\":'", "event_id || ','", "'\"b\": 2}'", "'text ' || event_id"))))
    fixed = F.transform(parts, lambda p: F.struct(p["n"].alias("n"), F.when(p["n"] % 4 == 1, F.expr("event_id || ', '")).otherwise(p["t"]).alias("t")))
    lines = table(spark, sf_dir, "events").select(F.expr("'p' || event_id % 20").alias("path"), F.explode(fixed).alias("r")).select("path", F.col("r.n").alias("line_no"), F.col("r.t").alias("line"))
    return streams.assemble(lines).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "json").alias("json"))


