"""Registered queries of single rules, leftovers, files, jobs and streams, beside those of `queries`.

Lines are put together from pieces, some of them sensitive; SQL writes the masked line down from the
same pieces.
"""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.functions import sqlfuncs
from logveil.operators import detect, diff, jobs, jsondocs, mapping, mask, records, reports
from logveil.plans.options import ContextRule, CustomRule, Options
from logveil.queries import KEY, LINES, MASKED, OPTIONS, _sql, checkpoint_folder, hashed, lines_sql, log_lines, query, table, token
from logveil.sources import files, sinks
from logveil.sources.shared import spread, written
from logveil.streaming import streams


class Value(NamedTuple):
    """A sensitive piece of a line: its tag, its SQL, when it counts as one, and whether case matters."""

    tag: str
    sql: str
    when: str = "true"
    cased: bool = False


Piece = str | Value
_U, _E = "CAST(user_id AS STRING)", "CAST(event_id AS STRING)"
_M = f"md5({_U})"
_BACK = "chr(92)"
# check digits of an account: the number's remainder of 97 by parts
_IBAN_C, _IBAN_M = (10201111 * 10**26 + 113400) % 97, 10**6 % 97
_KK = f"(98 - ({_IBAN_C} + user_id * {_IBAN_M}) % 97)"
_KK_OR_WRONG = f"lpad(CAST(CASE WHEN user_id % 3 = 0 THEN 1 + {_KK} % 97 ELSE {_KK} END AS STRING), 2, '0')"
_UNP8 = "lpad(CAST(user_id * 104729 % 100000000 AS STRING), 8, '0')"
_UNP_SUM = "((" + " + ".join(f"{w} * CAST(substr({_UNP8}, {i + 1}, 1) AS INT)" for i, w in enumerate((29, 23, 19, 17, 13, 7, 5, 3))) + ") % 11)"
_UNP9 = f"{_UNP8} || CAST(CASE WHEN user_id % 3 = 0 THEN ({_UNP_SUM} + 1) % 10 ELSE {_UNP_SUM} % 10 END AS STRING)"
_BYID = f"lpad({_U}, 7, '3') || 'A001PB5'"
_PAN15 = "'4' || lpad(CAST(user_id * 7919 AS STRING), 14, '0')"
_DIGIT = "CAST(substr({p}, {i}, 1) AS INT)"
_LUHN = " + ".join(_DIGIT.format(p=f"({_PAN15})", i=i) if i % 2 == 0 else f"(2 * {_DIGIT.format(p=f'({_PAN15})', i=i)} - CASE WHEN {_DIGIT.format(p=f'({_PAN15})', i=i)} > 4 THEN 9 ELSE 0 END)" for i in range(1, 16))
_PAN16 = f"{_PAN15} || CAST((10 - ({_LUHN}) % 10) % 10 AS STRING)"

#: Kinds of lines: the rules that see them, and their pieces.
KINDS: dict[str, tuple[list[str], list[Piece]]] = {
    "jwt": (["JWT"], ["'auth '", Value("JWT", f"'eyJ' || substr({_M}, 1, 10) || '.' || substr(md5({_E}), 1, 12) || '.s' || {_U}")]),
    "token": (["TOKEN"], ["'push '", Value("TOKEN", f"'ghp_' || {_M}"), "' now'"]),
    "cloud_secret": (["CLOUD_SECRET"], ["'env '", Value("CLOUD_SECRET", f"'AWS_SECRET_ACCESS_KEY=' || {_M}"), "' set'"]),
    "ssh_key": (["SSH_KEY"], ["'key '", Value("SSH_KEY", f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {_M} || chr(10) || '-----END RSA PRIVATE KEY-----'"), "' end'"]),
    "connection": (["CONN_STR"], ["'db '", Value("CONN_STR", f"CASE WHEN user_id % 2 = 0 THEN 'postgres://u' || {_U} || ':pw@db.local/app' ELSE 'Server=h' || {_U} || ';Database=app;Uid=u1' END"), "' up'"]),
    "command": (["BASE64_CMD"], ["'powershell -enc '", Value("B64_CMD", f"upper({_M}) || '=='", cased=True)]),
    "secret": (["SECRET"], ["'password=\"'", Value("SECRET", f"'Pw ' || {_U}", cased=True), "'\" done'"]),
    "su_from": (["AUTH_USER_SU_FROM"], ["chr(39) || 'su root' || chr(39) || ' failed for '", Value("USER", f"'u' || {_U}"), "' on /dev/pts/1'"]),
    "cisco": (["AUTH_USER_CISCO"], ["'Configured from console by '", Value("USER", f"'u' || {_U}"), "' on vty0'"]),
    "windows": (["AUTH_USER_WIN"], ["'Account Name: '", Value("USER", f"'CORP' || {_BACK} || 'u' || {_U}"), "' ok'"]),
    "uuid": (["UUID"], ["'job '", Value("UUID", f"CASE WHEN user_id % 7 = 0 THEN '00000000-0000-0000-0000-000000000000' ELSE substr({_M}, 1, 8) || '-' || substr({_M}, 9, 4) || '-' || substr({_M}, 13, 4) || '-' || substr({_M}, 17, 4) || '-' || substr({_M}, 21, 12) END", "user_id % 7 <> 0")]),
    "iban": (["IBAN"], ["'pay '", f"'BY' || {_KK_OR_WRONG}", Value("IBAN", f"'AKBB' || lpad({_U}, 20, '0')", "user_id % 3 <> 0"), "' today'"]),
    "unp": (["UNP"], ["'unp '", Value("UNP", _UNP9, f"user_id % 3 <> 0 AND {_UNP_SUM} < 10"), "' ok'"]),
    "personal_id": (["BY_ID"], ["'id '", f"substr({_BYID}, 1, 2)", Value("BY_ID", f"substr({_BYID}, 3, 10)"), f"substr({_BYID}, 13, 2)", "' ok'"]),
    "login": (["USER"], ["'logon '", Value("USER", f"CASE WHEN user_id % 4 = 0 THEN 'windows' ELSE 'CORP' END || {_BACK} || 'u' || {_U}", "user_id % 4 <> 0"), "' ok'"]),
    "phone": (["PHONE"], ["'call '", "'+3'", Value("PHONE", f"'7529' || lpad(CAST(user_id % 100000 AS STRING), 5, '0')"), "'17'", "' back'"]),
    "pan": (["PAN"], ["'card '", Value("PAN", f"substr({_PAN16}, 1, 12)"), f"substr({_PAN16}, 13, 4)", "' ok'"]),
    "address_number": (["IP", "PHONE"], ["'from '", Value("IP", f"'10.' || user_id % 256 || '.' || event_id % 256 || '.' || event_id % 255"), "' ok'"]),
    "url": (["URL"], ["'see '", Value("URL", f"'https://x.com/' || {_U} || '?q=' || {_E}"), "' ok'"]),
    "ipv6": (["IP"], ["'from '", Value("IP", f"'fe80::' || lower(lpad(hex(user_id % 60000), 4, '0')) || ':1'"), "' ok'"]),
}


def raw(pieces: list[Piece]) -> str:
    return " || ".join(p if isinstance(p, str) else f"({p.sql})" for p in pieces)


def masked_sql(pieces: list[Piece]) -> str:
    def one(v: Value) -> str:
        value = _sql(v.sql)
        name = token(v.tag, value if v.cased else f"lower({value})")
        return name if v.when == "true" else f"CASE WHEN {_sql(v.when)} THEN {name} ELSE {value} END"

    return " || ".join(_sql(p) if isinstance(p, str) else f"({one(p)})" for p in pieces)


def rule_lines(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(event_id, user_id, kind, line) of the kinds above."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(raw(KINDS[k][1])).alias("line")) for k in kinds))
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return events.select("event_id", "user_id", F.explode(rows).alias("l")).select("event_id", "user_id", "l.kind", "l.line")


def _every(columns: str, kinds: list[str], form) -> str:
    rows = " UNION ALL ".join(f"SELECT event_id, user_id, '{k}' AS kind, {form(k)} AS line FROM events" for k in kinds)
    return f"SELECT {columns} FROM ({rows}) AS lines"


def _register_rule(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mask.mask_text(rule_lines(spark, sf_dir, kind), OPTIONS, "line", tags=KINDS[kind][0]).select("event_id", F.col("line").alias("masked"))

    run.__name__, run.__doc__ = f"rule_{kind}", f"Lines of kind {kind} masked by their rules."
    query(f"SELECT event_id, {masked_sql(KINDS[kind][1])} AS masked FROM events")(run)


for _kind in KINDS:
    _register_rule(_kind)

#: Kinds of which no rule but their own matches a part (the account in front of a failed su is one of another rule).
_ALONE = ["jwt", "token", "cloud_secret", "ssh_key", "command", "secret", "cisco", "windows", "uuid", "iban", "unp", "personal_id", "login", "phone", "url", "ipv6", "address_number"]


@query(_every("event_id, kind, line AS masked", _ALONE, lambda k: masked_sql(KINDS[k][1])))
def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds above under the whole chain of rules."""
    return mask.mask_text(rule_lines(spark, sf_dir, *_ALONE), OPTIONS, "line").select("event_id", "kind", F.col("line").alias("masked"))


_RESTORED = ["jwt", "iban", "personal_id", "phone", "address_number", "login"]


@query(_every("event_id, kind, line", _RESTORED, lambda k: _sql(raw(KINDS[k][1]))))
def rule_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked lines, full and partial, with their originals put back; case is that of the first spelling."""
    tags = sorted({t for k in _RESTORED for t in KINDS[k][0]})
    # written, as the dictionary, the pseudonyms and the texts would else mask every line for themselves
    masked = written(mask.mask_text(rule_lines(spark, sf_dir, *_RESTORED), OPTIONS, "line", replacements="found", tags=tags).select("event_id", "kind", "line", "found"), "masked")
    known = mapping.build(mapping.replacements(masked, "found"))
    return mapping.reidentify(masked.select("event_id", "kind", "line"), known, "line", "event_id")


# ---- rules of the user's own ----
_CUSTOM = replace(
    OPTIONS,
    custom_rules=(
        CustomRule("ticket", r"TCK-\d+", priority=2),
        CustomRule("", r"REF#\d+", type="ref", strategy="format"),
        CustomRule("acct", r"AC\d{8}", strategy="partial"),
        CustomRule("off", r"STAYS", enabled=False),
    ),
)
_ACCT = f"'AC' || lpad({_U}, 8, '0')"
_CUSTOM_LINE = f"'TCK-' || {_U} || ' REF#' || lpad({_U}, 5, '0') || ' ' || {_ACCT} || ' STAYS'"


@query(f"SELECT event_id, {token('CUSTOM:TICKET', _sql(f"'tck-' || {_U}"))} || ' XXX#99999 AC' || {token('CUSTOM:ACCT', _sql(f"substr({_ACCT}, 3, 6)"))} || substr({_sql(_ACCT)}, 9, 2) || ' STAYS' AS masked FROM events")
def rule_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rules by full, format and partial masks, one without a name and one that is off."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_CUSTOM_LINE).alias("line"))
    tags = [r.tag for r in _CUSTOM.custom_rules]
    return mask.mask_text(rows, _CUSTOM, "line", tags=tags).select("event_id", F.col("line").alias("masked"))


@query(f"SELECT event_id, CASE WHEN user_id % 10 = 3 THEN line ELSE 'contact ' || {token('EMAIL', "'u' || user_id || '@bank.com'")} END AS masked FROM ({lines_sql('event_id, user_id, line', None, 'mail')}) AS l")
def mask_with_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed values stay, as many as there are; case and blanks around them do not count."""
    allowed = table(spark, sf_dir, "events").where("user_id % 10 = 3").select(F.expr("' U' || user_id || '@Bank.com '").alias("value"))
    masked = mask.mask_text_allowing(log_lines(spark, sf_dir, "mail"), OPTIONS, allowed, "line", tags=["EMAIL"])
    return masked.select("event_id", F.col("line").alias("masked"))


# ---- leftovers ----
_LEFT = {"jwt": ("JWT", "true"), "login": ("USER", "user_id % 4 <> 0"), "phone": ("PHONE", "true"), "unp": ("UNP", KINDS["unp"][1][1].when), "personal_id": ("BY_ID", "true"), "iban": ("IBAN", "user_id % 3 <> 0"), "pan": ("PAN", "true")}


@query("SELECT kind, found, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, CASE WHEN {_sql(when)} THEN '{tag}' ELSE '' END AS found FROM events" for k, (tag, when) in _LEFT.items()) + ") AS t GROUP BY 1, 2")
def residual_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each residual rule finds in raw lines."""
    found = rule_lines(spark, sf_dir, *_LEFT).withColumn("found", F.array_join(F.transform(detect.residual(F.col("line"), OPTIONS), lambda f: f["kind"]), ","))
    return found.groupBy("kind", "found").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, true AS safe, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind FROM events" for k in ("jwt", "personal_id", "address_number", "unp")) + ") AS t GROUP BY 1, 2")
def residual_of_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked lines hold nothing sensitive: pseudonyms of digits are no findings (invalid numbers are none either)."""
    masked = mask.mask_text(rule_lines(spark, sf_dir, "jwt", "personal_id", "address_number", "unp"), OPTIONS, "line")
    return detect.verify(masked, OPTIONS, "line").groupBy("kind", "safe").agg(F.count(F.lit(1)).alias("n"))


# ---- JSON of any shape ----
_NDJSON = f"""'{{"user":"u' || {_U} || '","n":1.50}}' || chr(10) || '{{"src.ip":"10.0.0.' || event_id % 250 || '","src":{{"ip":"10.0.1.' || event_id % 250 || '"}}}}' || chr(10) || '{{bad from 10.2.0.' || event_id % 250"""
_NDJSON_MASKED = f"""'{{"user": "' || {token('USER', "'u' || user_id")} || '", "n": 1.50}}' || chr(10) || '{{"src.ip": "' || {token('IP', "'10.0.0.' || event_id % 250")} || '", "src": {{"ip": "' || {token('IP', "'10.0.1.' || event_id % 250")} || '"}}}}' || chr(10) || '{{bad from ' || {token('IP', "'10.2.0.' || event_id % 250")}"""


@query(f"SELECT event_id, {_NDJSON_MASKED} AS doc FROM events")
def json_lines_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines with a dotted key beside a nested one, numbers kept as written, and a line that is no JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_NDJSON).alias("doc"))
    return jsondocs.mask_any(rows, OPTIONS, "doc")


@query("SELECT event_id, CAST(i AS BIGINT) AS line_no, kind FROM (SELECT event_id, unnest([1, 2, 3]) AS i, unnest(['json', 'json', 'text']) AS kind FROM events) AS t")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_NDJSON).alias("text"))
    return records.ndjson_lines(rows).select("event_id", "line_no", "kind")


@query("SELECT event_id, path, leaf FROM (SELECT event_id, unnest(['$[''a.b'']', '$.a.b', '$.l[0]']) AS path, unnest(['x' || event_id, 'y', 'z']) AS leaf FROM events) AS t")
def json_dotted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr("""'{"a.b":"x' || event_id || '","a":{"b":"y"},"l":["z"]}'""")
    return jsondocs.flatten(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "doc", "event_id").select("event_id", "path", "leaf")


_RULES = Options(
    key=KEY,
    context_rules=(
        ContextRule(field="Badge-No", tag="badge"),
        ContextRule(path="order.owner.code", tag="owner", strategy="partial"),
        ContextRule(field_pattern="^x_", tag="extra", strategy="format"),
    ),
)
_RULED = f"""'{{"badge_no":"B' || {_U} || '","order":{{"owner":{{"code":"CODE' || lpad({_U}, 6, '0') || '"}}}},"X_note":"Ab12","code":"stays"}}'"""
_RULED_TOKENS = (token("BADGE", "'b' || user_id"), f"'CO' || {token('OWNER', _sql(f"substr(lower('CODE' || lpad({_U}, 6, '0')), 3, 6)"))} || substr(lpad(CAST(user_id AS VARCHAR), 6, '0'), 5, 2)", "'Xx99'")


@query(f"""SELECT event_id, '{{"badge_no": "' || {_RULED_TOKENS[0]} || '", "order": {{"owner": {{"code": "' || {_RULED_TOKENS[1]} || '"}}}}, "X_note": "' || {_RULED_TOKENS[2]} || '", "code": "stays"}}' AS doc FROM events""")
def json_context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context rules by key, by path and by expression, with full, partial and format masks, on text of no schema."""
    return jsondocs.mask_any(table(spark, sf_dir, "events").select("event_id", F.expr(_RULED).alias("doc")), _RULES, "doc")


@query(f"SELECT event_id, {_RULED_TOKENS[0]} AS badge, {_RULED_TOKENS[1]} AS code, {_RULED_TOKENS[2]} AS note, 'stays' AS other FROM events")
def json_context_rules_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules on columns of known schema."""
    schema = "badge_no string, `order` struct<owner: struct<code: string>>, X_note string, code string"
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(F.expr(_RULED), schema).alias("doc"))
    masked = jsondocs.mask_typed(rows, _RULES, ["doc"])
    return masked.select("event_id", F.col("doc.badge_no").alias("badge"), F.col("doc.order.owner.code").alias("code"), F.col("doc.X_note").alias("note"), F.col("doc.code").alias("other"))


@query("SELECT 2 * count(*) AS tp, 0 AS fn, 0 AS fp, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS precision_proxy FROM events")
def corpus_score_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled JSON documents: two values must go, a key and a number must stay."""
    doc = F.expr(f"""'{{"user":"account-' || {_U} || '","src":{{"ip":"10.0.0.' || event_id % 250 || '"}},"n":7.10}}'""")
    gone = F.array(F.expr(f"'account-' || {_U}"), F.expr("'\"10.0.0.' || event_id % 250 || '\"'"))
    rows = spread(table(spark, sf_dir, "events"), "event_id").select("event_id", doc.alias("input"), F.array(F.lit('"src"'), F.lit("7.10")).alias("must_keep"), gone.alias("must_not_contain"))
    return reports.score_corpus(rows, OPTIONS)


# ---- dictionary ----
_SHORT = replace(KEY, hash_len=4)


@query("SELECT DISTINCT tag FROM (SELECT unnest(['IP', 'USER']) AS tag FROM events) AS t")
def mapping_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask.mask_text(log_lines(spark, sf_dir, "kv"), OPTIONS, "line", replacements="found", tags=["CEF_KV", "USER_FIELD"])
    return mapping.tags(mapping.build(mapping.replacements(masked, "found")))


def _names(rows: DataFrame) -> DataFrame:
    from logveil.functions.hashing import pseudonym

    return mapping.resolved(rows.select(F.lit("USER").alias("tag"), F.col("c_name").alias("original"), F.lower("c_name").alias("normalized"), pseudonym(F.col("c_name"), "USER", _SHORT).alias("base")))


@query(f"""SELECT c_name AS original, '[USER_' || h || CASE WHEN k > 1 THEN '_' || k ELSE '' END || ']' AS pseudonym FROM (
SELECT c_name, h, row_number() OVER (PARTITION BY h ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, lower(c_name)) AS k FROM (SELECT c_custkey, c_name, {hashed('lower(c_name)', _SHORT)} AS h FROM customer) AS a) AS b""")
def mapping_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the names is known and keeps its pseudonyms; the rest comes after them."""
    rows = table(spark, sf_dir, "customer")
    return mapping.extend(_names(rows.where("c_custkey % 3 = 0")), _names(rows.where("c_custkey % 3 <> 0"))).select("original", "pseudonym")


@query("SELECT c_name AS original, 'r' || c_custkey AS pseudonym, true AS stored FROM customer")
def mapping_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary written as a table, as a document and as CSV, and read back."""
    known = table(spark, sf_dir, "customer").select(F.lit("USER").alias("tag"), F.col("c_name").alias("original"), F.expr("'r' || c_custkey").alias("pseudonym"))
    folder = checkpoint_folder(spark, "mapping")
    sinks.write_mapping(known, f"{folder}/table")
    sinks.export_mapping(known, f"{folder}/document")
    sinks.export_mapping_csv(known, f"{folder}/csv")
    stored = spark.read.parquet(f"{folder}/table").select("original", "pseudonym")
    loaded = files.load_mapping(spark, f"{folder}/document").withColumn("stored", F.lit(True))
    csv = spark.read.option("header", True).csv(f"{folder}/csv").toDF("original", "pseudonym")
    return stored.join(loaded, ["original", "pseudonym"], "left").join(csv, ["original", "pseudonym"]).withColumn("stored", F.coalesce("stored", F.lit(False)))


# ---- files, reports and jobs ----
def _paths(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return log_lines(spark, sf_dir, kind).select(F.expr("'d' || event_id % 3 || '/f' || event_id % 5 || '.log'").alias("path"), F.col("event_id").alias("line_no"), "line")


def _files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    folder = checkpoint_folder(spark, "files")
    sinks.write_text_mirror(_paths(spark, sf_dir, kind), folder)
    return folder


_FILE = "'rel_path=d' || event_id % 3 || '%2Ff' || event_id % 5 || '.log'"
_NUMBER = "row_number() OVER (PARTITION BY event_id % 3, event_id % 5 ORDER BY event_id)"


@query(f"SELECT {_FILE} AS path, {_NUMBER} AS line_no, line FROM ({lines_sql('event_id, line', None, 'mail')}) AS l")
def files_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as files of folders and read again with their numbers."""
    folder = _files(spark, sf_dir, "mail")
    found = files.lines(spark, folder, "*.txt")
    return found.select(F.regexp_extract(files.relative(F.col("path"), folder), "^(.*)/", 1).alias("path"), "line_no", "line")


@query(f"SELECT {_FILE} AS path, CAST(sum(length(line) + 1) AS BIGINT) AS size_bytes, 'utf-8' AS charset, false AS gzipped, sum(length(line) + 1) > 1000 AS oversized, false AS damaged, 'text' AS kind FROM ({lines_sql('event_id, line', None, 'mail')}) AS l GROUP BY 1")
def files_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read whole, with their charset, flags and shape."""
    folder = _files(spark, sf_dir, "mail")
    found = files.with_shape(files.whole_files(spark, [f"{folder}/*"], "*.txt", most_bytes=1000))
    return found.select(F.regexp_extract(files.relative(F.col("path"), folder), "^(.*)/", 1).alias("path"), "size_bytes", "charset", "gzipped", "oversized", "damaged", F.col("doc_kind").alias("kind"))


@query(f"SELECT {_FILE} AS path, {_NUMBER} AS line_no, line FROM ({lines_sql('event_id, line', None, 'mail')}) AS l")
def files_lines_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with their numbers, read in splits."""
    folder = _files(spark, sf_dir, "mail")
    found = files.numbered_text_lines(spark, folder, "*.txt")
    return found.select(F.regexp_extract(files.relative(F.col("path"), folder), "^(.*)/", 1).alias("path"), "line_no", "line")


@query(f"SELECT {_FILE} AS path, {_NUMBER} AS line_no, line FROM ({lines_sql('event_id, line', None, 'mail')}) AS l")
def files_lines_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written in parts of 50 lines; a part's name tells its place."""
    folder = checkpoint_folder(spark, "parts")
    sinks.write_text_mirror(_paths(spark, sf_dir, "mail"), folder, part_lines=50)
    found = files.lines(spark, folder, "*.txt").withColumn("path", files.relative(F.col("path"), folder))
    parts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("file", F.regexp_extract("path", "^(.*)/", 1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(parts.withColumn("before", before), "path").select(F.col("file").alias("path"), (F.col("line_no") + F.col("before")).alias("line_no"), "line")


_CYRILLIC = "translate(lower(c_name), 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ')"


@query(f"SELECT charset, gzipped, c_custkey, {_CYRILLIC} AS name FROM customer, (SELECT unnest(['utf-8', 'utf-8', 'utf-16']) AS charset, unnest([false, true, false]) AS gzipped) AS f")
def files_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three kinds read as text: UTF-8, the same packed, and UTF-16 with its mark."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CYRILLIC).alias("name"))
    folder = checkpoint_folder(spark, "charsets")
    for form, options in {"plain": {}, "packed": {"compression": "gzip"}, "wide": {"encoding": "UTF-16"}}.items():
        names.write.options(**options).json(f"{folder}/{form}")
    found = files.whole_files(spark, folder, "part-*")
    rows = records.numbered_lines(found.select("charset", "gzipped", "text")).where("line <> ''")
    return rows.select("charset", "gzipped", F.from_json("line", "c_custkey long, name string").alias("r")).select("charset", "gzipped", "r.*")


@query("SELECT 3 * count(*) - count(*) FILTER (WHERE event_id % 4 = 0) AS tp, count(*) FILTER (WHERE event_id % 4 = 0) AS fn, count(*) FILTER (WHERE event_id % 5 = 0) AS fp, (3 * count(*) - count(*) FILTER (WHERE event_id % 4 = 0)) / (3 * count(*)) AS recall, (3 * count(*) - count(*) FILTER (WHERE event_id % 4 = 0)) / (3 * count(*) - count(*) FILTER (WHERE event_id % 4 = 0) + count(*) FILTER (WHERE event_id % 5 = 0)) AS precision_proxy FROM events")
def corpus_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written corpus loaded and scored: a quarter of its rows holds a secret that no rule knows, a fifth wants an account kept."""
    line = F.expr("'user=u' || user_id || ' from 10.0.0.' || event_id % 250 || ' by u' || user_id || '@bank.com' || CASE WHEN event_id % 4 = 0 THEN ' code word heron' ELSE '' END")
    gone = F.expr("array('=u' || user_id || ' ', '10.0.0.' || event_id % 250, CASE WHEN event_id % 4 = 0 THEN 'heron' ELSE '@bank' END)")
    kept = F.expr("array('user=', CASE WHEN event_id % 5 = 0 THEN 'u' || user_id || '@' ELSE ' from ' END)")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), line.alias("input"), kept.alias("must_keep"), gone.alias("must_not_contain"))
    folder = checkpoint_folder(spark, "corpus")
    rows.write.json(folder)
    return reports.score_corpus(spread(files.load_corpus(spark, folder), "id"), OPTIONS)


@query("""SELECT 'rel_path=' || CASE WHEN event_id % 3 = 0 THEN 'raw' ELSE 'masked' END || event_id % 3 || '.log' AS path, count(*) AS line_count, CASE WHEN event_id % 3 = 0 THEN 'EMAIL; FQDN; RESIDUAL: EMAIL' ELSE '' END AS issues, event_id % 3 <> 0 AS safe FROM events GROUP BY 1, 3, 4""")
def job_verify_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with masked files and one that was never masked."""
    masked = mask.mask_text(log_lines(spark, sf_dir, "mail"), OPTIONS, "line", out="masked", tags=["EMAIL"])
    name = F.expr("CASE WHEN event_id % 3 = 0 THEN 'raw' ELSE 'masked' END || event_id % 3 || '.log'")
    lines = masked.select(name.alias("path"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, F.col("line")).otherwise(F.col("masked")).alias("line"))
    folder = checkpoint_folder(spark, "results")
    sinks.write_text_mirror(lines, folder)
    found = jobs.verify_folder(spark, folder, OPTIONS, "*.txt")
    return found.select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "line_count", F.array_join("issues", "; ").alias("issues"), "safe")


@query(f"SELECT {_FILE} AS path, 'utf-8' AS charset FROM events GROUP BY 1")
def files_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _files(spark, sf_dir, "mail")
    return files.detect_charset(spark, folder).where(F.col("path").endswith(".txt")).select(F.regexp_extract(files.relative(F.col("path"), folder), "^(.*)/", 1).alias("path"), "charset")


@query(f"SELECT {_FILE} AS path, {_NUMBER} AS line_no, line FROM ({lines_sql('event_id, line', MASKED, 'mail')}) AS l")
def job_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder masked as one job."""
    folder = _files(spark, sf_dir, "mail")
    out = checkpoint_folder(spark, "masked")
    jobs.mask_folder(spark, folder, out, OPTIONS, "*.txt")
    return spark.read.parquet(out).select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "line_no", "line")


@query(f"""SELECT {_FILE} AS path, {_NUMBER} AS line_no, 'contact [EMAIL_' || h || CASE WHEN k > 1 THEN '_' || k ELSE '' END || ']' AS line FROM (
SELECT e.event_id, m.h, m.k FROM events AS e JOIN (SELECT user_id, h, row_number() OVER (PARTITION BY h ORDER BY 'u' || user_id || '@bank.com') AS k FROM (SELECT user_id, {hashed("'u' || user_id || '@bank.com'", replace(KEY, hash_len=3))} AS h FROM (SELECT DISTINCT user_id FROM events) AS d) AS a) AS m USING (user_id)) AS j""")
def job_folder_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with hashes of three digits: values that collide get suffixes, and their lines are rewritten."""
    folder = _files(spark, sf_dir, "mail")
    job = jobs.mask_folder(spark, folder, None, replace(OPTIONS, key=replace(KEY, hash_len=3)), "*.txt")
    return job.masked.select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "line_no", "line")


def _shapes(spark: SparkSession, sf_dir: str) -> str:
    """A folder with files of three shapes: text with objects in it, JSON Lines, and JSON documents over several lines."""
    doc = F.array(*(F.expr(t) for t in ("'{\"user\": \"u' || user_id || '\",'", "' \"src\": [\"10.0.0.' || event_id % 250 || '\"], \"n\": 7.10}'", "'contact u' || user_id || '@bank.com'")))
    rows = F.array(
        F.struct(F.lit("log").alias("kind"), (F.col("event_id") * 4).alias("n"), F.array_join(doc, "\n").alias("line")),
        F.struct(F.lit("ndjson").alias("kind"), (F.col("event_id") * 4).alias("n"), F.expr("'{\"user\":\"u' || user_id || '\",\"note\":\"from 10.0.0.' || event_id % 250 || '\"}'").alias("line")),
    )
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.explode(rows).alias("r"))
    lines = events.select(F.expr("'f' || event_id % 7 || '.' || r.kind").alias("path"), F.col("r.n").alias("line_no"), F.col("r.line").alias("line"))
    whole = table(spark, sf_dir, "events").select(F.expr("'e' || event_id % 199 || '.json'").alias("path"), F.col("event_id").alias("line_no"), F.expr("CASE WHEN event_id < 199 THEN '[' ELSE ',' END || '{\"user\":' || chr(10) || '\"u' || user_id || '\"}'").alias("line"))
    last = table(spark, sf_dir, "events").groupBy(F.expr("'e' || event_id % 199 || '.json'").alias("path")).agg((F.max("event_id") + 1).alias("line_no")).withColumn("line", F.lit("]"))
    folder = checkpoint_folder(spark, "shapes")
    sinks.write_text_mirror(lines.unionByName(whole).unionByName(last), folder)
    return folder


_SHORTER = replace(KEY, hash_len=3)
_SHAPED = replace(OPTIONS, key=_SHORTER)
#: SQL of the dictionary of values (tag, value) under hashes of three digits.
_NAMED = f"""SELECT tag, v, '[' || tag || '_' || h || CASE WHEN k > 1 THEN '_' || k ELSE '' END || ']' AS name
FROM (SELECT tag, v, h, row_number() OVER (PARTITION BY tag, h ORDER BY v) AS k FROM (SELECT tag, v, {hashed('v', _SHORTER)} AS h FROM (
SELECT DISTINCT 'USER' AS tag, 'u' || user_id AS v FROM events UNION SELECT 'IP', '10.0.0.' || event_id % 250 FROM events UNION SELECT 'EMAIL', 'u' || user_id || '@bank.com' FROM events) AS d) AS a) AS b"""


@query(f"""WITH d AS ({_NAMED}), e AS (
SELECT event_id, u.name AS u, i.name AS i, m.name AS m FROM events JOIN d AS u ON u.tag = 'USER' AND u.v = 'u' || user_id
JOIN d AS i ON i.tag = 'IP' AND i.v = '10.0.0.' || event_id % 250 JOIN d AS m ON m.tag = 'EMAIL' AND m.v = 'u' || user_id || '@bank.com')
SELECT 'rel_path=f' || event_id % 7 || '.log' AS path, 3 * n + 1 AS line_no, '{{' || chr(10) || '  "user": "' || u || '",' || chr(10) || '  "src": [' || chr(10) || '    "' || i || '"' || chr(10) || '  ],' || chr(10) || '  "n": 7.10' || chr(10) || '}}' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) - 1 AS n FROM e) AS x
UNION ALL SELECT 'rel_path=f' || event_id % 7 || '.log', 3 * n + 3, 'contact ' || m FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) - 1 AS n FROM e) AS x
UNION ALL SELECT 'rel_path=f' || event_id % 7 || '.ndjson', row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id), '{{"user": "' || u || '", "note": "from ' || i || '"}}' FROM e
UNION ALL SELECT 'rel_path=e' || event_id % 199 || '.json', 1, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "user": "' || u || '"' || chr(10) || '  }}', ',' || chr(10) ORDER BY event_id) || chr(10) || ']' FROM e GROUP BY event_id % 199""")
def job_folder_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text, JSON Lines and JSON documents masked as one job; values collide, within lines and documents too."""
    folder = _shapes(spark, sf_dir)
    out = checkpoint_folder(spark, "masked")
    jobs.mask_folder(spark, folder, out, _SHAPED, "*.txt")
    return spark.read.parquet(out).select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "line_no", "line")


@query(f"SELECT tag, v AS original, name AS pseudonym FROM ({_NAMED}) AS d")
def job_folder_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one dictionary of that job: values of JSON files and of text, with their suffixes."""
    return jobs.mask_folder(spark, _shapes(spark, sf_dir), None, _SHAPED, "*.txt").dictionary.select("tag", "original", "pseudonym")


@query("""SELECT 'rel_path=f' || event_id % 7 || '.log' AS path, 3 * count(*) AS line_count, 3 * count(*) AS replacements, 'EMAIL,IP,USER' AS tags, true AS safe FROM events GROUP BY 1
UNION ALL SELECT 'rel_path=f' || event_id % 7 || '.ndjson', count(*), 2 * count(*), 'IP,USER', true FROM events GROUP BY 1
UNION ALL SELECT 'rel_path=e' || event_id % 199 || '.json', 2 * count(*) + 1, count(*), 'USER', true FROM events GROUP BY 1""")
def job_folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of that job."""
    report = jobs.mask_folder(spark, _shapes(spark, sf_dir), None, _SHAPED, "*.txt").report()
    return report.select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "line_count", "replacements", F.array_join(F.array_sort(F.map_keys("stats_by_type")), ",").alias("tags"), "safe")


@query("SELECT event_id, 'u' || user_id || '@bank.com, u' || event_id || '@bank.com and u' || user_id || '@bank.com' AS line FROM events")
def job_folder_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three values under hashes of one digit, where nearly all collide, masked as a job and restored from its dictionary."""
    lines = table(spark, sf_dir, "events").select(F.expr("'f' || event_id % 3").alias("path"), F.col("event_id").alias("line_no"), F.expr("'event ' || event_id || ': u' || user_id || '@bank.com, u' || event_id || '@bank.com and u' || user_id || '@bank.com'").alias("line"))
    folder = checkpoint_folder(spark, "files")
    sinks.write_text_mirror(lines, folder)
    job = jobs.mask_folder(spark, folder, None, replace(OPTIONS, key=replace(KEY, hash_len=1)), "*.txt")
    back = mapping.reidentify(job.masked.withColumn("id", F.concat_ws(":", "path", "line_no")), job.dictionary, "line", "id")
    return back.select(F.regexp_extract("line", r"^event (\d+): ", 1).cast("long").alias("event_id"), F.regexp_replace("line", r"^event \d+: ", "").alias("line"))


@query("""SELECT event_id, '[USER_a' || lower(to_hex(user_id)) || CASE WHEN user_id % 2 = 0 THEN '_2' ELSE '' END || '] met [IP_b' || lower(to_hex(event_id % 250)) || CASE WHEN event_id % 250 % 2 = 0 THEN '_2' ELSE '' END || ']' AS line FROM events""")
def mapping_rewrite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pseudonyms in lines replaced by those of a merged dictionary."""
    events = table(spark, sf_dir, "events")
    name = lambda tag, c: F.expr(f"'[{tag}' || lower(hex({c})) || ']'")
    new = lambda tag, c: F.expr(f"'[{tag}' || lower(hex({c})) || '_2]'")
    users = events.select("user_id").distinct().where("user_id % 2 = 0").select(name("USER_a", "user_id").alias("old"), new("USER_a", "user_id").alias("new"))
    hosts = events.select(F.expr("event_id % 250").alias("h")).distinct().where("h % 2 = 0").select(name("IP_b", "h").alias("old"), new("IP_b", "h").alias("new"))
    lines = events.select("event_id", F.concat(name("USER_a", "user_id"), F.lit(" met "), name("IP_b", "event_id % 250")).alias("line"))
    return mapping.rewrite(lines, users.unionByName(hosts), "line", "event_id")


@query(f"SELECT {_FILE} AS path, count(*) AS line_count, 'EMAIL; FQDN; RESIDUAL: EMAIL' AS issues, false AS safe FROM events GROUP BY 1")
def job_verify_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were never masked do not pass."""
    folder = _files(spark, sf_dir, "mail")
    found = jobs.verify_folder(spark, folder, OPTIONS, "*.txt")
    return found.select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "line_count", F.array_join("issues", "; ").alias("issues"), "safe")


@query("SELECT form, kind, n FROM (SELECT unnest(['jsonl', 'json', 'csv']) AS form) AS f, (SELECT 'k' || user_id % 5 AS kind, count(*) AS n FROM events GROUP BY 1) AS c")
def reports_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON Lines, as one JSON array and as CSV, and read back."""
    report = table(spark, sf_dir, "events").groupBy(F.expr("'k' || user_id % 5").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    folder, schema = checkpoint_folder(spark, "report"), "kind string, n long"
    for form in ("jsonl", "json", "csv"):
        sinks.write_report(report, f"{folder}/{form}", form)
    array = F.explode(F.from_json("value", f"array<struct<{schema}>>".replace("kind string", "kind: string").replace("n long", "n: long")))
    read = {
        "jsonl": spark.read.schema(schema).json(f"{folder}/jsonl"),
        "json": spark.read.text(f"{folder}/json").select(array.alias("r")).select("r.*"),
        "csv": spark.read.option("header", True).schema(schema).csv(f"{folder}/csv"),
    }
    named = [df.select(F.lit(form).alias("form"), "kind", "n") for form, df in read.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT side, n FROM (SELECT 'extra' AS side, count(*) AS n FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'missing', count(*) FROM events WHERE event_id % 10 = 1) AS t WHERE n > 0")
def reports_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a stored table has too many of, or lacks."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "user_id"), checkpoint_folder(spark, "stored")
    events.where("event_id % 10 <> 1").write.parquet(folder)
    return sinks.read_back(events.where("event_id % 10 <> 0"), folder).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'mask' AS action, 'events' AS source, count(*) AS emails, count(DISTINCT user_id) AS unique_values_replaced, 0 AS exit_code FROM events")
def audit_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit record appended to its log and read back."""
    masked = mask.mask_text(log_lines(spark, sf_dir, "mail"), OPTIONS, "line", replacements="found", tags=["EMAIL"])
    folder = checkpoint_folder(spark, "audit")
    sinks.append_audit(reports.audit(mapping.replacements(masked, "found"), "mask", "events"), folder)
    stored = spark.read.schema("action string, source string, stats_by_type map<string,long>, unique_values_replaced long, exit_code int").json(folder)
    return stored.select("action", "source", F.col("stats_by_type")["EMAIL"].alias("emails"), "unique_values_replaced", "exit_code")


@query("SELECT event_id, 'u' || user_id || '@bank.com' AS value, CASE WHEN total > 500 THEN total - 500 ELSE 0 END AS not_shown FROM (SELECT *, count(*) OVER () AS total FROM events) AS t ORDER BY 'u' || user_id || '@bank.com', event_id LIMIT 500")
def findings_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 findings by place and value, with the number of the rest."""
    rows = log_lines(spark, sf_dir, "mail").select("event_id", F.col("line").alias("text"))
    found = detect.findings(rows, OPTIONS, "text", ["EMAIL"]).drop("text")
    return reports.first_findings(found).select("event_id", "value", "not_shown")


@query(f"SELECT event_id, 'contact ' || {token('EMAIL', "'u' || user_id || '@bank.com'")} AS text, 1 AS emails, {token('EMAIL', "'u' || user_id || '@bank.com'")} AS pseudonym, true AS safe FROM events")
def mask_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, counts, dictionary and verdict in one row."""
    rows = log_lines(spark, sf_dir, "mail").select("event_id", "user_id", F.col("line").alias("text"))
    done = reports.results(rows, OPTIONS)
    return done.select("event_id", "text", F.col("stats")["EMAIL"].cast("int").alias("emails"), F.col("mapping")[F.expr("'u' || user_id || '@bank.com'")].alias("pseudonym"), "safe")


@query(f"SELECT event_id, 8 AS start, CAST(8 + length({token('EMAIL', "''")}) AS INT) AS \"end\", 1 AS replacements, true AS changed FROM events")
def scan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line of a scan: where its pseudonyms stand."""
    rows = reports.scan_lines(log_lines(spark, sf_dir, "mail"), OPTIONS)
    return rows.select("event_id", F.explode("spans").alias("s"), "replacements", "changed").select("event_id", "s.start", "s.end", "replacements", "changed")


@query(f"SELECT event_id, '8-' || length(line) AS before, '8-' || (8 + length({token('EMAIL', "''")})) AS after FROM ({lines_sql('event_id, line', None, 'mail')}) AS l")
def token_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of differing tokens of lines and their masked form."""
    lines = log_lines(spark, sf_dir, "mail").select("event_id", "line")
    both = mask.mask_text(lines, OPTIONS, "line", out="masked", tags=["EMAIL"])
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return diff.token_diff(both, "line", "masked").select("event_id", spans("spans_before").alias("before"), spans("spans_after").alias("after"))


@query("SELECT doc_id, CASE WHEN length(substr(text, 1, 20000)) > 0 THEN 1 - (length(substr(text, 1, 20000)) - length(regexp_replace(substr(text, 1, 20000), '[\\x{FFFD}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))) / length(substr(text, 1, 20000)) ELSE 1 END AS quality, contains(text, chr(65533)) AS damaged FROM documents")
def decode_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", records.decode_quality(text).cast("double").alias("quality"), records.is_damaged(text).alias("damaged"))


@query(f"SELECT c_custkey, {token('USER', 'lower(c_name)')} AS name, regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', '9', 'g') AS shape, 'mail ' || {token('EMAIL', "'c' || c_custkey || '@x.com'")} AS mail FROM customer")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking from SQL by the registered functions."""
    sqlfuncs.register(spark, OPTIONS)
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.expr("logveil_pseudonymize(c_name, 'USER')").alias("name"), F.expr("logveil_mask_format(c_name)").alias("shape"), F.expr("logveil_mask_email('mail c' || c_custkey || '@x.com')").alias("mail"))


# ---- streams ----
def _stream(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select("event_id", "user_id", F.expr(line).alias("line"))


@query("SELECT event_id, 1 AS replacements, true AS changed, true AS safe FROM events")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan events of a stream of lines."""
    scanned = streams.scan_stream(_stream(spark, sf_dir, LINES["mail"]), OPTIONS).select("event_id", "replacements", "changed", "safe")
    return _stored(spark, scanned, "scan")


def _stored(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = checkpoint_folder(spark, name)
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_ADDRESSES = f"SELECT DISTINCT 'EMAIL' AS tag, 'u' || user_id || '@bank.com' AS original, {token('EMAIL', "'u' || user_id || '@bank.com'")} AS pseudonym FROM events"


def _grown(spark: SparkSession, lines: DataFrame) -> DataFrame:
    folder = checkpoint_folder(spark, "dictionary")
    streams.grow_dictionary(lines, OPTIONS, f"{folder}/table", f"{folder}/state", trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema(streams.ENTRY).parquet(f"{folder}/table").select("tag", "original", "pseudonym")


@query(_ADDRESSES)
def stream_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary that grows with a stream."""
    return _grown(spark, _stream(spark, sf_dir, LINES["mail"]))


@query(_ADDRESSES)
def stream_dictionary_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines in several files, each a batch, most of whose values earlier ones had."""
    folder = checkpoint_folder(spark, "lines")
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(LINES["mail"]).alias("line"))
    rows.repartition(5, "event_id").select("line").write.parquet(folder)
    return _grown(spark, spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(folder))


_NESTED = """'[' || event_id || '] step' || chr(10) || '{"a": [' || chr(10) || '{"b": ' || event_id || '},' || chr(10) || '[]' || chr(10) || ']} done' || chr(10) || '{"open": [' || chr(10) || '[1, 2' || chr(10) || 'oops ' || event_id"""
_NESTED_SQL = f"""SELECT 'p' || event_id % 20 AS path, chunk_no, kind, chunk FROM (
SELECT event_id, 8 * (dense_rank() OVER (PARTITION BY event_id % 20 ORDER BY event_id) - 1) + u.i AS chunk_no, u.kind AS kind, u.chunk AS chunk FROM (SELECT event_id, unnest([
{{'i': 0, 'kind': 'json', 'chunk': '[' || event_id || ']'}}, {{'i': 1, 'kind': 'text', 'chunk': ' step' || chr(10)}}, {{'i': 2, 'kind': 'json', 'chunk': '{{"a": [' || chr(10) || '{{"b": ' || event_id || '}},' || chr(10) || '[]' || chr(10) || ']}}'}},
{{'i': 3, 'kind': 'text', 'chunk': ' done' || chr(10)}}, {{'i': 4, 'kind': 'text', 'chunk': '{{"open": [' || chr(10)}}, {{'i': 5, 'kind': 'text', 'chunk': '[1, 2' || chr(10)}}, {{'i': 6, 'kind': 'text', 'chunk': 'oops ' || event_id || chr(10)}},
{{'i': 7, 'kind': 'json', 'chunk': '[' || event_id || ']'}}]) AS u FROM events) AS x) AS y"""


def _nested(rows: DataFrame, *more: str) -> DataFrame:
    """(path, event_id, more columns, i, line) of text, nested documents, brackets that are never closed, and a document of one line."""
    lines = F.split(F.concat(F.expr(_NESTED), F.expr("chr(10) || '[' || event_id || ']'")), "\n")
    return rows.select(F.expr("'p' || event_id % 20").alias("path"), "event_id", *more, F.posexplode(lines).alias("i", "line"))


@query(_NESTED_SQL)
def json_assembly_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents between lines that begin with brackets and are none."""
    rows = _nested(table(spark, sf_dir, "events"))
    return streams.assemble(rows.select("path", (F.col("event_id") * 9 + F.col("i")).alias("line_no"), "line"))


@query(_NESTED_SQL)
def stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream whose lines arrive in two batches and out of order."""
    # numbered before lines are made: lines of few bytes of events, joined with numbers, would be taken for few and broadcast
    numbered = table(spark, sf_dir, "events").select("event_id", (F.row_number().over(Window.partitionBy(F.col("event_id") % 20).orderBy("event_id")) - 1).alias("n"))
    folder = checkpoint_folder(spark, "lines")
    lines = _nested(numbered, "n").select("path", (F.col("n") * 9 + F.col("i") + 1).alias("line_no"), "line")
    out = checkpoint_folder(spark, "assembled")
    for part in range(2):
        # a run for each half; which half a line is in has nothing to do with its place
        lines.where(F.pmod(F.xxhash64("path", "line_no"), F.lit(2)) == part).write.mode("append").parquet(folder)
        stream = streams.assemble_stream(spark.readStream.schema(lines.schema).parquet(folder))
        running = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(once=True).start(f"{out}/rows")
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
