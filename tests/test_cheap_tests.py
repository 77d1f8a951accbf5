"""The cheap tests before a rule's pattern: they spare it most lines and lose no match."""

from pyspark.sql import functions as F

from logveil.functions.hashing import Key
from logveil.plans.options import Options
from logveil.plans.rules import may_hold, rules

OPTIONS = Options(key=Key.derive("salt", 10), org_name="Bank of Example")
HELD = [
    "src=10.0.0.5 user=bob", "uſer: bob", "PASSWORD='x y'", "apiKey=1", "toKen: x", "mail a@b.com", "h1.bank.local", "h1.banK.org", "fe80::1", "::1", "10.0.0.5:80",
    "card 4111 1111 1111 1111", "card ٤١١١١١١١١١١١١١١١", "call +375 (29) 123-45-67", "tel 80291234567", "unp 190000000", "3333001A001PB5", "00:1A:2B:3C:4D:5E", "0011.2233.4455",
    "md5 9e107d9d372bb6826bd81d3542a419d6", "Server=a;Database=b", "postgres://u:p@h/x", "bank of example", "BanK of example", "DOM\\ann", "BY13AKBB00000000000000001134", "Account Name: x",
]
NONE = ["step 5 of HTTP/1.1 at 12:30:45 done", "reason: closed = true", "", None]


def test_no_match_is_lost(spark):
    rows = spark.createDataFrame([(t,) for t in HELD + NONE], "t string")
    both = [F.struct(r.may_match(F.col("t")).alias("a"), F.col("t").rlike(r.regex()).alias("b")).alias(f"r{i}") for i, r in enumerate(rules(OPTIONS))]
    got = rows.select("t", *both).collect()
    # a whole hash alone is no number
    wrong = [(x["t"], r.tag) for x in got for i, r in enumerate(rules(OPTIONS)) if x[f"r{i}"]["a"] != x[f"r{i}"]["b"] and not (r.tag in ("PAN", "PHONE") and x["t"].startswith("md5 "))]
    assert wrong == []


def test_most_rules_are_spared(spark):
    rows = spark.createDataFrame([(t,) for t in NONE[:2]], "t string")
    asked = {r.tag: may_hold(F.col("t"), r.tag, r.pattern.startswith("(?i)"), r.words) for r in rules(OPTIONS)}
    for tag in ("CONN_STR", "CEF_KV", "SECRET", "USER_FIELD", "HASH", "UNP", "BY_ID", "PAN", "PHONE", "FQDN", "MAC", "ORG"):
        assert rows.where(asked[tag]).count() == 0, tag
