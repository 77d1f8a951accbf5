import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from logveil.functions import checks
from logveil.functions.hashing import Key, hmac_hex
from logveil.operators import detect, diff, jsondocs, mapping, mask, records, reports
from logveil.plans.options import ContextRule, CustomRule, Options

KEY = Key.derive("salt", 10)
OPTIONS = Options(key=KEY, org_name="Bank of Example", org_aliases=("BoE",))


def name(tag: str, value: str) -> str:
    return f"[{tag}_{hmac.new(KEY.value, value.encode(), hashlib.sha256).hexdigest()[:12]}]"


CASES = [
    ("sshd[1]: Accepted password for bob from 10.0.0.5 port 22", f"sshd[1]: Accepted password for {name('USER', 'bob')} from {name('IP', '10.0.0.5')} port 22"),
    ('user=bob password: "hun Ter2"', f'user={name("USER", "bob")} password: "{name("SECRET", "hun Ter2")}"'),
    ("req 9e107d9d372bb6826bd81d3542a419d6", "req 9e107d9d372bb6826bd81d3542a419d6"),
    ("md5 9e107d9d372bb6826bd81d3542a419d6", f"md5 {name('HASH', '9e107d9d372bb6826bd81d3542a419d6')}"),
    ("card 4111 1111 1111 1111", f"card {name('PAN', '411111111111')}1111"),
    ("at 12:30:45 HTTP/1.1 IKEv2/AES256", "at 12:30:45 HTTP/1.1 IKEv2/AES256"),
    ("open C:\\Users\\ann\\f.txt", f"open C:\\Users\\{name('USER', 'ann')}\\f.txt"),
    ("SID S-1-5-18", "SID S-1-5-18"),
    ("reason = Invalid password : server", "reason = Invalid password : server"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def masked(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    return mask.mask_text(rows, OPTIONS, out="masked", replacements="found").cache()


def test_masks(masked):
    got = {r["doc_id"]: r["masked"] for r in masked.collect()}
    assert got == {i: m for i, (_, m) in enumerate(CASES)}


def test_masked_text_is_safe_and_comes_back(masked):
    judged = detect.verify(masked.select("doc_id", F.col("masked").alias("text")), OPTIONS)
    assert judged.where("not safe").count() == 0
    known = mapping.build(mapping.replacements(masked, "found"))
    back = mapping.reidentify(masked.select("doc_id", F.col("masked").alias("text")), known)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t if i != 4 else "card 4111111111111111" for i, (t, _) in enumerate(CASES)}


def test_hmac(spark):
    words = ["", "abc", "Привет"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hmac_hex(F.col("w"), KEY).alias("h")).collect()
    assert all(r["h"] == hmac.new(KEY.value, r["w"].encode(), hashlib.sha256).hexdigest() for r in got)


def test_checks(spark):
    rows = spark.createDataFrame([("4111111111111111", "200988541", "BY13AKBB36120000000000000000", "::1"), ("4111111111111112", "100000007", "BY00AKBB36120000000000000000", "12:30:45"), ("0000000000000000", "200988542", "x", "1::2::3")], "p string, u string, i string, a string")
    got = rows.select(checks.pan_is_plausible(F.col("p")), checks.unp_is_valid(F.col("u")), checks.iban_is_valid(F.col("i")), checks.is_ip(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, True, False, False), (False, False, False, False)]


def test_custom_rules_and_allowlist(spark):
    options = Options(key=KEY, allowlist=("10.0.0.1",), custom_rules=(CustomRule("ticket", r"T-\d+"), CustomRule("late", r"T-1", priority=-1)))
    rows = spark.createDataFrame([("T-12 at 10.0.0.1",)], "text string")
    assert mask.mask_text(rows, options, tags=["CUSTOM:TICKET", "CUSTOM:LATE", "IP"]).first()[0] == f"{name('CUSTOM:TICKET', 't-12')} at 10.0.0.1"


def test_findings_have_places(spark):
    rows = spark.createDataFrame([(1, "a\nmail joe@bank.com now"), (2, None)], "doc_id int, text string")
    found = detect.findings(rows, OPTIONS, tags=["EMAIL", "FQDN"], non_overlapping=True).select("doc_id", "tag", "value", "start", "end", "line").collect()
    assert [tuple(r) for r in found] == [(1, "EMAIL", "joe@bank.com", 7, 19, 2)]


def test_collisions_merge_and_extend(spark):
    rows = spark.createDataFrame([("USER", v, v, "[USER_ab]") for v in ("a", "b", "c")], "tag string, original string, normalized string, base string")
    assert {r["original"]: r["pseudonym"] for r in mapping.resolved(rows).collect()} == {"a": "[USER_ab]", "b": "[USER_ab_2]", "c": "[USER_ab_3]"}
    known = mapping.resolved(rows.where("original = 'b'"))
    grown = mapping.extend(known, rows.withColumnRenamed("base", "pseudonym"))
    assert {r["original"]: r["pseudonym"] for r in grown.collect()} == {"b": "[USER_ab]", "a": "[USER_ab_2]", "c": "[USER_ab_3]"}


def test_typed_documents(spark):
    rows = spark.createDataFrame([("bob", ["mail joe@bank.com", None], {"ip": "10.0.0.1", "x": "y"}, 5)], "user string, notes array<string>, extra map<string,string>, n int")
    got = jsondocs.mask_typed(rows, Options(key=KEY, mask_structured_hosts=False)).first()
    assert got["user"] == name("USER", "bob") and got["notes"] == [f"mail {name('EMAIL', 'joe@bank.com')}", None]
    assert got["extra"] == {"ip": name("IP", "10.0.0.1"), "x": "y"} and got["n"] == 5


def test_context_rules():
    options = Options(context_rules=(ContextRule(path="$.session.token", tag="SECRET"), ContextRule(field_pattern="^pin")))
    assert jsondocs.context_rule(["a", "session", "token"], options).tag == "SECRET"
    assert jsondocs.context_rule(["token"], options) is None and jsondocs.context_rule(["pin_code"], options) is not None


def test_continued_lines(spark):
    rows = spark.createDataFrame([("f", 1, "a\\"), ("f", 2, "  b"), ("f", 3, ""), ("f", 4, "c"), ("f", 5, "\tat d")], "path string, line_no long, line string")
    assert sorted((r["line_no"], r["line"]) for r in records.join_continued(rows).collect()) == [(1, "a b"), (3, ""), (4, "c at d")]


def test_merge_spans(spark):
    one = spark.range(1).select(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 6), (0, 2), (2, 4), (1, 3)))).alias("s"))
    assert [tuple(x) for x in one.select(diff.merge_spans(F.col("s"))).first()[0]] == [(0, 4), (5, 6)]


def test_corpus_score_counts_misses(spark):
    rows = spark.createDataFrame([("1", "mail joe@bank.com to x", ["mail", "gone"], ["joe@bank.com", "to x"])], "id string, input string, must_keep array<string>, must_not_contain array<string>")
    assert tuple(reports.score_corpus(rows, OPTIONS).first())[:3] == (1, 1, 1)


def test_rules_keep_out_of_pseudonyms(spark):
    """A pseudonym of digits that looks like a telephone number stays whole and is restored."""
    from logveil.queries import OPTIONS

    rows = spark.createDataFrame([(1, "from 10.17.78.7 ok"), (2, "call +375291234567 from 10.17.78.7")], "doc_id long, text string")
    masked = mask.mask_text(rows, OPTIONS, replacements="found").cache()
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[1] == "from [IP_375567428066] ok" and texts[2].endswith("from [IP_375567428066]")
    known = mapping.build(mapping.replacements(masked, "found"))
    assert {r["text"] for r in mapping.reidentify(masked.select("doc_id", "text"), known).collect()} == {"from 10.17.78.7 ok", "call +375291234567 from 10.17.78.7"}
    assert detect.verify(masked, OPTIONS).where("not safe").count() == 0


def test_many_addresses_come_back(spark):
    """100 000 addresses under the rules of addresses, telephone and card numbers."""
    from logveil.queries import OPTIONS

    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.expr("'ip 10.' || id % 256 || '.' || (id div 256) % 256 || '.' || pmod(xxhash64(id), 256) || ' end'").alias("text"))
    masked = mask.mask_text(rows, OPTIONS, replacements="found", tags=["IP", "PHONE", "PAN", "UNP"]).persist()
    known = mapping.build(mapping.replacements(masked, "found"))
    back = mapping.reidentify(masked.select("doc_id", "text"), known)
    assert back.exceptAll(rows).count() == 0 and masked.where(~F.col("text").rlike(r"^ip \[IP_[0-9a-f]{12}\] end$")).count() == 0


def test_suffixes_of_pseudonyms(spark):
    rows = spark.createDataFrame([("[CUSTOM:RULE_1_375567428066]",), ("[USER_ab12_3]",), ("[USER_0123]",), ("[IP_375567428066_2]",), ("x",)], "p string")
    got = [r["x"] for r in rows.select(mapping.parse(F.col("p")).alias("x")).collect()]
    assert [tuple(x) if x else None for x in got] == [("CUSTOM:RULE_1", "375567428066", 1), ("USER", "ab12", 3), ("USER", "0123", 1), ("IP", "375567428066", 2), None]
    known = spark.createDataFrame([("CUSTOM:RULE_1", "a", "a", "[CUSTOM:RULE_1_375567428066]")], "tag string, original string, normalized string, pseudonym string")
    new = spark.createDataFrame([("CUSTOM:RULE_1", "b", "b", "[CUSTOM:RULE_1_375567428066]")], known.schema)
    assert {r["pseudonym"] for r in mapping.extend(known, new).collect()} == {"[CUSTOM:RULE_1_375567428066]", "[CUSTOM:RULE_1_375567428066_2]"} == {r["pseudonym"] for r in mapping.merge([known, new], 12).collect()}


def test_text_of_any_shape(spark):
    from logveil.operators import jsondocs
    from logveil.queries import OPTIONS

    texts = ['{"user":"alice","n":1}\n{"user":"bob","n":2}', 'a line\n{"user":"carol"}\nmore 10.0.0.1', '{"a.b":"10.0.0.2","a":{"b":"10.0.0.3"},"n":12345678901234567890.12}', None, "", "[1, 2", '{\n "user": "dave", "e": [], "x": null\n}', '{"k": "v", "k": "10.0.0.4"}', "[" * 5000]
    out = [r["text"] for r in jsondocs.mask_any(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), OPTIONS).orderBy("id").collect()]
    assert not any(name in (t or "") for t in out for name in ("alice", "bob", "carol", "dave", "10.0.0"))
    assert out[0].count("\n") == 1 and '"n": 2' in out[0] and out[1].startswith("a line\n{") and "12345678901234567890.12" in out[2]
    assert out[3] is None and out[4] == "" and out[5] == "[1, 2" and out[6].startswith('{\n  "user": "[USER_') and out[8] == texts[8]


def test_places_of_many_matches(spark):
    from logveil.functions import regex

    rows = spark.createDataFrame([(n, "ab " * n) for n in (0, 1, 512, 513, 30_000)], "n int, t string")
    found = regex.starts(regex.gaps(F.col("t"), "b"), regex.extract_all(F.col("t"), "b"))
    assert all(r["x"] == [3 * i + 1 for i in range(r["n"])] for r in rows.select("n", found.alias("x")).collect())


def test_whole_files_of_masked_lines_are_verified_in_time(spark):
    import time

    line = f"contact [EMAIL_{'a' * 12}]\n"
    judged = lambda n: detect.verify(spark.createDataFrame([(line * n + "u1@bank.com",)], "text string"), OPTIONS).select("issues").first()["issues"]
    judged(1)
    start = time.time()
    assert judged(200_000) == ["EMAIL", "FQDN", "RESIDUAL: EMAIL"]
    assert time.time() - start < 120
