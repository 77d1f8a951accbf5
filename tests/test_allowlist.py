"""Allowlists as tables."""

from pyspark.sql import functions as F

from logveil import rule_queries
from logveil.functions.hashing import Key
from logveil.operators import mask
from logveil.plans.options import Options


def test_users_of_any_number_are_allowed(spark, tmp_path):
    users = [3, 4, 19_993, 20_003, 90_013, 90_014, None]
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").withColumn("event_type", F.lit("x")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["masked"] for r in rule_queries.mask_with_allowlist(spark, str(tmp_path)).collect()}
    assert {n for n, u in enumerate(users) if got[n] == f"contact u{u}@bank.com"} == {0, 2, 3, 4} and got[6] is None and got[5].startswith("contact [EMAIL_")


def test_table_masks_like_the_same_words_in_options(spark):
    texts = ["mail joe@bank.com and ann@bank.com", "from 10.0.0.1 by root", "user=joe src=10.0.0.1 ok", "call +375291234567", "joe@bank.com 10.0.0.2", "", None, "joe@bank.com 10.0.0.2"]
    # an allowed address of mail leaves its host to a later rule, and that host is allowed too
    words = [" JOE@bank.com", "bank.com ", "10.0.0.1", "", None]
    rows = spark.createDataFrame([(n % 7, t) for n, t in enumerate(texts)], "id int, text string")
    tags, options = ["EMAIL", "IP", "FQDN", "PHONE", "CEF_KV"], Options(key=Key.derive("salt", 10))
    literal = Options(key=options.key, allowlist=tuple(w for w in words if w))
    want = mask.mask_text(rows, literal, replacements="found", tags=tags)
    got = mask.mask_text_allowing(rows, options, spark.createDataFrame([(w,) for w in words], "value string"), replacements="found", tags=tags)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert any("mail joe@bank.com and [EMAIL_" in (r["text"] or "") for r in want.collect())
    assert mask.mask_text_allowing(rows, options, rows.limit(0).select(F.col("text").alias("value")), tags=tags).exceptAll(mask.mask_text(rows, options, tags=tags)).count() == 0
