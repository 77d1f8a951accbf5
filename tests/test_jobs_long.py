"""Jobs on documents and texts with very many values take time in proportion to them."""

import json
import time
from dataclasses import replace

from pyspark.sql import functions as F

from logveil.functions.hashing import Key
from logveil.operators import jobs, mapping, mask
from logveil.plans.options import Options

KEY = Key.derive("salt", 10)


def test_document_of_many_values_that_collide(spark, tmp_path):
    values = [f"u{i}@bank.com" for i in range(3000)]
    (tmp_path / "doc.json").write_text(json.dumps({"mails": values}, indent=1))
    start = time.time()
    job = jobs.mask_folder(spark, str(tmp_path), None, Options(key=replace(KEY, hash_len=2)), "*.json")
    names = json.loads(job.masked.first()["line"])["mails"]
    assert time.time() - start < 150
    assert len(set(names)) == 3000
    assert {r["pseudonym"]: r["original"] for r in job.dictionary.collect()} == dict(zip(names, values, strict=True))
    back = mapping.reidentify(job.masked, job.dictionary, "line", "path").first()["line"]
    assert json.loads(back)["mails"] == values


def test_text_of_many_values(spark, tmp_path):
    spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("by u"), i.cast("string"), F.lit("@bank.com"))), " ").alias("text")).write.parquet(str(tmp_path / "text"))
    start = time.time()
    found = mask.mask_text(spark.read.parquet(str(tmp_path / "text")), Options(key=KEY), replacements="found", tags=["EMAIL"]).select(F.size("found").alias("n"), "text").first()
    assert found["n"] == 30_000 and found["text"].startswith("by [EMAIL_") and found["text"].count("@") == 0
    assert time.time() - start < 25
