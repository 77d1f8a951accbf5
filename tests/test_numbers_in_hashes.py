"""Digits within a hash that has no context are no card or phone number."""

from logveil.functions.hashing import Key
from logveil.operators import detect, mask
from logveil.plans.options import Options

OPTIONS = Options(key=Key.derive("salt", 10))
#: The first has 13 digits in a row whose check digit is right, the second ends like a phone number.
KEPT = ["req 26dd0dbc6e3f4c8043749885523d6a25", "req 26dd0dbc6e3f4cabde80291234567890"]


def test_digits_within_a_hash_stay_and_pass(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(KEPT)], "doc_id int, text string")
    done = detect.verify(mask.mask_text(rows, OPTIONS), OPTIONS)
    assert {(r["text"], r["safe"]) for r in done.collect()} == {(t, True) for t in KEPT}
    assert detect.findings(rows, OPTIONS, tags=["PAN", "PHONE"]).count() == 0


def test_numbers_beside_a_hash_are_masked(spark):
    rows = spark.createDataFrame([(0, f"{KEPT[0]} 4111111111111111 80291234567")], "doc_id int, text string")
    found = mask.mask_text(rows, OPTIONS, replacements="found").first()["found"]
    assert {r["tag"] for r in found} == {"PAN", "PHONE"}
