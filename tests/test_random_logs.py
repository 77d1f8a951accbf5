"""Random logs of all kinds of values: nothing planted is left, masked text is safe, originals come back."""

import random

from pyspark.sql import functions as F

from logveil.functions.hashing import Key
from logveil.operators import detect, mapping, mask
from logveil.plans.options import Options

LINES, SEED = 200, 11
OPTIONS = Options(key=Key.derive("random logs", 10))


def _line(rng: random.Random) -> tuple[str, list[str]]:
    """A line of one to four random phrases, and the values that must not stay in it."""
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    user, host = f"{word(6)}{rng.randint(10, 99)}", f"{word(7)}.{word(5)}.local"
    ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
    mac = ":".join(hexes(2) for _ in range(6))
    uuid = "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    sid = f"S-1-5-21-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}"
    phrases = [
        (f"user={user}", [user]),
        (f"src={ip} action=drop", [ip]),
        (f"Accepted password for {user} from {ip} port 22", [user, ip]),
        (f"mail {user}@{word(6)}.com sent", [user]),
        (f"host {host} up", [host]),
        (f"nic {mac} joined", [mac]),
        (f"job {uuid} done", [uuid]),
        (f"sid {sid} seen", [sid]),
        (f"open /home/{user}/x", [user]),
        (f"md5 {(digest := hexes(32))}", [digest]),
        (f"logon corp\\{user} granted", [user]),
        (f"step {rng.randint(1, 9)} of the plan", []),
    ]
    chosen = rng.sample(phrases, rng.randint(1, 4))
    return "; ".join(text for text, _ in chosen), [v for _, values in chosen for v in values]


def test_random_logs_are_safe_and_come_back(spark):
    rng = random.Random(SEED)
    made = {i: _line(rng) for i in range(LINES)}
    rows = spark.createDataFrame([(i, text) for i, (text, _) in made.items()], "doc_id int, text string")
    masked = mask.mask_text(rows, OPTIONS, out="masked", replacements="found").cache()
    for row in masked.select("doc_id", "masked").collect():
        left = [v for v in made[row.doc_id][1] if v in row.masked]
        assert not left, (made[row.doc_id][0], row.masked)
    text = masked.select("doc_id", F.col("masked").alias("text"))
    unsafe = detect.verify(text, OPTIONS).where("not safe").select("text", "issues").collect()
    assert not unsafe
    known = mapping.build(mapping.replacements(masked, "found"))
    restored = {r.doc_id: r.text for r in mapping.reidentify(text, known).collect()}
    assert restored == {i: text for i, (text, _) in made.items()}
