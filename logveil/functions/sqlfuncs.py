"""Masking from SQL: temporary SQL functions with the options' key."""

from __future__ import annotations

from pyspark.sql import SparkSession

from logveil.plans.options import Options
from logveil.plans.rules import EMAIL, IPV4, URL


def register(spark: SparkSession, options: Options, prefix: str = "logveil_") -> list[str]:
    """Creates pseudonymize(value, tag), mask_format(value), mask_email(text), mask_ipv4(text) and mask_url(text)."""
    inner, outer = (p.hex() for p in options.key.pads())
    n = options.key.hash_len
    made = []

    def create(name: str, arguments: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS STRING RETURN {body}")
        made.append(prefix + name)

    def hashed(value: str) -> str:
        return f"substr(sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({value}, 'UTF-8')), 256))), 256), 1, {n})"

    create("pseudonymize", "value STRING, tag STRING", f"concat('[', tag, '_', {hashed("CASE WHEN tag IN ('SECRET', 'B64_CMD') THEN value ELSE lower(value) END")}, ']')")
    create("mask_format", "value STRING", r"regexp_replace(regexp_replace(regexp_replace(value, r'[\p{L}&&[^\p{Lu}]]', 'x'), r'\p{Lu}', 'X'), r'\p{Nd}', '9')")
    for name, tag, pattern in (("mask_email", "EMAIL", EMAIL), ("mask_ipv4", "IP", IPV4), ("mask_url", "URL", URL.replace("'", "\\x27"))):
        regex = f"r'(?U){pattern}'"
        out = f"concat('[{tag}_', {hashed('lower(v)')}, ']')"
        body = f"array_join(transform(split(text, {regex}, -1), (g, i) -> concat(g, coalesce(get(transform(regexp_extract_all(text, {regex}, 0), v -> {out}), i), ''))), '')"
        create(name, "text STRING", body)
    return made
