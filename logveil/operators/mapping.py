"""The dictionary of originals and pseudonyms: building, merging, applying and undoing it.

Columns: tag, original (the first spelling), normalized, pseudonym.  Two values of
one tag whose shortened hashes agree get suffixes _2, _3, ... in the order of their
normalized values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions.checks import PSEUDONYM
from logveil.functions.hashing import Key
from logveil.functions.regex import extract_all, gaps
from logveil.operators.joins import lookup


def replacements(masked: DataFrame, column: str = "replacements", order: list[str] | None = None) -> DataFrame:
    """Rows of a replacements column; `order` names columns that tell which spelling came first."""
    rows = masked.select(*(order or []), F.posexplode(column).alias("__pos", "__r"))
    return rows.select(*(order or []), "__pos", "__r.*")


def build(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Distinct values of replacement rows with collisions resolved; values of format masks are left out."""
    place = F.struct(*[F.col(c) for c in (order or [])], *([F.col("__pos")] if "__pos" in rows.columns else []), F.col("original"))
    first = rows.where("reversible").groupBy("tag", "normalized").agg(F.min_by("original", place).alias("original"), F.min("pseudonym").alias("base"))
    return resolved(first.select("tag", "original", "normalized", "base"))


def _numbered(pseudonym: Column, hash_len: int | None) -> Column:
    """Whether a pseudonym ends in a collision suffix: a number behind the hash part.

    The hash part has `hash_len` digits; where that is not known, more than the suffix.
    """
    hash_part, suffix = F.regexp_extract(pseudonym, r"_([0-9a-f]+)_\d+\]$", 1), F.regexp_extract(pseudonym, r"_(\d+)\]$", 1)
    fits = F.length(hash_part) == hash_len if hash_len is not None else F.length(hash_part) > F.length(suffix)
    return (hash_part != "") & fits & ~suffix.startswith("0")


def base_of(pseudonym: Column, hash_len: int | None = None) -> Column:
    """The pseudonym without a collision suffix."""
    return F.when(_numbered(pseudonym, hash_len), F.regexp_replace(pseudonym, r"_\d+\]$", "]")).otherwise(pseudonym)


def suffix_of(pseudonym: Column, hash_len: int | None = None) -> Column:
    number = F.when(_numbered(pseudonym, hash_len), F.regexp_extract(pseudonym, r"_(\d+)\]$", 1))
    return F.coalesce(number.try_cast("int"), F.lit(1))


def parse(pseudonym: Column, hash_len: int | None = None) -> Column:
    """struct(prefix, hash, suffix); null for other strings."""
    base = base_of(pseudonym, hash_len)
    part = lambda k: F.regexp_extract(base, r"^\[(.+)_([0-9a-f]+)\]$", k)
    found = F.struct(part(1).alias("prefix"), part(2).alias("hash"), suffix_of(pseudonym, hash_len).alias("suffix"))
    return F.when(base.rlike(r"^\[.+_[0-9a-f]+\]$"), found)


def resolved(values: DataFrame, identity: str | None = None) -> DataFrame:
    """(tag, original, normalized, base) to the dictionary: the k-th value of a base gets suffix k (from 2).

    With `identity`, a column of values' whole hashes, those that share one share a name; the column stays.
    """
    if identity is None:
        named = values.withColumn("__k", F.row_number().over(Window.partitionBy("base").orderBy("normalized", "original")))
    else:
        first = F.min("normalized").over(Window.partitionBy(identity))
        named = values.withColumn("__first", first).withColumn("__k", F.dense_rank().over(Window.partitionBy("base").orderBy("__first", identity)))
    final = F.when(F.col("__k") == 1, F.col("base")).otherwise(F.concat(F.expr("left(base, length(base) - 1)"), F.lit("_"), F.col("__k").cast("string"), F.lit("]")))
    return named.select("tag", "original", "normalized", final.alias("pseudonym"), *([identity] if identity else []))


def merge(maps: list[DataFrame], hash_len: int | None = None) -> DataFrame:
    """Dictionaries of several runs to one; the result does not depend on their order."""
    every = maps[0]
    for more in maps[1:]:
        every = every.unionByName(more)
    first = every.groupBy("tag", "normalized").agg(F.min("original").alias("original"), F.min(base_of(F.col("pseudonym"), hash_len)).alias("base"))
    return resolved(first.select("tag", "original", "normalized", "base"))


def extend(known: DataFrame, new: DataFrame, hash_len: int | None = None) -> DataFrame:
    """A dictionary with new values; known values keep their suffixes, new ones come after them."""
    fresh = new.join(known, ["tag", "normalized"], "left_anti").groupBy("tag", "normalized").agg(F.min("original").alias("original"), F.min(base_of(F.col("pseudonym"), hash_len)).alias("base"))
    used = known.groupBy(base_of(F.col("pseudonym"), hash_len).alias("base")).agg(F.max(suffix_of(F.col("pseudonym"), hash_len)).alias("used"))
    rank = F.row_number().over(Window.partitionBy("base").orderBy("normalized", "original")) + F.coalesce("used", F.lit(0))
    named = fresh.join(used, "base", "left").withColumn("__k", rank)
    final = F.when(F.col("__k") == 1, F.col("base")).otherwise(F.concat(F.expr("left(base, length(base) - 1)"), F.lit("_"), F.col("__k").cast("string"), F.lit("]")))
    return known.select("tag", "original", "normalized", "pseudonym").unionByName(named.select("tag", "original", "normalized", final.alias("pseudonym")))


def rewrites(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new) for pseudonyms that a merge has changed."""
    pairs = old.select("tag", "normalized", F.col("pseudonym").alias("old")).join(new.select("tag", "normalized", F.col("pseudonym").alias("new")), ["tag", "normalized"])
    return pairs.where("old <> new").select("old", "new").distinct()


def inverted(mapping: DataFrame) -> DataFrame:
    """(pseudonym, original), one row per pseudonym."""
    return mapping.groupBy("pseudonym").agg(F.min("original").alias("original"))


def substitute(df: DataFrame, table: DataFrame, key: str, value: str, column: str = "text", id: str = "doc_id") -> DataFrame:
    """Replaces every pseudonym that a table (key, value) knows; others stay.

    Texts are cut at pseudonyms and the pieces looked up in the table, so the work grows with the
    pseudonyms in the texts and not with the table, and a pseudonym that stands in most texts makes no
    task longer than others.  Rows that share an id and text share the result.  Of several values of a
    key the smallest is taken.
    """
    text = F.col(column)
    tokens = extract_all(text, PSEUDONYM)
    # structs of null are equal, so pieces are grouped and joined by the same key and shuffled once
    whole = df.withColumn("__h", F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("h")))
    cut = whole.where(text.rlike(PSEUDONYM)).select("__h", F.posexplode(tokens).alias("__i", "__token"))
    known = table.groupBy(F.col(key).alias("__token")).agg(F.min(value).alias("__value"))
    told = lookup(cut, known, "__token", "__value")
    pieces = told.groupBy(F.col("__h").alias("__of")).agg(F.array_sort(F.collect_set(F.struct("__i", F.coalesce("__value", "__token").alias("v")))).alias("__p"))
    joined = whole.join(pieces, F.col("__h") == F.col("__of"), "left")
    out = F.array_join(F.transform(gaps(text, PSEUDONYM), lambda g, i: F.concat(g, F.coalesce(F.get("__p", i)["v"], F.lit("")))), "")
    return joined.withColumn(column, F.when(F.col("__p").isNotNull(), out).otherwise(text)).select(*df.columns)


def reidentify(df: DataFrame, mapping: DataFrame, column: str = "text", id: str = "doc_id") -> DataFrame:
    """Puts the originals back; unknown pseudonyms stay."""
    return substitute(df, inverted(mapping), "pseudonym", "original", column, id)


def rewrite(df: DataFrame, table: DataFrame, column: str = "text", id: str = "doc_id") -> DataFrame:
    """Replaces old pseudonyms by new ones."""
    return substitute(df, table, "old", "new", column, id)


def search(mapping: DataFrame, text: str = "", tag: str | None = None) -> DataFrame:
    """Entries of a tag whose original or pseudonym holds a text, whatever its case."""
    needle = text.lower()
    found = mapping.where(F.lower("original").contains(needle) | F.lower("pseudonym").contains(needle))
    return found.where(F.col("tag") == tag) if tag else found


def tags(mapping: DataFrame) -> DataFrame:
    return mapping.select("tag").distinct().orderBy("tag")


def _sealing_key(passphrase: str, salt: str, iterations: int) -> Column:
    return F.lit(Key.derive(salt, iterations, passphrase.encode()).value)


def protect(mapping: DataFrame, passphrase: str, salt: str, iterations: int = 600_000) -> DataFrame:
    """Encrypts the originals (AES-GCM; authenticated) with a key stretched from a passphrase and a salt."""
    key = _sealing_key(passphrase, salt, iterations)
    return mapping.withColumn("original", F.base64(F.aes_encrypt("original", key, F.lit("GCM")))).withColumn("normalized", F.base64(F.aes_encrypt("normalized", key, F.lit("GCM"))))


def unprotect(mapping: DataFrame, passphrase: str, salt: str, iterations: int = 600_000) -> DataFrame:
    """Decrypts; with a wrong passphrase or salt the originals are null."""
    key = _sealing_key(passphrase, salt, iterations)
    plain = lambda c: F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")
    return mapping.withColumn("original", plain("original")).withColumn("normalized", plain("normalized"))


def first_spellings(values: DataFrame, value: str, order: str) -> DataFrame:
    """Values that differ in more than case, each in its first spelling."""
    return values.groupBy(F.lower(value).alias("__low")).agg(F.min_by(value, order).alias(value), F.min(order).alias(order)).drop("__low")
