"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.llm import bpe, chat, counts, decontaminate, hardneg, hpylm, langid, lines, neardup, quality, substrings, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column) -> F.Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under unigrams and under the hierarchical model."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hpylm.score(docs, trains=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after repeated passages of 35 words went."""
    found = substrings.parse(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = langid.fit(docs.where(fold != 1))
    return langid.predict(docs.select("doc_id", (fold == 1).alias("held_out"), "text"), model).drop("text")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = bpe.decode(encoded.select("doc_id", "n_tokens", "token_ids"))
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without copies and near copies of earlier lines."""
    found = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", "n_links", _sha(F.col("text")).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation, read back from its formatted examples."""
    control = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    examples = chat.expand(turns.unionByName(more))
    loss = F.struct("example", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    # the longest example of a conversation holds all its turns
    by_conv = examples.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(loss)).alias("losses"),
        F.max_by("formatted", "example").alias("whole"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    read = by_conv.withColumn("turns", chat.read_turns(F.col("whole"))).withColumn("trained", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        _sha(F.col("trained")).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
        "n_examples",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.exists("failed", lambda x: x.isin(*quality.BASE_RULES))
    return judged.select("doc_id", *(f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"), "kept", F.array_join("failed", ",").alias("failed"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark window, and the items they come from."""
    found = decontaminate.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        _sha(F.array_join(F.array_sort("item_ids"), ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits in its middle, its first third and at its end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, stop, text: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(text).alias("replacement"))
    middle, third = F.floor(n / 2), F.floor(n / 3)
    edits = F.array(edit(middle, middle + 5, " [edited] "), edit(third, third + 40, ""), edit(F.lit(None), F.lit(None), " The end."))
    trees = counts.count_trees(docs).withColumn("edits", edits).withColumn("n_tokens_before", F.col("n_tokens"))
    found = counts.apply_edits(trees)
    return found.select("doc_id", "n_tokens_before", "n_tokens", F.element_at("tree_chars", 2).cast("long").alias("n_chars"), "n_reencoded")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on shingles of two words."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector for each of its five best positives."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of other documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    # an id that is null marks no document
    model = toxicity.fit(docs.where(~held_out).join(labels.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id"))
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the eight whitened directions of largest variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_substring_dedup, op3_language_id, op4_byte_bpe, op5_line_dedup, op6_chat_formatting, op7_quality_rules, op8_decontamination, op9_token_counts, op10_near_dedup, op11_hard_negatives, op12_toxicity, op13_whitening)}
_CONTROL = "<|im_end|><|im_start|>assistant ok"
_CHAT_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'
), n AS (
  SELECT *, 24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS size FROM t
), c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = 'assistant' OR i = size AS ends FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE ends) AS formatted_chars, count(*) FILTER (WHERE ends) AS n_examples
FROM c GROUP BY conv_id"""
_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS solid FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[ 	-
]+', '', 'g')) > 0) AS l FROM d
), g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w
), k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) AS x GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(translate(x, '.,;:!?|*$%&#', '')) IN ({_STOPS}))) AS n_stop, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_caps
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END,
    CASE WHEN n_words > 1000000 THEN 'many_words' END, CASE WHEN n_words = 0 OR word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 'word_length' END,
    CASE WHEN n_symbols > 0.5 * n_words THEN 'symbols' END, CASE WHEN n_words = 0 OR n_stop / n_words < 0.01 THEN 'stop_words' END,
    CASE WHEN n_caps / word_chars > 0.6 THEN 'capitals' END, CASE WHEN n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END
  ], lambda x: x IS NOT NULL) AS bad FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  len(bad) = 0 AS kept, array_to_string(bad, ',') AS failed FROM f"""

_HARD_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3"""

ORACLES: dict[str, str] = {"op6_chat_formatting": _CHAT_SQL, "op7_quality_rules": _QUALITY_SQL, "op11_hard_negatives": _HARD_SQL}
