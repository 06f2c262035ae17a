"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm import chaining, decontaminate, jaccard, language, mixing, pii, prefix_trie, quality, sentence_pieces, sharding, spelling, token_files, toxicity
from obsflow.session import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def op1_rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.document_shards(table(spark, folder, "documents"))


@query
def op2_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
SQL["op2_rule_cascade"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t,
         list_filter(string_split(translate(t, {SPACES}, '      '), ' '), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: translate(x, {SPACES}, '') <> '') AS l,
         length(translate(t, {SPACES}, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper,
         length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) AS lower
  FROM texts),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, upper, lower
  FROM parts LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR (upper > lower AND upper > 20) OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM failed
"""


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    at = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), at, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, at))


@query
def op4_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Shares of the expected tokens after mixing.
MIXTURE = {"good": 0.92, "low": 0.06, "toxic": 0.02}


@query
def op5_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rated = mixing.mixed(docs, mixing.quality_domains(labels), MIXTURE, anchor="good", keep=["doc_id"])
    shares = [F.col("posterior")[j].alias(f"p_{d}") for j, d in enumerate(MIXTURE)]
    return rated.select("doc_id", "tokens", *shares, "rate")


@query
def op6_pu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = id_remainder(5) == 0
    model = toxicity.fit_toxicity(docs, labels, held)
    found = toxicity.score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op7_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.by_document(chaining.repeated_passages(table(spark, folder, "documents")))


@query
def op8_anchor_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, folder, "documents")))


@query
def op9_partenum_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query
def op10_subword_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = id_remainder(3) == 1
    model = language.fit_language(docs, held)
    found = language.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query
def op11_block_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations")).drop("p1", "p2")


SQL["op11_block_trie"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id,
         xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda state, byte: list_reduce(range(8), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, xor(state, byte)),
           4294967295::BIGINT)) % 4 AS h
  FROM turns),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 20 AND t.pos <= i.h
  UNION ALL
  SELECT t.conv_id, 1, t.pos, t.role, t.text FROM turns t JOIN ids i USING (conv_id) WHERE t.pos > i.h),
paths AS (
  SELECT i.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS path
  FROM ids i LEFT JOIN rebuilt r USING (conv_id) GROUP BY i.conv_id),
steps AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(path)) AS ids
  FROM steps GROUP BY ALL),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.node[n.depth].text, '[^ 	-]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]),
children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c ON c.depth = l.depth AND c.node = l.node),
above AS (SELECT node[1:up] AS node, up AS depth, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted)),
sums AS (SELECT node, depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL)
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(c.ids, '')) AS ends_sha256
FROM counted c JOIN sums s ON s.depth = c.depth AND s.node = c.node
"""


@query
def op12_piece_agenda(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = sentence_pieces.encode(table(spark, folder, "documents"), model)
    texts = sentence_pieces.decode(tokens, model, keep=["doc_id", "tokens"])
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return texts.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op13_sorted_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
