"""The training-data queries of the driver contract and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import exact_dedup, impact, jaccard, lexical, mixing, neighbours, packing, quotes, suffix, token_count, token_store, toxicity, whitening
from knotwork.llm.common import shared_dir, table

#: Shares of the expected tokens that low-quality and good documents are to have.
QUALITY_TARGETS = [0.4, 0.6]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), QUALITY_TARGETS)
    p = F.col("posterior")
    return rated.select("doc_id", "n_tokens", F.round(p[0], 6).alias("p_low"), F.round(p[1], 6).alias("p_good"), F.round("rate", 6).alias("rate"))


def op2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.link_quotes(table(spark, sf_dir, "conversations")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_store.read_store(spark.read.schema(token_store.BLOCK_SCHEMA).parquet(path))


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component; a deviation beyond 64 bits is null here (the operator's is a decimal)."""
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    rows = whitened.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", parts)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing, "op2_similar": op2_similar, "op3_quotes": op3_quotes, "op4_exact_dedup": op4_exact_dedup, "op5_neighbours": op5_neighbours,
    "op6_suffix_dedup": op6_suffix_dedup, "op7_toxicity": op7_toxicity, "op8_packing": op8_packing, "op9_token_count": op9_token_count, "op10_token_store": op10_token_store,
    "op11_whitening": op11_whitening, "op12_lexical": op12_lexical, "op13_exact_search": op13_exact_search, "pipeline": pipeline,
}

_EXACT = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT body, arg_min(doc_id, (-length(text), doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM n JOIN g USING (body)
"""

_SIMILAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
z AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM z UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT z.doc_id, class_id, coalesce(n_links, 0) AS n_links, z.n AS set_size
FROM z JOIN least ON least.a = z.doc_id LEFT JOIN counted ON counted.a = z.doc_id
"""

_NEIGHBOURS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_LEXICAL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY ALL),
g AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * g.n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, g.n),
m AS (SELECT doc_id, 100 - 25 + (25 * n.n * g.n) // g.l AS m FROM n, g),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM a JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

_EXACT_SEARCH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Quoted lines are taken out and passages counted; links are made for messages without quote marks (fixtures test the others).
_QUOTES = r"""
WITH l AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS l FROM conversations),
q AS (SELECT *, list_transform(l, lambda x: length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g'))) AS levels FROM l),
m AS (SELECT conv_id, turn, role, trim(array_to_string(list_filter(l, lambda x, i: levels[i] = 0), chr(10))) AS body,
  len(list_filter(range(1, len(l) + 1), lambda i: levels[i] > 0 AND (i = 1 OR levels[i - 1] <> levels[i]))) AS n_passages FROM q),
t AS (SELECT DISTINCT conv_id, turn FROM m),
b AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM t),
p AS (SELECT m.*, coalesce(b.previous, -1) AS parent_turn, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(body, '<|', '< |') || chr(10) AS chat
  FROM m JOIN b ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.turn IS NOT DISTINCT FROM b.turn),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY parent_turn, turn, role, body) AS position FROM p)
SELECT conv_id, (position - 1) // 256 AS part, count(*) AS n_messages, sum(n_passages)::BIGINT AS n_passages, 0::BIGINT AS n_linked,
  string_agg(turn || '<' || parent_turn, ',' ORDER BY position) AS replies, string_agg(chat, '' ORDER BY position) AS text
FROM n GROUP BY 1, 2
"""

ORACLE_SQL = {"op2_similar": _SIMILAR, "op3_quotes": _QUOTES, "op4_exact_dedup": _EXACT, "op5_neighbours": _NEIGHBOURS, "op12_lexical": _LEXICAL, "op13_exact_search": _EXACT_SEARCH}
