"""The thin queries over the intended tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_tokens, op2_jaccard, op3_surrogates, op4_quality, op5_langid, op6_bpe, op7_mix, op8_lines, op9_vectors, op10_suffix_tree
from .common import table

#: Stands for a key that a deployment takes from its own store.
SECRET = "veilspark-demo-key"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = op7_mix.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_jaccard.link(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_surrogates.replace(table(spark, sf_dir, "documents"), SECRET).select("doc_id", "n_entities", "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op4_quality.judge(docs, op4_quality.learn(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_langid.identify(docs, op5_langid.learn(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_suffix_tree.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard, op3_pii_surrogates, op4_quality_rules, op5_language_id, op6_byte_bpe, op7_source_mix, op8_line_dedup, op9_vector_near_dedup, op10_suffix_tree_scores)}

def _components(links: str, nodes: str) -> str:
    """``reach(node, root)`` over symmetric ``links(a, b)``."""
    return f"reach AS (SELECT id AS node, id AS root FROM {nodes} UNION SELECT l.b, r.root FROM reach r JOIN {links} l ON l.a = r.node)"


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT id, coalesce(len(s), 0) AS n FROM s), u AS (SELECT id, unnest(s) AS h FROM s),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS both_have FROM u a JOIN u b ON a.h = b.h AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)), {_components("l", "n")}
SELECT n.id AS doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN reach ON reach.node = n.id GROUP BY ALL"""
VECTORS_SQL = f"""WITH RECURSIVE n AS (SELECT vec_id AS id FROM embeddings), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS size FROM e WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.98), {_components("l", "n")},
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT node AS vec_id, coalesce(n_links, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN k ON k.a = c.node"""
LINES_SQL = f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(raw) AS line, generate_subscripts(raw, 1) AS pos FROM d), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM p),
u AS (SELECT doc_id, pos, s, length(s) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t WHERE s <> ''),
a AS (SELECT doc_id, list(s ORDER BY i) AS ss, list(n ORDER BY i) AS ns, list(pos ORDER BY i) AS ps, count(*) AS k FROM u GROUP BY doc_id),
g AS (SELECT u.doc_id, u.i, a.*, list_min(list_filter(generate_series(1, {op8_lines.LEAST_CHARS}), lambda x: u.i + x - 1 <= k AND list_sum(ns[u.i:u.i + x - 1]) >= {op8_lines.LEAST_CHARS})) AS ahead,
 list_min(list_filter(generate_series(1, {op8_lines.LEAST_CHARS}), lambda x: u.i - x + 1 >= 1 AND list_sum(ns[u.i - x + 1:u.i]) >= {op8_lines.LEAST_CHARS})) AS behind FROM u JOIN a ON a.doc_id = u.doc_id),
f AS (SELECT doc_id, array_to_string(ss[i:i + ahead - 1], chr(10)) AS f, ps[i] AS at_, ps[i:i + ahead - 1] AS lines FROM g WHERE ahead IS NOT NULL
 UNION ALL SELECT doc_id, array_to_string(ss[i - behind + 1:i], chr(10)), ps[i - behind + 1], ps[i - behind + 1:i] FROM g WHERE behind > 1
 UNION ALL SELECT doc_id, 'whole' || chr(10) || array_to_string(ss, chr(10)), ps[1], ps FROM a WHERE list_sum(ns) < {op8_lines.LEAST_CHARS}),
h AS (SELECT *, min(doc_id) OVER (PARTITION BY f) AS d0 FROM f), b AS (SELECT *, min(CASE WHEN doc_id = d0 THEN at_ END) OVER (PARTITION BY f) AS at0 FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(lines) AS pos FROM b WHERE doc_id > d0 OR at_ > at0),
o AS (SELECT p.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p.pos) FILTER (gone.pos IS NULL), '') AS text FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos GROUP BY p.doc_id)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, o.text FROM documents x LEFT JOIN o ON o.doc_id = x.doc_id"""
#: The tokenizers, trained models, keyed draws and the rounding of the mix are not expressible in SQL; tests hold these against brute force.
ORACLES: dict[str, str] = {"op2_ngram_jaccard": JACCARD_SQL, "op8_line_dedup": LINES_SQL, "op9_vector_near_dedup": VECTORS_SQL}
