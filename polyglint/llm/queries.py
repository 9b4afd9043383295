"""Registered queries of this subpackage: thin digests over its operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import bm25, language_id, mixing, quality, toxicity
from polyglint.llm.common import crc32_mod
from polyglint.llm.embedding_dedup import near_vectors
from polyglint.llm.line_dedup import drop_recurring_lines
from polyglint.llm.mixing import mixed
from polyglint.llm.pieces import encode_decode
from polyglint.llm.simhash import simhash_groups
from polyglint.llm.token_store import store_round_trip
from polyglint.runtime import ready, table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder named by POLYGLINT_TOKENIZERS, or where the installed package has it."""
    if folder := os.environ.get("POLYGLINT_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return bm25.top_k(docs, docs.where(bm25.every_twentieth()))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(ready(spark), sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "text", F.col("lines.total").alias("n_lines"), F.col("lines.dropped").alias("n_dropped"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "pieces.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    fold = crc32_mod("doc_id", 4)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    fold = crc32_mod("doc_id", 3)
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 1))
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(table(ready(spark), sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "quality.*", quality.keeps(F.col("quality.score")).alias("keep"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(ready(spark), sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bm25_top_k": op1_bm25_top_k,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_token_store": op8_token_store,
    "op9_quality": op9_quality,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "pipeline": pipeline,
}

_OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight::DOUBLE AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
    FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) FILTER (WHERE ratio > level) AS final FROM l),
t AS (SELECT source, source_size, least(least(ratio, coalesce(final, ratio)) * weight, cap::DOUBLE) AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0::DOUBLE, target - whole * source_size) AS part FROM p),
s0 AS (SELECT source, -1::BIGINT AS edge, part AS missing FROM q),
@TURNS
t9 AS (SELECT d.*, s.missing, coalesce(@TAKEN, false) AS taken FROM d JOIN s4 s ON d.source IS NOT DISTINCT FROM s.source
    JOIN s0 ON d.source IS NOT DISTINCT FROM s0.source JOIN s1 ON d.source IS NOT DISTINCT FROM s1.source JOIN s2 ON d.source IS NOT DISTINCT FROM s2.source JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
g AS (SELECT source, draw, missing, sum(size) AS gain FROM t9 WHERE NOT taken AND size > 0 AND size < 2 * missing GROUP BY source, draw, missing HAVING gain < 2 * missing),
n AS (SELECT source, arg_min(draw, (abs(gain - missing), draw)) AS near FROM g GROUP BY source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN taken OR coalesce(draw = near AND size > 0 AND size < 2 * missing, false) THEN 1 ELSE 0 END) AS taken
FROM t9 JOIN q ON t9.source IS NOT DISTINCT FROM q.source LEFT JOIN n ON t9.source IS NOT DISTINCT FROM n.source
"""

_TURN = """
x{0} AS (SELECT d.source, draw, edge, missing, sum(size) OVER (PARTITION BY d.source ORDER BY draw) AS upto FROM d JOIN s{0} s ON d.source IS NOT DISTINCT FROM s.source WHERE draw > edge AND size <= missing),
s{1} AS (SELECT s.source, CASE WHEN max(upto) > max(s.missing) THEN coalesce(max(draw) FILTER (WHERE upto <= x.missing), max(s.edge)) ELSE 1152921504606846975 END AS edge,
    max(s.missing) - coalesce(max(upto) FILTER (WHERE upto <= x.missing), 0) AS missing FROM s{0} s LEFT JOIN x{0} x ON s.source IS NOT DISTINCT FROM x.source GROUP BY s.source),"""
_OP3 = _OP3.replace("@TURNS", "".join(_TURN.format(k, k + 1) for k in range(mixing.TURNS)).strip()).replace("@TAKEN", " OR ".join(f"(draw > s{k}.edge AND draw <= s{k + 1 if k < 3 else ''}.edge AND size <= s{k}.missing)" for k in range(mixing.TURNS)))

_OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len([x for x in embedding if isfinite(x)]) AND len([x for x in embedding if x <> 0]) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.y FROM r JOIN p ON p.x = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM embeddings LEFT JOIN c ON vec_id = a LEFT JOIN n ON vec_id = x
"""

_OP4 = r"""
WITH u AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS row FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT row, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line FROM u),
m AS (SELECT *, trim(regexp_replace(regexp_replace(line, '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g'), ' +', ' ', 'g'), ' ') AS form FROM l),
f AS (SELECT *, len(form) - len(replace(form, ' ', '')) + 1 AS k, (len(form) - len(replace(form, '<*>', ''))) / 3 AS v FROM m WHERE len(form) - len(replace(form, ' ', '')) + 1 >= 3),
e AS (SELECT *, k || ' ' || split_part(form, ' ', 1) || ' ' || split_part(form, ' ', 2) AS leaf FROM f),
h AS (SELECT * FROM e WHERE leaf IN (SELECT leaf FROM e GROUP BY leaf HAVING count(DISTINCT row) >= 10)),
o AS (SELECT leaf, form, k, count(DISTINCT row) AS n FROM h GROUP BY leaf, form, k),
t AS (SELECT leaf, form, k, n, generate_subscripts(string_split(form, ' '), 1) AS place, unnest(string_split(form, ' ')) AS token FROM o),
c AS (SELECT leaf, place, token FROM t WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(n) >= 10),
s AS (SELECT t.leaf, t.form, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.place) AS shape FROM t LEFT JOIN c ON t.leaf = c.leaf AND t.place = c.place AND t.token = c.token GROUP BY t.leaf, t.form, t.k
    HAVING count(c.token) >= 0.5 * count(*) AND (count(*) FILTER (WHERE c.token IS NULL AND t.token <> '<*>') = 0 OR count(c.token) FILTER (WHERE t.place > 2) >= greatest(least(t.k - 2, 2), ceil((t.k - 2) * 0.5)))),
g AS (SELECT h.row, h.no, h.form, h.leaf || '|' || shape AS template FROM h JOIN s ON h.leaf = s.leaf AND h.form = s.form),
r AS (SELECT template, min((row, no)) AS first FROM g GROUP BY template HAVING count(DISTINCT row) >= 10),
a AS (SELECT row, no, form FROM e WHERE k >= 10 AND v <= k * 0.5 AND form NOT IN (SELECT form FROM g JOIN r ON g.template = r.template)),
b AS (SELECT form, min((row, no)) AS first FROM a GROUP BY form HAVING count(DISTINCT row) >= 2),
x AS (SELECT DISTINCT row, no FROM (SELECT row, no, first FROM g JOIN r ON g.template = r.template UNION ALL SELECT row, no, first FROM a JOIN b ON a.form = b.form) WHERE (row, no) <> first),
y AS (SELECT l.row, string_agg(CASE WHEN x.no IS NULL THEN l.line END, chr(10) ORDER BY l.no) AS kept, count(x.no) AS n_dropped FROM l LEFT JOIN x ON l.row = x.row AND l.no = x.no GROUP BY l.row)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped
FROM documents d LEFT JOIN u ON d.doc_id IS NOT DISTINCT FROM u.doc_id AND d.text = u.text LEFT JOIN y ON u.row = y.row
"""

ORACLES: dict[str, str] = {"op2_embedding_dedup": _OP2, "op3_mixing": _OP3, "op4_line_dedup": _OP4}
