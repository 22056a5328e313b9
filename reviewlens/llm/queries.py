"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import ann, bpe, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, toxicity, wavelet
from reviewlens.session import dealt

CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those removed, and a digest of the rest."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by batched merge rounds, and their text again."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files in key order, read back."""
    return wavelet.token_files(_table(spark, sf_dir, "documents")).drop("file")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every document; toxic: its threshold is met."""
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link at 85 in 100."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and ruling of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in 400-byte strings that occur elsewhere, removed; text: what is left."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards."""
    return sharding.placement(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_wavelet, op4_toxicity, op5_ann, op6_near_dedup, op7_quality, op8_packing, op9_suffix_dedup, op10_sharding)}

_LINES = """
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w FROM lines, unnest(range(1, len(l) - 1)) t(i)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, unnest(range(0, 3)) t(k)),
marked AS (SELECT l.doc_id, i AS pos, l.l[i] AS line, g.pos IS NOT NULL AS out FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines) l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.i)
"""

_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op6_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
rows_ AS (SELECT doc_id, unnest(s) AS sh FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM rows_ a JOIN rows_ b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
both_ AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS seen FROM both_ UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ b ON b.x = r.seen),
comp AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept FROM sets s LEFT JOIN comp c USING (doc_id)""",
    "op7_quality": f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM d),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, i, l[i] AS line, regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS lw FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM d))),
worded AS (SELECT *, array_to_string(lw, ' ') AS norm FROM lines WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
boiler AS (SELECT x.source, x.norm FROM worded x JOIN d USING (doc_id) GROUP BY x.source, x.norm HAVING count(DISTINCT d.text) > {quality.MAX_DOCS}),
lost AS (SELECT x.doc_id, CAST(sum(len(x.lw)) AS BIGINT) AS n FROM worded x JOIN boiler b ON b.norm = x.norm AND b.source IS NOT DISTINCT FROM x.source GROUP BY x.doc_id),
m AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_boiler_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_boiler_words > 0 AND 100 * (n_words - n_boiler_words) < {quality.MIN_LEFT_PERCENT} * n_words) AS kept FROM m""",
    "op1_line_dedup": f"""WITH {_LINES}
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.r, 0) AS BIGINT) AS n_removed, sha256(coalesce(m.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE out) AS r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out) AS t FROM marked GROUP BY doc_id) m USING (doc_id)""",
    "op5_ann": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - b.e[i]) * (q.e[i] - b.e[i])))) AS score FROM v q JOIN v b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id AND len(b.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
}
