"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .conversations import damage, repair
from .decontamination import decontaminate
from .fingerprints import fingerprints
from .jaccard import jaccard_join
from .katz import score_text
from .licenses import scan_licenses
from .negatives import mine_negatives
from .packing import pack
from .pii import find_pii
from .quality import grade_quality
from .substrings import remove_repeats
from .tokens import token_counts
from .toxicity import score_toxicity


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_noisy_channel_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark, sf_dir):
    """Grades: 0 low quality, 1 good quality but toxic, 2 good quality and not toxic.

    They are steps of one scale, of how much one would want a document in a
    training corpus: a text of low quality teaches nothing, whatever its tone.
    """
    grade = F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic"))
    return grade_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))


def op7_katz_backoff_scores(spark, sf_dir):
    return score_text(table(spark, sf_dir, "documents"))


def op8_anchor_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents")).drop("marks")


def op9_merkle_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items", "ranges")


def op11_conversation_repair(spark, sf_dir):
    return repair(damage(table(spark, sf_dir, "conversations")), copies=F.col("copies"), gone=F.col("gone"))


def op12_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("notices")


def op13_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_noisy_channel_toxicity, op3_suffix_array_dedup, op4_token_counts, op5_best_fit_packing, op6_ordinal_quality, op7_katz_backoff_scores, op8_anchor_pii, op9_merkle_fingerprints, op10_benchmark_decontamination, op11_conversation_repair, op12_license_scan, op13_hard_negatives)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: For tables whose doc_id is unique and never null.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(x.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id, coalesce(l.n, 0) AS n_links FROM documents d LEFT JOIN sizes x USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1) l USING (doc_id)""",
    "op10_benchmark_decontamination": rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, places.n, i, item FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)""",
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.r AS a, a.id AS anchor_id, a.label AS own, b.r, b.id, b.label, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.r <> b.r WHERE a.id % 100 = 0),
p AS (SELECT * FROM scored WHERE own = label QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, id, r) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.s AS positive_score, n.id AS negative_id, n.s AS negative_score, row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.s DESC, n.id, n.r) AS rank
FROM p JOIN scored n ON p.a = n.a AND n.label <> n.own AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
