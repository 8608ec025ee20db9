"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import table
from . import bestfit, fingerprint, jaccard, langid, mixing, nearest, negatives, packing, phrases, pieces, pii, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op8_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(len(regexp_replace(text, '[^\p{L}\x20\x09-\x0D]+', '', 'g')) / nullif(len(text), 0), 0.0) + 0.1 AS quality,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w
  FROM rows GROUP BY source),
levels AS (
  -- at a level, each source has the smaller of its limit and level * weight; the level that uses up everything lies
  -- where the first k sources, by limit per weight, are at their limits
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, 3.0 * source_size / w) AS level FROM levels WHERE level * w <= 3.0 * source_size),
targets AS (
  SELECT source, source_size, least(3.0 * source_size, level * w)::DOUBLE AS target
  FROM sources, chosen),
ordered AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY r.source ORDER BY -ln(u) / quality, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)))::BIGINT AS taken
FROM ordered
"""


@query
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = pieces.byte_level_pieces(tokenizer_file("byte_bpe_50k.json"))
    return pieces.count_pieces(table(spark, sf, "documents"), vocabulary)


@query
def op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL["op9_nearest"] = """
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held_out = F.coalesce(langid.fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.train(docs.where(~held_out), labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf, "documents"))
    base_sha256 = F.sha2(pii.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *pii.counts(F.col("base")), base_sha256, pii.written(F.col("spans")).alias("spans"))


@query
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    classes = jaccard.near_duplicates(table(spark, sf, "documents"), shingle=3, num=90, den=100)
    return classes.select("doc_id", "n_shingles", "component_id")


@query
def op11_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    packed = bestfit.pack_best_fit(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


SQL["op12_hard_negatives"] = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_reduce(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]), lambda x, y: x + y)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(table(spark, sf, "documents")))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, phrase, any_value(k) AS words, count(*)::BIGINT AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
joint AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE words > 1),
cuts AS (
  SELECT j.lang, j.phrase, j.f AS a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * j.f) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM joint) j
  JOIN counted l ON l.lang = j.lang AND l.phrase = array_to_string(j.w[1:j.k], ' ')
  JOIN counted r ON r.lang = j.lang AND r.phrase = array_to_string(j.w[j.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, f AS longer
  FROM (SELECT *, unnest(range(2, words)) AS size FROM joint), (SELECT unnest([1, 2, 3]) AS i) WHERE i + size - 1 <= words),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY lang, phrase),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank
  FROM lowest c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM ranked q JOIN totals t ON t.lang = q.lang WHERE rank <= 2000
"""
