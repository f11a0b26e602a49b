"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwise.llm import (
    bpe, fingerprints, langid, language_model, mixing, neardup, phrases, quality, token_files, topk, toxicity, tries,
    unigram)
from termwise.llm.texts import remainder, table
from termwise.session import scratch_path

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, WORD_BPE, PIECES = (f"{TOKENIZERS}/{x}" for x in
                              ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
END_ID = 2


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    model = language_model.fit(docs.filter(~held_out))
    return language_model.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    rules = bpe.automaton(tokenizer)
    return bpe.round_trip(table(spark, sf_dir, "documents"), rules, ["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.fit(toxicity.labelled(docs, labels))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = WORD_BPE) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer, path, END_ID)
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return quality.apply_policy(quality.apply_policy(rows, 1, "passes_base")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        (~F.col("passes_base")).alias("base_failed"), "kept")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, keep=["doc_id"])


def op9_token_counts(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    counter = unigram.Counter(*unigram.vocabulary(model))
    return unigram.token_counts(table(spark, sf_dir, "documents"), counter, ["doc_id"])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_size(table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    mixed = mixing.mix(mixing.written(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tries.sequences(table(spark, sf_dir, "conversations"))
    return tries.trie(tries.with_shared_openings(found))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_rules": op7_quality_rules,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_counts": op9_token_counts,
    "op10_top_k": op10_top_k,
    "op11_fingerprints": op11_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
}

OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, rid, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
starts AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS times FROM starts),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)),
f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
    + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(2 * n_dup_lines > n_lines AS BIGINT)
    + 16 * CAST(n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept FROM f
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][(nth - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS most FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target,
         CAST(('0x' || substr(md5('mix|' || coalesce('s' || source, 'n')), 1, 4)) AS INTEGER)
           / CAST(65536 AS DOUBLE) AS shift FROM l),
k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM d),
r AS (
  SELECT k.*, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(shift + (k + 1) * rate) - floor(shift + k * rate) AS BIGINT) * size AS taken FROM r
"""

OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e,
         row_number() OVER () AS rid
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT rid, vec_id, i, e[i] AS x FROM (SELECT rid, vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM v)),
q AS (
  SELECT DISTINCT ON (vec_id) vec_id, e FROM v WHERE vec_id % 50 = 0),
qc AS (
  SELECT vec_id AS query_id, i, e[i] AS y FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM q)),
s AS (
  SELECT query_id, rid, any_value(vec_id) AS vec_id, CAST(sum(x * y) AS BIGINT) AS score
  FROM qc JOIN c USING (i) WHERE query_id <> vec_id GROUP BY query_id, rid)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(r) || ':' || r || x) AS key, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
s AS (
  SELECT conv_id, list({'key': key, 'words': words} ORDER BY turn NULLS FIRST, key) AS own FROM t GROUP BY conv_id),
b AS (
  SELECT conv_id, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(c) + 1), lambda i:
           [CAST(ord(substr(c, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS c FROM s)),
h AS (
  SELECT conv_id, xor(list_reduce(steps, lambda c, y: CASE WHEN y >= 0 THEN xor(c, y)
           ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h FROM b),
r AS (
  SELECT s.conv_id, list_concat(coalesce(o.own, [])[1:h], s.own[h + 1:]) AS own
  FROM s JOIN h USING (conv_id) LEFT JOIN s AS o ON o.conv_id = s.conv_id - s.conv_id % 20),
p AS (
  SELECT conv_id, d, len(own) AS size, CASE WHEN d = 0 THEN 0 ELSE own[d].words END AS words,
         sha256(array_to_string(list_transform(own[1:d], lambda y: y.key), ',')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(own[1:d - 1], lambda y: y.key), ',')) END AS above
  FROM (SELECT *, unnest(range(0, len(own) + 1)) AS d FROM r)),
n AS (
  SELECT node, any_value(above) AS above, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d) AS ids
  FROM p GROUP BY node),
k AS (
  SELECT n.*, coalesce(c, 0) AS n_children FROM n LEFT JOIN (
    SELECT above AS node, count(*) AS c FROM n WHERE above IS NOT NULL GROUP BY above) USING (node)),
u AS (
  SELECT DISTINCT x.node AS top, y.node FROM p AS x JOIN p AS y ON x.conv_id = y.conv_id AND x.d <= y.d),
a AS (
  SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM u JOIN k USING (node) GROUP BY top)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens,
       sha256(coalesce(k.ids, '')) AS ends_sha256
FROM k JOIN a ON top = k.node LEFT JOIN k AS q ON q.node = k.above
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
f AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k AS size, count(*) AS a
  FROM w, range(1, 6) AS t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (
  SELECT * FROM f WHERE size > 1 AND a >= 100),
wide AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS y WHERE y.lang = c.lang AND y.size > c.size AND 100 * y.a >= 100 * c.a
      AND contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM wide)),
s AS (
  SELECT cuts.*, fl.a AS l, fr.a AS r, n, (1000 * CAST(cuts.a AS HUGEINT) * n) // (CAST(fl.a AS HUGEINT) * fr.a) AS score
  FROM cuts JOIN t USING (lang) JOIN f AS fl ON fl.lang = cuts.lang AND fl.phrase = lp
  JOIN f AS fr ON fr.lang = cuts.lang AND fr.phrase = rp),
b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000
"""

ORACLES = {"op10_top_k": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_phrases": OP13_SQL,
            "op7_quality_rules": OP7_SQL, "op8_mix_sources": OP8_SQL}
