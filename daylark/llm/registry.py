"""The numbered corpus queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from daylark.llm import collocation, exact_dedup, fillmiddle, groupjoin, langid, lmscore, mixing, quality, secrets, simhash, sptok, toxicity, warc
from daylark.llm.common import crc_bucket, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("digest", F.lower(F.hex("digest"))).withColumnRenamed("digest", "text_sha256")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
x AS (SELECT h, first, sha1(h) AS hex FROM g),
b AS (
  SELECT h, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY k) AS digest
  FROM (
    SELECT h, first, k, list_sum([
      (('0x' || substr(hex, 1 + (5 * k + j) // 4, 1))::INT >> (3 - (5 * k + j) % 4) & 1) * (16 >> j) FOR j IN range(5)
    ])::INT AS v
    FROM x, range(32) AS r(k)
  ) GROUP BY h, first
)
SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM b.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM b.first THEN b.first END AS refers_to
FROM p JOIN b USING (h)
"""


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, g.text_sha256
FROM d JOIN g USING (t)
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (SELECT rn, k, words[k : k + 7] AS w FROM (SELECT rn, words, unnest(range(1, len(words) - 6)) AS k FROM d WHERE len(words) > 8)),
twice AS (SELECT rn, k FROM (SELECT rn, k, count(*) OVER (PARTITION BY rn, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rn, count(DISTINCT place) AS n FROM (SELECT rn, unnest(range(k, k + 8)) AS place FROM twice) GROUP BY rn),
most AS (SELECT rn, max(n) AS n FROM (SELECT rn, word, count(*) AS n FROM (SELECT rn, unnest(words) AS word FROM d) GROUP BY ALL) GROUP BY rn),
pairs AS (SELECT rn, count(*) AS n FROM (SELECT rn, words, unnest(range(2, len(words) + 1)) AS k FROM d) WHERE words[k] = words[k - 1] GROUP BY rn),
q AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS marks, coalesce(most.n, 0) AS most, coalesce(pairs.n, 0) AS pairs, octet_length(encode(t)) AS size,
    coalesce(list_sum(list_transform(lines, lambda x: octet_length(encode(x)))) - list_sum(list_transform(list_distinct(lines), lambda x: octet_length(encode(x)))), 0) AS again
  FROM d LEFT JOIN repeats USING (rn) LEFT JOIN most USING (rn) LEFT JOIN pairs USING (rn)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * again > 3 * size OR (upper > 20 AND 2 * upper > letters)
    OR 10 * marks > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * letters < word_chars OR 10 * pairs > 3 * n_words
    OR 10 * most > 3 * n_words) AS kept
FROM q
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, ["doc_id"], langid.train(docs))
    held_out = crc_bucket("doc_id", langid.FOLDS) == langid.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payload, measured anew; revisits by their headers alone."""
    path = warc.archive_pages(table(spark, sf_dir, "pages"))
    heads = "record_id string, record_type string, refers_to string"
    full = warc.read_records(spark, path, f"{heads}, payload_length long, payload_sha1 string")
    bare = warc.read_records(spark, path, f"{heads}, http_length long, payload_digest string")
    both = (
        full.where("record_type = 'response'")
        .toDF("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
        .unionAll(bare.where("record_type = 'revisit'"))
    )
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return both.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_texts(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sptok.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"], model, from_files=True)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled"
    )


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rn,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT rn, array_to_string(words[k : k + 4], ' ') AS shingle FROM (SELECT rn, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM d WHERE len(words) > 0)
),
sizes AS (SELECT rn, count(*) AS n FROM shingles GROUP BY rn),
shared AS (SELECT a.rn AS x, b.rn AS y, count(*) AS s FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rn <> b.rn GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.rn = x JOIN sizes b ON b.rn = y WHERE 100 * s >= 80 * (a.n + b.n - s)),
reached AS (SELECT rn AS x, rn AS y FROM d UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes USING (rn) JOIN (SELECT x, min(doc_id) AS component_id FROM reached JOIN d ON d.rn = y GROUP BY x) c ON c.x = d.rn
"""


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, w[i : i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) AS r(k))
  GROUP BY ALL HAVING count(*) >= 30
),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, 2000000::HUGEINT * c.f // (x.f + y.f) AS score, k
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, g[i : i + m - 1] AS g, max(f) AS held FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM f, range(2, 4) AS r(m) WHERE m < len(g)) GROUP BY ALL
),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts h ON h.lang = b.lang AND h.g = b.g WHERE h.held IS NULL OR 100 * h.held < 80 * b.a),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
e AS (SELECT *, len(u) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS v FROM d),
c AS (
  SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS lo, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v[3] % 100 >= 100 THEN 'plain' WHEN v[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM e
),
x AS (
  SELECT *, coalesce(array_to_string(u[1 : lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1 : hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1 : n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x
"""


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fillmiddle.transformed(table(spark, sf_dir, "documents"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fillmiddle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def queries():
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_toxicity, op3_language_id, op4_warc, op5_quality_rules, op6_lm_score, op7_secret_scan, op8_sentencepiece,
        op9_simhash_near_dedup, op10_source_mixing, op11_ngram_jaccard_join, op12_phrase_collocations, op13_fill_in_middle,
    )}


def oracle_sql():
    return {
        "op1_exact_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op5_quality_rules": OP5_SQL, "op11_ngram_jaccard_join": OP11_SQL,
        "op12_phrase_collocations": OP12_SQL, "op13_fill_in_middle": OP13_SQL,
    }
