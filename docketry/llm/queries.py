"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bbit_minhash, byte_cnn, byte_pair, collocations, deobfuscate, divergence, mixing, rotation_codes, sanitise
from docketry.llm import source_audit, threshold_search, token_transducer, url_trees
from docketry.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it, in every text."""
    return sanitise.report(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances from the language's histograms, and the verdict on every text."""
    return divergence.judged(read(spark, sf_dir, "documents"))


def fold(parts: int) -> Column:
    """Remainder that deals ids to folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op3_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = deobfuscate.toxicity(read(spark, sf_dir, "documents"), labels, fold(5) != 0)
    return scored.withColumnRenamed("id", "doc_id").select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


# The rules of the contract.
URL_RULES = (
    url_trees.Rule("allow", "org", "/"), url_trees.Rule("block", "example.org", "/es/"),
    url_trees.Rule("block", "example.org", "/en/1"), url_trees.Rule("allow", "com", "/fr/"),
    url_trees.Rule("block", "com", "/de/"),
)


@query
def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_trees.judged(read(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


@query
def op5_byte_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    done = byte_pair.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.withColumnRenamed("id", "doc_id")


@query
def op6_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of vectors with cosine 0.98 or more under one label."""
    return rotation_codes.near_vectors(read(spark, sf_dir, "embeddings"), 0.98).withColumnRenamed("id", "vec_id")


@query
def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = byte_cnn.quality(read(spark, sf_dir, "documents"), labels, fold(4) != 2)
    return scored.withColumnRenamed("id", "doc_id").select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of texts on three-word shingles at similarity 0.85."""
    found = bbit_minhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    counts = token_transducer.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


ORACLES["op6_rotation_codes"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), unit AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM ok
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN part p ON p.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dealt row of a mixture at 97 % of the largest entropy."""
    dealt = mixing.report(read(spark, sf_dir, "documents"))
    source = F.when(F.col("source") != "none", F.expr("substring(source, 8)"))
    return dealt.select(F.col("id").cast("long").alias("doc_id"), source.alias("source"), "tokens", "mix_copy", "mix_order")


ORACLES["op10_mixing"] = """
WITH RECURSIVE slim AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'none') AS id, source AS name, coalesce('source ' || source, 'none') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents
), totals AS (
  SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM slim GROUP BY source HAVING sum(tokens) > 0
), whole AS (SELECT sum(tokens)::BIGINT AS t, count(*) AS k FROM totals),
shares AS (SELECT tokens / t::DOUBLE AS p FROM totals, whole),
entropy AS (  -- of the powered shares at 2^24 grid points, met by halving
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN h >= 0.97 * log2(k) THEN mid ELSE lo END, CASE WHEN h >= 0.97 * log2(k) THEN hi ELSE mid END
  FROM (SELECT e.step, e.lo, e.hi, (e.lo + e.hi) / 2 AS mid, w.k,
          (SELECT log2(sum(pow(p, (e.lo + e.hi) / 2))) - (e.lo + e.hi) / 2 * sum(pow(p, (e.lo + e.hi) / 2) * log2(p)) / sum(pow(p, (e.lo + e.hi) / 2)) FROM shares) AS h
        FROM entropy e, whole w) WHERE step < 24
), asis AS (SELECT log2(sum(p)) - sum(p * log2(p)) / sum(p) >= 0.97 * (SELECT log2(k) FROM whole) AS ok FROM shares),
mixed AS (
  SELECT CASE WHEN (SELECT ok FROM asis) OR (SELECT k FROM whole) < 2 THEN 1.0 ELSE floor(lo * 1e6) / 1e6 END AS a FROM entropy WHERE step = 24
), often AS (  -- the smallest source's repetition at an exponent, met by halving
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN many THEN mid ELSE lo END, CASE WHEN many THEN hi ELSE mid END
  FROM (SELECT o.step, o.lo, o.hi, (o.lo + o.hi) / 2 AS mid,
          (SELECT pow(min(p), (o.lo + o.hi) / 2 - 1) / sum(pow(p, (o.lo + o.hi) / 2)) > 4 FROM shares) AS many
        FROM often o) WHERE step < 24
), alpha AS (
  SELECT CASE WHEN (SELECT pow(min(p), min(a) - 1) / sum(pow(p, a)) > 4 FROM shares, mixed) THEN least(1.0, ceil((lo + pow(16.0, -6)) * 1e6) / 1e6)
    ELSE (SELECT a FROM mixed) END AS a
  FROM often WHERE step = 24
), norm AS (SELECT sum(pow(p, a)) AS s FROM shares, alpha),
quotas AS (
  SELECT source, tokens, n, round(pow(tokens / t::DOUBLE, a) / s * t)::BIGINT AS quota, ceil(n / 1024.0)::BIGINT AS blocks
  FROM totals, whole, alpha, norm
), sized AS (SELECT *, quota // tokens AS passes, quota % tokens AS rest FROM quotas),
placed AS (
  SELECT d.*, q.passes, q.rest, ('0x' || substr(md5('mix/block/' || d.id), 1, 15))::BIGINT % q.blocks AS block
  FROM slim d JOIN sized q USING (source)
), keyed AS (
  SELECT *, substr(md5('mix/order/' || (passes + 1) || '/' || source || '/' || block), 1, 16) || '/' || lpad(block::VARCHAR, 12, '0') AS block_key,
    substr(md5('mix/row/' || (passes + 1) || '/' || id), 1, 16) || '/' || id AS row_key
  FROM placed
), blocks AS (SELECT source, rest, block_key, sum(tokens) AS tokens FROM keyed GROUP BY ALL),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY block_key) AS upto FROM blocks),
cuts AS (SELECT source, min(block_key) AS cut_block, min_by(rest - upto + tokens, block_key) AS room FROM summed WHERE upto > rest GROUP BY source),
inside AS (
  SELECT k.source, k.row_key, c.room, sum(k.tokens) OVER (PARTITION BY k.source ORDER BY k.row_key) AS upto
  FROM keyed k JOIN cuts c ON c.source = k.source AND c.cut_block = k.block_key
), ends AS (SELECT source, max(row_key) AS cut_row FROM inside WHERE upto <= room GROUP BY source),
dealt AS (
  SELECT k.*, passes + CASE WHEN block_key < coalesce(cut_block, '') OR (block_key = cut_block AND row_key <= coalesce(cut_row, '')) THEN 1 ELSE 0 END AS copies
  FROM keyed k LEFT JOIN cuts USING (source) LEFT JOIN ends USING (source)
), spread AS (SELECT *, unnest(range(1, copies + 1))::INTEGER AS mix_copy FROM dealt)
SELECT doc_id, name AS source, tokens, mix_copy,
  substr(md5('mix/order/' || mix_copy || '/' || source || '/' || block), 1, 16) || '/' || lpad(block::VARCHAR, 12, '0') || '/'
  || substr(md5('mix/row/' || mix_copy || '/' || id), 1, 16) || '/' || id AS mix_order
FROM spread
"""

ORACLES["op2_divergence"] = """
WITH docs AS (SELECT doc_id, coalesce('language ' || lang, 'pooled') AS lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
shape AS (
  SELECT *, regexp_replace(text, '[a-z]+', '', 'g') AS t1 FROM docs
), shape2 AS (SELECT *, regexp_replace(t1, '[\\x20\\x09-\\x0D]+', '', 'g') AS t2 FROM shape),
shape3 AS (SELECT *, regexp_replace(t2, '[A-Z]+', '', 'g') AS t3 FROM shape2),
shape4 AS (SELECT *, regexp_replace(t3, '[0-9]+', '', 'g') AS t4 FROM shape3),
shape5 AS (SELECT *, regexp_replace(t4, '[.,;:!?''"()-]+', '', 'g') AS t5 FROM shape4),
shape6 AS (SELECT *, regexp_replace(t5, '[\\x00-\\x7F]+', '', 'g') AS t6 FROM shape5),
classed AS (
  SELECT doc_id, lang, text, words, [length(text) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4),
    length(t4) - length(t5), length(t5) - length(t6), length(t6)] AS classes FROM shape6
), each AS (SELECT lang, lower(w) AS w, count(*) AS n FROM (SELECT lang, unnest(words) AS w FROM docs) GROUP BY ALL),
counted AS (SELECT * FROM each WHERE lang <> 'pooled' UNION ALL SELECT 'pooled', w, sum(n)::BIGINT FROM each GROUP BY w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM counted),
tops AS (SELECT lang, list(w ORDER BY r) AS common, list(n ORDER BY r) AS ns, sum(n) AS listed FROM ranked WHERE r <= 20 GROUP BY lang),
sums AS (
  SELECT lang, sum(len(words)) AS total, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6]), sum(classes[7])] AS ref_classes
  FROM (SELECT * FROM classed WHERE lang <> 'pooled' UNION ALL SELECT * REPLACE ('pooled' AS lang) FROM classed) GROUP BY lang
), refs AS (SELECT lang, common, list_append(ns, (total - listed)::BIGINT) AS ref_words, ref_classes FROM sums JOIN tops USING (lang)),
hist AS (
  SELECT c.*, r.ref_classes, r.ref_words, list_transform(c.words, lambda w: lower(w)) AS lowered, r.common
  FROM (SELECT * REPLACE (CASE WHEN lang IN (SELECT lang FROM refs) THEN lang ELSE 'pooled' END AS lang) FROM classed) c JOIN refs r USING (lang)
), hist2 AS (
  SELECT *, list_transform(common, lambda k: len(list_filter(lowered, lambda w: w = k))) AS hits FROM hist
), hist3 AS (SELECT *, list_append(hits, len(words) - coalesce(list_sum(hits), 0)) AS own_words FROM hist2),
shares AS (
  SELECT *, list_transform(classes, lambda x: x / list_sum(classes)::DOUBLE) AS pc, list_transform(ref_classes, lambda x: x / list_sum(ref_classes)::DOUBLE) AS qc,
    list_transform(own_words, lambda x: x / list_sum(own_words)::DOUBLE) AS pw, list_transform(ref_words, lambda x: x / list_sum(ref_words)::DOUBLE) AS qw
  FROM hist3
), apart AS (
  SELECT *, list_sum(list_transform(list_zip(pc, qc), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2)) AS dc,
    list_sum(list_transform(list_zip(pw, qw), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2)) AS dw
  FROM shares
), windows AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS w3 FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)
), often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w3) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
dups AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
counts AS (
  SELECT a.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, CASE WHEN length(text) >= 200 THEN dc END AS class_distance,
    CASE WHEN len(words) >= 50 THEN dw END AS word_distance
  FROM apart a LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_distance, 0) <= 0.07 AND coalesce(word_distance, 0) <= 0.14 AS kept,
  class_distance, word_distance
FROM counts
"""

ORACLES["op8_bbit_minhash"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN part ON part.a = n.doc_id
"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two and three words."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
phrases AS (
  SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS (SELECT lang, m, phrase, count(*) AS f FROM phrases GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1)
), priced AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = c.x JOIN often r ON r.lang = c.lang AND r.phrase = c.y
), best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2], string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS phrase
    FROM often WHERE m = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= 2000
"""


@query
def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows by integer inner product, for every hundredth vector."""
    rows = read(spark, sf_dir, "embeddings")
    return threshold_search.top_k(rows, rows.where("vec_id % 100 = 0"), 10, 1024)


ORACLES["op12_threshold_search"] = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
  FROM ok q JOIN ok r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return source_audit.divergence(read(spark, sf_dir, "documents"))


ORACLES["op13_source_audit"] = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM docs),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(x.c, 0) AS c, 1 + ((1000000000::HUGEINT * (coalesce(x.c, 0) + 5)) // (gn.n + 5 * v.v))::BIGINT AS p,
    1 + ((1000000000::HUGEINT * (k.c + 5)) // (v.n + 5 * v.v))::BIGINT AS q
  FROM gn JOIN kept k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN counts x ON x.lang = gn.lang AND x.source = gn.source AND x.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) d ON d.lang = a.lang AND d.s = a.source AND d.t = b.source
), terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY rank <= 50
"""
