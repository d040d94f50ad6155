"""The registered queries of this folder and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, hard_negatives, html_extract, language_id, mixing, near_copies, nearest, piece_sampling, shards, spelling, syncmers, url_reputation, warc,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op5_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(body) DESC, doc_id)
"""


@register
def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@register
def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES).drop("bad_bound")


def _strength_sql(n: str, k: str, kk: str, nn: str, c: str) -> str:
    mu = f"({k}::DOUBLE / {n})"
    noise = f"({mu} * (1 - {mu}))"
    room = f"({n} - {nn} / {n} - ({c} - 1))"
    rho = f"(({kk} - {k} * {mu} - {noise} * ({c} - 1)) / ({noise} * {room}))"
    held = f"greatest(least({rho}, 0.5::DOUBLE), 1.0::DOUBLE / 10001)"
    return f"CASE WHEN {c} > 2 AND {n} > 0 AND {noise} > 0 AND {room} > 0 THEN (1 - {held}) / {held} ELSE 10.0::DOUBLE END"


_SUMS = "coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS k, sum(CASE WHEN n > 0 THEN k::DOUBLE * k / n ELSE 0 END) AS kk, sum(n::DOUBLE * n) AS nn, count(CASE WHEN n > 0 THEN 1 END) AS c"
_TWO = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)

ORACLES["op6_host_reputation"] = f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1, 's'), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)),
outcomes AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM parsed LEFT JOIN outcomes ON page_id = doc_id GROUP BY host),
named AS (
  SELECT host, n, k, list_reverse(string_split(bare, '.')) AS p, bare, regexp_matches(bare, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(bare, '[') AS address
  FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM counted)),
hosts AS (
  SELECT host, n, k, CASE WHEN address THEN '{url_reputation.ADDRESS}' WHEN two IN ({_TWO}) THEN two ELSE p[1] END AS suffix,
         CASE WHEN address THEN bare WHEN two IN ({_TWO}) AND len(p) > 2 THEN p[3] || '.' || two ELSE two END AS domain
  FROM (SELECT *, CASE WHEN len(p) > 1 THEN p[2] || '.' || p[1] ELSE p[1] END AS two FROM named)),
domains AS (SELECT domain, suffix, {_SUMS} FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, {_SUMS} FROM domains GROUP BY suffix),
whole AS (SELECT {_SUMS} FROM suffixes),
tops AS (
  SELECT s.suffix, {_strength_sql('s.n', 's.k', 's.kk', 's.nn', 's.c')} AS domain_strength,
         (s.k + (w.k + 1) / (w.n + 2)::DOUBLE * w.m) / (s.n + w.m) AS suffix_mean
  FROM suffixes s, (SELECT *, {_strength_sql('n', 'k', 'kk', 'nn', 'c')} AS m FROM whole) w),
middle AS (
  SELECT d.domain, (d.k + suffix_mean * domain_strength) / (d.n + domain_strength) AS mean, {_strength_sql('d.n', 'd.k', 'd.kk', 'd.nn', 'd.c')} AS m
  FROM domains d JOIN tops USING (suffix)),
scored AS (
  SELECT host, n, k, k + mean * m AS a, n - k + (1 - mean) * m AS b FROM hosts JOIN middle USING (domain)),
judged AS (
  SELECT host, n, k, a / (a + b) - {url_reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {url_reputation.MAX_BAD} AS bad FROM scored),
rules(action, h, p) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}),
ruled AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, n AS host_labelled, k AS host_bad
FROM parsed JOIN judged USING (host) LEFT JOIN ruled USING (host, path)
"""


@register
def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are replicated and shuffled; each copy's text is checked where it arrives."""
    docs = table(spark, sf_dir, "documents")
    return mixing.checked_mixture(docs, mixing.source_rates(docs)).select("doc_id", "source", "copy", "copies", "order_key")


ORACLES["op7_poisson_mix"] = """
WITH sizes AS (
  SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1),
rates AS (
  SELECT s, CASE WHEN chars > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM sizes WHERE chars > 0) * (SELECT sum(chars) FROM sizes)::DOUBLE / chars ELSE 0 END AS rate
  FROM sizes),
steps AS (
  SELECT s, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS upto
  FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM rates WHERE rate > 0)),
lists AS (SELECT s, list(upto ORDER BY upto) AS upto FROM steps GROUP BY s),
drawn AS (
  SELECT doc_id, source, coalesce(source, '') AS s, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
counted AS (
  SELECT doc_id, source, len(list_filter(upto, lambda c: c <= u))::BIGINT AS copies FROM drawn JOIN lists USING (s)),
many AS (SELECT doc_id, source, copies, unnest(range(1, copies + 1))::BIGINT AS copy FROM counted WHERE copies > 0)
SELECT doc_id, source, copy, copies,
       ('0x' || substr(md5('order0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS order_key
FROM many
"""


@register
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


_CHARS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

ORACLES["op10_warc"] = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, max(page_id) AS first_id FROM hashed GROUP BY h)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, true AS digest_ok
FROM hashed JOIN firsts USING (h)
"""


@register
def op8_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@register
def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.digests(table(spark, sf_dir, "documents"))


@register
def op2_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register
def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


@register
def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copy_classes(table(spark, sf_dir, "documents"))


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""


@register
def op12_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_report(table(spark, sf_dir, "documents"))


@register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte over a table that follows from the polynomial; near words by deleting or masking one place of each.
ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE crc_steps(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{spelling.LETTERS}]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run
  FROM documents),
digits AS (SELECT run, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= 6),
coded AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM digits, crc_table),
words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM coded)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
shorter AS (SELECT DISTINCT c.word AS x, c.n AS xn, w.word AS y, w.n AS yn FROM cuts c JOIN words w ON w.word = c.a || c.b),
near AS (
  SELECT x, y, yn FROM shorter UNION ALL SELECT y, x, xn FROM shorter
  UNION ALL SELECT c.word, d.word, d.n FROM cuts c JOIN cuts d ON c.i = d.i AND c.a = d.a AND c.b = d.b AND c.word <> d.word),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY yn DESC, encode(y)) AS y, max(yn) AS yn FROM near GROUP BY x),
told AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN yn >= 5 * n THEN y END AS form, CASE WHEN yn >= 5 * n THEN yn END AS form_n
  FROM words LEFT JOIN best ON word = x),
chain(word, here, next) AS (
  SELECT word, word, form FROM told
  UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.next)
SELECT t.word, form, here AS root, n, n_near, form_n FROM told t JOIN chain c ON c.word = t.word AND c.next IS NULL
"""
