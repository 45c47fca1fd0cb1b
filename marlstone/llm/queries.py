"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, jaccard_join, license_scan, license_templates, line_dedup, lm_scoring, packing, quality_rules, substring_dedup, token_counts, toxicity, warc
from .common import crc_fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.fit_budget(token_counts.prefix_counts(_read(spark, sf_dir, "documents")), 2048)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_read(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5) != 1)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = packing.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), words="n")
    return packing.best_fit(docs, F.col("n"), F.col("source"), F.col("cluster"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    fold = crc_fold(F.col("doc_id"), 4)
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(fold != 2)))
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6 SQL can state."""
    return op6_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can state of documents: their words, and the pieces they are cut into."""
    return op2_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_words"), F.count("bin").alias("n_pieces"))


def packing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can state of bins: none is overfull, has a gap between pieces, two pieces of one source or of equal texts; all words are in them."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    placed = op2_packing(spark, sf_dir).where("bin is not null").join(docs, "doc_id")
    bins = placed.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count("source").alias("pieces"), F.countDistinct("source").alias("sources"), F.count("digest").alias("texts"), F.countDistinct("digest").alias("digests"))
    wrong = {"overfull": F.col("n") > packing.CAPACITY, "gaps": F.col("n") != F.col("end"), "conflicts": F.col("pieces") != F.col("sources"), "copies": F.col("texts") != F.col("digests")}
    return bins.agg(*[F.count_if(c).alias(k) for k, c in wrong.items()], F.sum("n").alias("n_words"), F.sum("texts").alias("n_pieces"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    return filter_audit.filter_audit(_read(spark, sf_dir, "documents"), filter_audit.text_conditions(F.col("text")), _read(spark, sf_dir, "labels"), flags, duplicates="E")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


QUERIES = {"op1_decontamination": op1_decontamination, "op2_packing": op2_packing, "op7_line_dedup": op7_line_dedup, "op3_toxicity": op3_toxicity, "op4_substring_dedup": op4_substring_dedup, "op6_lm_scoring": op6_lm_scoring, "op5_token_counts": op5_token_counts, "op8_quality_rules": op8_quality_rules, "op9_warc": op9_warc, "op10_jaccard_join": op10_jaccard_join}
QUERIES |= {"op11_filter_audit": op11_filter_audit, "op12_license_scan": op12_license_scan}
QUERIES |= {"lm_base_scores": lm_base_scores, "packing_totals": packing_totals, "packing_bins": packing_bins}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS stays,
         translate(array_to_string(list_transform(range(8), lambda i: to_base(('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT, 32, 4)), ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stays THEN stays END AS refers_to
FROM d
"""

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM s),
f AS (SELECT t, min(doc_id) AS least FROM x GROUP BY t HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (t) WHERE doc_id > least),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ITEM_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {ITEM_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT item_id, array_to_string(w, ' ') AS t, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION
  SELECT item_id, array_to_string(w[i:i + 9], ' '), 10 FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, t)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

ORACLE_SQL["op8_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM documents),
x AS (SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, t FROM x GROUP BY doc_id, t HAVING count(*) > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM x JOIN r USING (doc_id, t)) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len([x FOR x IN w IF regexp_matches(x, '\\pL')]) AS n_alphabetic,
         len([x FOR x IN w IF list_contains({quality_rules.STOP_WORDS!r}, lower(x))]) AS n_stop,
         len([x FOR x IN lines IF regexp_matches(x, '(\\.\\.\\.|…)\\s*$')]) AS n_ellipsis,
         len([x FOR x IN lines IF regexp_matches(x, '^\\s*[-*•]')]) AS n_bullet
  FROM d LEFT JOIN c USING (doc_id)
), s AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
         CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_repeat_words::DOUBLE / n_words END AS repeat_word_ratio,
         CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE word_chars::DOUBLE / n_words END AS mean_word_chars,
         CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_symbols::DOUBLE / n_words END AS symbol_ratio,
         CASE WHEN n_lines = 0 THEN 0.0::DOUBLE ELSE n_dup_lines::DOUBLE / n_lines END AS dup_line_ratio,
         CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_alphabetic::DOUBLE / n_words END AS alphabetic_ratio,
         CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_stop::DOUBLE / n_words END AS stop_word_ratio,
         CASE WHEN n_lines = 0 THEN 0.0::DOUBLE ELSE n_ellipsis::DOUBLE / n_lines END AS ellipsis_line_ratio,
         CASE WHEN n_lines = 0 THEN 0.0::DOUBLE ELSE n_bullet::DOUBLE / n_lines END AS bullet_line_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
)
SELECT *, NOT base_failed AND n_words >= 50 AND repeat_word_ratio <= 0.5 AND mean_word_chars BETWEEN 2 AND 16 AND symbol_ratio <= 0.1 AND alphabetic_ratio >= 0.7
       AND stop_word_ratio >= 0.05 AND dup_line_ratio <= 0.5 AND ellipsis_line_ratio <= 0.3 AND bullet_line_ratio <= 0.9 AS kept
FROM s
"""

ORACLE_SQL["op10_jaccard_join"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w, ' ') AS g FROM t WHERE len(w) BETWEEN 1 AND 4
  UNION
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT x, y FROM e WHERE y < x UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
"""

# a repeated run of any length is made of repeated lines, and a repeated line is a run
ORACLE_SQL["op7_line_dedup"] = """
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM raw),
l AS (SELECT doc_id, p, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded FROM l0),
m AS (SELECT *, worded AND row_number() OVER (PARTITION BY line ORDER BY doc_id, p) > 1 AS gone FROM l)
SELECT doc_id, count(*) FILTER (worded)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# crc32 by bits, as SQL has none: the remainder of the text's bytes by the fixed polynomial
CRC_SQL = "list_reduce(list_prepend(4294967295, list_transform(range(len({0})), lambda i: ascii({0}[i + 1])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"

ORACLE_SQL["lm_base_scores"] = f"""
WITH d AS (SELECT doc_id, xor({CRC_SQL.format('(doc_id::VARCHAR)')}, 4294967295) % 5 = 1 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d), c AS (SELECT token, count(*)::DOUBLE AS c FROM t WHERE NOT held_out GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 5) AS base_score
FROM t LEFT JOIN c USING (token), n GROUP BY doc_id
"""

ORACLE_SQL["packing_totals"] = f"SELECT doc_id, len({WORDS_SQL})::BIGINT AS n_words, ceil(len({WORDS_SQL}) / 2048.0)::BIGINT AS n_pieces FROM documents"

ORACLE_SQL["packing_bins"] = f"SELECT 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS conflicts, 0::BIGINT AS copies, sum(len({WORDS_SQL}))::BIGINT AS n_words, sum(ceil(len({WORDS_SQL}) / 2048.0))::BIGINT AS n_pieces FROM documents"

ORACLE_SQL["op11_filter_audit"] = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM t LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(f, b)),
o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM f v, f w, f x, f y, f z
  WHERE v.b | w.b | x.b | y.b | z.b = 31
), s AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (mask & (before | b) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & b > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & b > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & b > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r
"""


def _license_sql() -> str:
    """Phrases by position; templates as regular expressions over the joined words, one for each section's end."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    at = lambda p: "[i - 1 FOR i IN range(1, len(w) + 1) IF " + " AND ".join(f"w[i + {k}] = {quoted(x)}" for k, x in enumerate(p.split())) + "]"
    places = ", ".join(f"{at(p)} AS p{k}" for k, p in enumerate(license_templates.PHRASES))
    all_places = " || ".join(f"p{k}" for k in range(len(license_templates.PHRASES)))
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {quoted(x)} END" for k, x in enumerate(license_templates.PHRASES.values()))
    accepted, shares = [], []
    for label, markup in license_templates.TEMPLATES:
        ends = [(f"regexp_matches(t, {quoted('(?:^| )' + license_scan.pattern(tree))})", share) for tree, share in license_scan.sections(license_scan.parse(markup))]
        accepted.append(f"CASE WHEN {ends[-1][0]} THEN {quoted(label)} END")
        shares.append("CASE " + " ".join(f"WHEN {test} THEN {share!r}::DOUBLE" for test, share in reversed(ends)) + " ELSE 0.0::DOUBLE END")
    return f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w)::BIGINT AS n_words, array_to_string(w, ' ') || ' ' AS t, {places} FROM d),
l AS (SELECT *, {all_places} AS places, [x FOR x IN [{named}] IF x IS NOT NULL] AS base, [x FOR x IN [{", ".join(accepted)}] IF x IS NOT NULL] AS found, greatest({", ".join(shares)}) AS score FROM p)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || found)), ',') AS labels, score
FROM l
"""


ORACLE_SQL["op12_license_scan"] = _license_sql()
