"""Registered queries of the text operators, with their DuckDB SQL where SQL can express them.

Queries without SQL (op1, op2, op4, op7 to op13 and pipeline) are tested against brute force or a round trip in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, huffman_ids, licenses, line_join, minhash_hamming, mpeg, packing, period_runs, ppm_langid, spaced_seeds, suffix_repeats, token_align, url_reputation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_digest(table(spark, sf_dir, "documents"))


def op4_bpe_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences (licence sentences), n_rules (rules that fit), licenses and license_ids as lists joined by commas."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_rules", F.concat_ws(",", "licenses").alias("licenses"), F.concat_ws(",", "license_ids").alias("license_ids"))


#: The rules of the url query.
URL_RULES = [
    url_reputation.Rule("block", "com", "/en/"),
    url_reputation.Rule("allow", "example.com", "/en/7"),
    url_reputation.Rule("allow", "net", "/de/"),
    url_reputation.Rule("block", "example.net", "/de/8"),
    url_reputation.Rule("block", "org", "/es/"),
]


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: the label of the document of the same number; bad if its quality is 0 or it is toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES).drop("bad_bound")


def _license_sql() -> str:
    """The same scan in DuckDB: sentences, normalisation, identifiers, then the rules one after the other."""
    case = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{name}'" for name, p in licenses.SENTENCES)
    line = "line"
    for name, ids in licenses.RULES:
        line = f"replace({line}, '|{'||'.join(ids)}|', '|+{name}|')"
    hint = licenses.HINT.removeprefix("(?i)")
    return f"""
    WITH cut AS (
        SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '([.;:]) +', '\\1' || chr(10), 'g'), '(^|[^\\p{{L}}\\p{{N}}_])([vV]\\.)\\n', '\\1\\2 ', 'g'), chr(10))) AS s,
            generate_subscripts(string_split(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '([.;:]) +', '\\1' || chr(10), 'g'), '(^|[^\\p{{L}}\\p{{N}}_])([vV]\\.)\\n', '\\1\\2 ', 'g'), chr(10)), 1) AS i
        FROM documents WHERE regexp_matches(text, '(?i){hint}')
    ), plain AS (
        SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '^[\\s/*#;%!>-]*(\\(?[0-9a-z][.)]\\s)?', ''), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.+(\\s|$)', '\\1', 'g')) AS s
        FROM cut WHERE regexp_matches(s, '(?i){hint}')
    ), known AS (SELECT doc_id, i, CASE {case} END AS id FROM plain),
    lines AS (SELECT doc_id, '|' || string_agg(id, '||' ORDER BY i) || '|' AS line, string_agg(id, ',' ORDER BY i) AS license_ids, count(id) AS n FROM known WHERE id IS NOT NULL GROUP BY doc_id),
    hits AS (SELECT doc_id, license_ids, n, regexp_extract_all({line}, '\\|\\+([^|]+)\\|', 1) AS hits FROM lines)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(len(hits), 0) AS BIGINT) AS n_rules,
        coalesce(array_to_string(list_sort(list_distinct(hits)), ','), '') AS licenses, coalesce(license_ids, '') AS license_ids
    FROM documents d LEFT JOIN hits USING (doc_id)
    """


_SECOND = ", ".join(f"'{s}'" for s in url_reputation.SECOND_LEVEL)
_URL_SQL = f"""
    WITH urls AS (
        SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
            CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
        FROM pages
    ), marks AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
    counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM urls LEFT JOIN marks USING (page_id) GROUP BY host),
    parts AS (SELECT *, string_split(host, '.') AS p FROM counted),
    hosts AS (SELECT host, n, bad, array_to_string(p[-2:], '.') IN ({_SECOND}) AND len(p) > 2 AS two, p FROM parts),
    h AS (SELECT host, n, bad, CASE WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain, CASE WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM hosts),
    d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
    s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
    top AS (SELECT (sum(bad) + 0.1 * 10) / (sum(n) + 10) AS m FROM s),
    s1 AS (SELECT suffix, n, bad, m FROM s, top),
    sw AS (SELECT CASE WHEN spread > 0 AND (ss - (c - 1) * m * (1 - m)) / spread > 0 THEN greatest(2, least(200, m * (1 - m) / ((ss - (c - 1) * m * (1 - m)) / spread) - 1)) ELSE 200 END AS w
        FROM (SELECT any_value(m) AS m, count(*) AS c, sum(n) - sum(n * n) / sum(n)::DOUBLE AS spread, sum(n * (bad / n - m) * (bad / n - m)) AS ss FROM s1 WHERE n > 0)),
    s2 AS (SELECT suffix, (bad + w * m) / (n + w) AS m FROM s1, sw),
    d1 AS (SELECT d.suffix, domain, n, bad, m FROM d JOIN s2 USING (suffix)),
    dw AS (SELECT suffix, CASE WHEN spread > 0 AND (ss - (c - 1) * m * (1 - m)) / spread > 0 THEN greatest(2, least(200, m * (1 - m) / ((ss - (c - 1) * m * (1 - m)) / spread) - 1)) ELSE 200 END AS w
        FROM (SELECT suffix, any_value(m) AS m, count(*) AS c, sum(n) - sum(n * n) / sum(n)::DOUBLE AS spread, sum(n * (bad / n - m) * (bad / n - m)) AS ss FROM d1 WHERE n > 0 GROUP BY suffix)),
    d2 AS (SELECT d1.suffix, domain, (bad + coalesce(w, 200) * m) / (n + coalesce(w, 200)) AS m FROM d1 LEFT JOIN dw USING (suffix)),
    h1 AS (SELECT h.*, m FROM h JOIN d2 USING (suffix, domain)),
    hw AS (SELECT suffix, domain, CASE WHEN spread > 0 AND (ss - (c - 1) * m * (1 - m)) / spread > 0 THEN greatest(2, least(200, m * (1 - m) / ((ss - (c - 1) * m * (1 - m)) / spread) - 1)) ELSE 200 END AS w
        FROM (SELECT suffix, domain, any_value(m) AS m, count(*) AS c, sum(n) - sum(n * n) / sum(n)::DOUBLE AS spread, sum(n * (bad / n - m) * (bad / n - m)) AS ss FROM h1 WHERE n > 0 GROUP BY suffix, domain)),
    ab AS (SELECT host, bad + coalesce(w, 200) * m AS a, n - bad + coalesce(w, 200) * (1 - m) AS b FROM h1 LEFT JOIN hw USING (suffix, domain)),
    bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_bound FROM ab),
    ruled AS (SELECT *, CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM urls)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled LEFT JOIN bound USING (host)
"""

QUERIES = {
    "op2_mpeg_media": op2_mpeg_media,
    "op4_bpe_two_tier": op4_bpe_two_tier,
    "op5_license_sentences": op5_license_sentences,
    "op6_url_reputation": op6_url_reputation,
}
ORACLES = {"op5_license_sentences": _license_sql(), "op6_url_reputation": _URL_SQL}


def op7_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op7_minhash_hamming"] = op7_minhash_hamming


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_langid.identify(table(spark, sf_dir, "documents"))


QUERIES["op9_ppm_language"] = op9_ppm_language


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.ids_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op8_huffman_ids"] = op8_huffman_ids


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; item_ids is a list."""
    return spaced_seeds.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op10_spaced_seeds"] = op10_spaced_seeds


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES["op1_suffix_repeats"] = op1_suffix_repeats


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.line_report(table(spark, sf_dir, "documents"))


QUERIES["op3_line_edit_join"] = op3_line_edit_join
ORACLES["op3_line_edit_join"] = """
    WITH pos AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
    ), occ AS (SELECT doc_id, i, line, length(line) AS l FROM pos WHERE length(line) >= 20),
    dis AS (SELECT line, l, min((doc_id, i)) AS first FROM occ GROUP BY ALL),
    ix AS (SELECT line, l AS l0, 1 AS s, left(line, l // 2) AS seg FROM dis UNION ALL SELECT line, l, 2, right(line, l - l // 2) FROM dis),
    pr AS (SELECT line, l AS l0, 1 AS s, left(line, l // 2) AS seg FROM dis UNION ALL SELECT line, l, 2, right(line, l - l // 2) FROM dis
        UNION ALL SELECT line, l - 1, 1, left(line, (l - 1) // 2) FROM dis UNION ALL SELECT line, l - 1, 2, right(line, (l - 1) - (l - 1) // 2) FROM dis),
    cand AS (SELECT DISTINCT ix.line AS a, pr.line AS b FROM ix JOIN pr USING (l0, s, seg) WHERE ix.line <> pr.line),
    link AS (SELECT a, b FROM cand WHERE len(list_filter(range(0, length(a) + 1), lambda i: left(a, i) = left(b, i) AND
        CASE WHEN length(a) = length(b) THEN i < length(a) AND right(a, length(a) - i - 1) = right(b, length(a) - i - 1) ELSE right(a, length(a) - i) = right(b, length(a) - i) END)) > 0),
    both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    facts AS (SELECT a AS line, count(*) AS n_links, min(dis.first) AS least FROM both_ways JOIN dis ON dis.line = b GROUP BY a),
    judged AS (SELECT occ.doc_id, (occ.doc_id, i) > dis.first AS copy, coalesce(least < dis.first, false) AS near, coalesce(n_links, 0) AS n_links
        FROM occ JOIN dis USING (line) LEFT JOIN facts USING (line)),
    sums AS (SELECT doc_id, sum(copy::INT) AS n_copies, sum((near AND NOT copy)::INT) AS n_near, sum(n_links) AS n_links FROM judged GROUP BY 1)
    SELECT d.doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_copies, 0) AS BIGINT) AS n_copies, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(sums.n_links, 0) AS BIGINT) AS n_links
    FROM documents d LEFT JOIN sums USING (doc_id)
"""


def op11_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(packing.pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES["op11_ffd_packing"] = op11_ffd_packing


def op13_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digest(period_runs.periodic_runs(period_runs.planted(table(spark, sf_dir, "documents"))))


QUERIES["op13_lcp_runs"] = op13_lcp_runs


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES["op12_token_alignment"] = op12_token_alignment
