"""DuckDB twins of the queries and of the pipeline."""

from .quality import ALPHA, DELTA, RULES

DEDUP = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER o = 1 AS kept, h AS text_sha256
FROM d WINDOW o AS (PARTITION BY h ORDER BY n DESC, doc_id ASC NULLS LAST)"""


def measured(docs="documents"):
    """CTEs up to ``m``: the counts and rule values of every row of ``docs``."""
    return f"""
d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS c FROM g JOIN twice USING (rid, g), range(3) AS r(k) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)),
       lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
c AS (SELECT rid, doc_id, stratum, len(ws) AS n_words,
      length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
      len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.c, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      1000 * n_symbols // greatest(word_chars, 1) AS v_symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS v_dup_lines,
      1000 * n_repeat_words // greatest(n_words, 1) AS v_repeats,
      least(10 * word_chars // greatest(n_words, 1), 1000) AS v_long_words,
      1000 - least(10 * word_chars // greatest(n_words, 1), 1000) AS v_short_words,
      1000 * n_digits // greatest(word_chars, 1) AS v_digits FROM c)"""


def judged(docs="documents"):
    """CTEs up to ``j``: ``m`` with ``kept``."""
    values = " UNION ALL ".join(f"SELECT rid, stratum, '{r}' AS rule, v_{r} AS v FROM m" for r in RULES)
    return f"""{measured(docs)},
v AS ({values}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
bars AS (SELECT stratum, rule, v, count(*) AS c FROM v WHERE rid IN (SELECT rid FROM m
         WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)) GROUP BY ALL),
b AS (SELECT *, sum(c) OVER (PARTITION BY stratum, rule) AS n,
      coalesce(sum(c) OVER (PARTITION BY stratum, rule ORDER BY v DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM bars),
tests AS (SELECT count(DISTINCT (stratum, rule)) AS tests FROM b),
n AS (SELECT DISTINCT stratum, CAST(n AS BIGINT) AS n FROM b),
cdf AS (SELECT stratum, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({ALPHA})
               + (n - k) * ln(1 - {ALPHA}))) OVER (PARTITION BY stratum ORDER BY k) AS p
        FROM (SELECT stratum, n, unnest(range(0, CAST(ceil(n * {ALPHA}) AS BIGINT) + 1)) AS k FROM n)),
ks AS (SELECT stratum, max(k) AS k FROM cdf, tests WHERE p <= {DELTA} / tests GROUP BY stratum),
cuts AS (SELECT b.stratum, b.rule, min(v) AS cut FROM b JOIN ks ON b.stratum IS NOT DISTINCT FROM ks.stratum
         WHERE above <= k GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM v JOIN cuts ON v.stratum IS NOT DISTINCT FROM cuts.stratum AND v.rule = cuts.rule
        WHERE v.v > cuts.cut),
j AS (SELECT *, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM m)"""


QUALITY = f"""WITH {judged()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM j"""


MIXING = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5('mix' || coalesce(':' || doc_id, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
      FROM d GROUP BY source),
caps AS (SELECT s.*, 0 AS step, 1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS share, false AS capped FROM s
  UNION ALL
  SELECT source, source_size, weight, step + 1,
         CASE WHEN capped OR share >= 2.0 * source_size THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped OR share >= 2.0 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ())
                   * weight / sum(CASE WHEN capped OR share >= 2.0 * source_size THEN 0 ELSE weight END) OVER () END,
         capped OR share >= 2.0 * source_size
  FROM caps WHERE step < (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, share AS target FROM caps WHERE step = (SELECT count(*) FROM s)),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
       CAST(size * (round(target)::BIGINT // source_size)
            + least(size, greatest(round(target)::BIGINT % source_size - pos, 0)) AS BIGINT) END AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""

# base 32 from hex: five hex digits are four base-32 digits
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t)) AS b, sha1(t) AS x FROM p),
d AS (SELECT page_id, b, x, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT)
               >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest FROM h),
w AS (SELECT *, max(page_id) OVER (PARTITION BY x, b) AS m FROM d)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to FROM w"""
