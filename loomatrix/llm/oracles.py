"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def quality_sql(risk: float = 0.05, alpha: float = 0.05) -> str:
    """The quality rules with their controlled cutoffs: sums of binomial terms through lgamma."""
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
    values = {"repeat_share": share("n_repeat_words", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "long_words": share("word_chars", "n_words"), "short_words": share("n_words", "word_chars")}
    grid = ", ".join(f"('{rule}', CAST({c} AS DOUBLE))" for rule, cuts in RULES.items() for c in cuts)
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {v} AS value FROM m" for rule, v in values.items())
    p, tests = risk / len(RULES), sum(map(len, RULES.values()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
g AS (SELECT doc_id, stratum, text, words, len(words) AS n, CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2])) ELSE [] END AS grams FROM d),
e AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(len(grams))) AS pos FROM g),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS many FROM e) WHERE many > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, pos + unnest([0, 1, 2]) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT g.doc_id, stratum, n AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM g JOIN l ON l.doc_id = g.doc_id LEFT JOIN c ON c.doc_id = g.doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
v AS ({long}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
h AS (SELECT v.* FROM v JOIN good ON good.doc_id = v.doc_id WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {grid}),
k AS (SELECT stratum, h.rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k FROM h JOIN grid ON grid.rule = h.rule GROUP BY ALL),
t AS (SELECT *, CASE WHEN k < n * {p} THEN list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) ELSE 1.0 END AS cdf FROM k),
cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM t WHERE cdf <= {alpha} / ({tests} * (SELECT count(DISTINCT stratum) FROM k)) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM v JOIN cuts ON cuts.stratum = v.stratum AND cuts.rule = v.rule WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""


#: Words covered by a window of 20 that starts earlier too; ids are unique in the table.
REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
s AS (SELECT doc_id, words, unnest(range(len(words) - 19)) AS p FROM d WHERE len(words) >= 20),
k AS (SELECT doc_id, p, sha256(array_to_string(words[p + 1 : p + 20], ' ')) AS h FROM s),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS rn FROM k),
g AS (SELECT DISTINCT doc_id, p + unnest(range(20)) AS p FROM o WHERE rn > 1),
a AS (SELECT w.doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

#: One record for each page; equal payloads of 100 bytes or more refer to the smallest page.
ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
f AS (SELECT page_id, bytes, sha256(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


#: Five filters in all orders; E looks at the whole table.
AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS words, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS e FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * e::INT AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, f.b AS own, CAST(coalesce((SELECT sum(g.b) FROM f g WHERE instr(filter_order, g.f) < k), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS k), f WHERE f.f = substr(filter_order, k, 1)),
q AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, own,
  CAST(coalesce(sum(n) FILTER (mask & (before + own) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(t) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost
  FROM q, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

#: Lines cut by two draws; the third and fourth draw choose the form.
MIDDLES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

#: Sets of five-word shingles, all pairs that share one, and what links reach.
SHINGLES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingles FROM d),
e AS (SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.size) AS m, any_value(b.size) AS n, count(*) AS k FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (m + n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least ON least.doc_id = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {name: " ".join(sql.split()) for name, sql in {"op5_repeats": REPEATS, "op6_quality_rules": quality_sql(), "op7_warc": ARCHIVES, "op11_filter_audit": AUDIT, "op12_fill_in_middle": MIDDLES, "op13_minhash": SHINGLES}.items()}
