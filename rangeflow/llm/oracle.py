"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from .secrets import RULES as SECRET_RULES
from .urls import RULES, TreeParams

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"
_PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(of: str, pattern: str, lower: bool) -> str:
    text = f"translate(coalesce({of}, ''), '{_UPPER}', '{_LOWER}')" if lower else f"coalesce({of}, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


def repeated_passages(window: int = 20) -> str:
    return f"""
WITH w AS (SELECT doc_id, {_words("text", _WORDS, False)} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - {window - 2}, 1))) AS i, ws FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS seq FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, ws, gone
      FROM w LEFT JOIN g USING (doc_id)),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM x),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM o ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM x LEFT JOIN t USING (doc_id)
"""


def contamination(window: int = 8, least_items: int = 2) -> str:
    return f"""
WITH b AS (SELECT item_id, {_words("text", _PLAIN_WORDS, True)} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {window}) AS n,
              unnest(list_transform(range(1, greatest(len(ws) - {window - 2}, 2)),
                                    lambda i: array_to_string(ws[i:i + {window - 1}], ' '))) AS seq
       FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, {_words("text", _PLAIN_WORDS, True)} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
p AS (SELECT doc_id, n, ws, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, lens),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS seq FROM p),
m AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, seq)),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= {least_items} AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def near_duplicates(shingle: int = 3, percent: int = 85) -> str:
    joined = " || ' ' || ".join(["ws[i]"] + [f"ws[i + {k}]" for k in range(1, shingle)])
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text", _WORDS, True)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {joined}) END) AS own FROM w),
u AS (SELECT doc_id, len(own) AS n, unnest(own) AS g FROM s),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
reach(v, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT v, b FROM reach JOIN e ON r = a)
SELECT s.doc_id, len(own)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON s.doc_id = c.v
"""


def archived_pages(least_bytes: int = 0) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT page_id, payload_bytes, hex, list_transform(range(0, 4), lambda k: CAST('0x' || hex[k * 10 + 1:k * 10 + 10] AS BIGINT)) AS parts,
             CASE WHEN payload_bytes >= {least_bytes} THEN max(page_id) OVER (PARTITION BY hex) ELSE page_id END AS original FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda g: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((parts[g // 8 + 1] >> CAST(35 - 5 * (g % 8) AS INTEGER)) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM q
"""


def url_verdicts(rules: tuple = RULES, p: TreeParams = TreeParams(), depth: int = 6) -> str:
    """For paths of fewer than ``depth`` segments (those of the tables have two): levels are written out."""
    fits = [(len(r.text), f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in rules]
    fits.sort(key=lambda x: -x[0])
    case = lambda what: "CASE " + " ".join(f"WHEN {c} THEN '{what(r)}'" for _, c, r in fits) + " END"
    far = f"n > 0 AND m > 0 AND (b / n - c / m) * (b / n - c / m) > {p.apart}::DOUBLE * {p.apart}::DOUBLE * ((b + c) / (n + m)) * (1 - (b + c) / (n + m)) * (1 / n + 1 / m)"
    levels, merges = [], []
    for d in range(depth):
        levels.append(f"""
g{d} AS (SELECT *, coalesce(shape[{d + 1}], '') AS seg FROM s{d}),
c{d} AS (SELECT host, leaf, seg, sum(n) AS pages, sum(labels) AS marked FROM g{d} WHERE NOT closed GROUP BY ALL),
l{d} AS (SELECT host, leaf, seg, seg = '' OR sum(marked) OVER w < {p.least_labels} AS stop,
                pages >= {p.least_pages} AND (100 * pages >= {p.least_percent} * sum(pages) OVER w OR marked >= {p.least_labels}) AS own FROM c{d} WINDOW w AS (PARTITION BY host, leaf)),
s{d + 1} AS (SELECT host, shape, n, labels, bad, closed OR coalesce(stop, true) AS closed,
                    CASE WHEN closed OR stop THEN leaf WHEN own THEN list_append(leaf, seg) ELSE list_append(leaf, '*') END AS leaf
             FROM g{d} LEFT JOIN l{d} USING (host, leaf, seg)),""")
        merges.append(f"""
y{d} AS (SELECT *, template[1:{d}] AS above, template[{d + 1}] AS branch, template[{d + 2}:] AS below FROM t{d}),
z{d} AS (SELECT host, above, branch, below, sum(n) AS n, sum(b) AS b FROM y{d} WHERE branch IS NOT NULL GROUP BY ALL),
q{d} AS (SELECT *, sum(n) OVER v - n AS m, sum(b) OVER v - b AS c FROM z{d} WINDOW v AS (PARTITION BY host, above, below)),
e{d} AS (SELECT host, above, branch, coalesce(string_agg(below::VARCHAR || (b / n > c / m), '|' ORDER BY below::VARCHAR) FILTER ({far}), '') AS kind FROM q{d} GROUP BY ALL),
x{d} AS (SELECT host, above, branch, kind, n, b, sum(n) OVER v - n AS m, sum(b) OVER v - b AS c FROM z{d} JOIN e{d} USING (host, above, branch) WINDOW v AS (PARTITION BY host, above, kind, below)),
a{d} AS (SELECT host, above, branch, kind, bool_or(kind <> '' AND {far}) AS apart FROM x{d} GROUP BY ALL),
t{d + 1} AS (SELECT host, leaf, n, b, CASE WHEN branch IS NULL OR apart THEN template ELSE list_concat(list_append(above, '~' || kind), below) END AS template
             FROM y{d} LEFT JOIN a{d} USING (host, above, branch)),""")
    return f"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
doc AS (SELECT page_id, try_cast(regexp_extract(url, '^[^?#]*?([0-9]+)[^0-9?#]*($|[?#])', 1) AS BIGINT) AS doc_id FROM pages),
marks AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM doc JOIN labels USING (doc_id) GROUP BY 1),
r AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS shape FROM u),
s0 AS (SELECT host, shape, count(*) AS n, count(bad) AS labels, coalesce(sum(bad), 0) AS bad, false AS closed, CAST([] AS VARCHAR[]) AS leaf
       FROM r LEFT JOIN marks USING (page_id) GROUP BY host, shape),{"".join(levels)}
t0 AS (SELECT host, leaf, sum(labels)::DOUBLE AS n, sum(bad)::DOUBLE AS b, leaf AS template FROM s{depth} GROUP BY host, leaf),{"".join(merges)}
o AS (SELECT sum(b) / greatest(sum(n), 1) AS overall FROM t{depth}),
h AS (SELECT host, (sum(b) + {p.weight}::DOUBLE * any_value(overall)) / (sum(n) + {p.weight}::DOUBLE) AS host_share FROM t{depth}, o GROUP BY host),
pu AS (SELECT host, template, (sum(b) + {p.weight}::DOUBLE * any_value(host_share)) / (sum(n) + {p.weight}::DOUBLE) AS bad_share FROM t{depth} JOIN h USING (host) GROUP BY host, template),
v AS (SELECT s.host, s.shape, bad_share FROM s{depth} s JOIN t{depth} t USING (host, leaf) JOIN pu ON pu.host = t.host AND pu.template = t.template)
SELECT page_id, host, path, {case(lambda x: x.text)} AS rule,
       coalesce({case(lambda x: x.verdict)}, CASE WHEN bad_share >= {p.reject} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN v USING (host, shape)
"""


def secret_spans(rules: tuple = SECRET_RULES, base: int = 3) -> str:
    found = []
    for i, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        found.append(f"""
SELECT doc_id, {i} AS kind, '{rule.kind}' AS name, unnest(range(1, len(m) + 1)) AS nth, unnest(list_transform(m, lambda x: len(x))) AS own,
       unnest(list_transform(p[1:len(m)], lambda x: len(x))) AS gap, unnest(list_transform(v, lambda x: len(x) >= {rule.least})) AS counts
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS p FROM d)""")
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {i}), 0) AS n_{rules[i].kind}" for i in range(base))
    names = ", ".join(f"coalesce(n_{rules[i].kind}, 0) AS n_{rules[i].kind}" for i in range(base))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(found)}),
w AS (SELECT *, CAST(sum(gap + own) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS stop FROM a),
s AS (SELECT doc_id, kind, stop - own AS start, name || ':' || (stop - own) || ':' || stop AS shown FROM w WHERE counts),
g AS (SELECT doc_id, {counts}, string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < {base}) AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


SQL: dict[str, str] = {
    "op1_substring_dedup": repeated_passages(),
    "op2_secret_scan": secret_spans(),
    "op4_warc": archived_pages(),
    "op5_decontamination": contamination(),
    "op7_url_filters": url_verdicts(),
    "op9_near_duplicates": near_duplicates(),
}
