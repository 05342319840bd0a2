"""DuckDB SQL of the queries that SQL can express."""

from phrasewell.llm.licenses import TEMPLATES

_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)


def _bigrams(words: str) -> str:
    """Distinct pairs of neighbours of a list of words."""
    return f"list_distinct(list_transform(range(1, len({words})), lambda k: {words}[k] || ' ' || {words}[k + 1]))"


SQL: dict[str, str] = {
    "op2_licenses": rf"""
WITH templates(license, body) AS (VALUES {_TEMPLATES}),
t AS (SELECT license, {_bigrams("w")} AS b FROM (SELECT license, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM templates)),
normal AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS n FROM documents),
lines AS (SELECT doc_id, 'line' AS unit, unnest(string_split(n, chr(10))) AS u, generate_subscripts(string_split(n, chr(10)), 1) - 1 AS number FROM normal),
parts AS (SELECT doc_id, n, list_filter(list_transform(string_split_regex(n, '\n(?: ?\n)+'), lambda x: regexp_replace(x, '^[ \n]+|[ \n]+$', '', 'g')), lambda x: x <> '') AS p FROM normal),
paragraphs AS (SELECT doc_id, 'paragraph' AS unit, unnest(p) AS u, generate_subscripts(p, 1) - 1 AS number FROM parts),
units AS (
    SELECT doc_id, unit, number, u FROM lines
    UNION ALL SELECT doc_id, unit, number, u FROM paragraphs WHERE contains(u, chr(10))
    UNION ALL SELECT doc_id, 'text', 0, n FROM parts WHERE len(p) > 1
),
worded AS (SELECT doc_id, unit, number, string_split(trim(regexp_replace(u, '[ \n]+', ' ', 'g')), ' ') AS w FROM units),
paired AS (SELECT doc_id, unit, number, {_bigrams("w")} AS b FROM worded WHERE len(w) >= 2),
compared AS (
    SELECT doc_id, unit, number, license, 2.0 * len(list_intersect(paired.b, t.b)) / (len(paired.b) + len(t.b)) AS dice
    FROM paired JOIN t ON len(t.b) BETWEEN 0.6 * len(paired.b) AND 1.6 * len(paired.b)
)
SELECT doc_id, unit, CAST(number AS INTEGER) AS number, license, round(CAST(dice AS DOUBLE), 9) AS dice
FROM compared WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, license) = 1
""",
    "op4_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
n AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT x AS vec_id, coalesce(any_value(n_links), 0) AS n_links, min(y) AS component_id, x = min(y) AS kept
FROM r LEFT JOIN n USING (x) GROUP BY x
""",
    "op10_warc": """
WITH read AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM read),
top AS (SELECT h, max(page_id) AS last FROM hashed GROUP BY h),
bits AS (SELECT h, last, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(instr('0123456789abcdef', h[i]) - 1), 4)), 'string_agg', '') AS b FROM top),
spelled AS (SELECT h, last, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CAST(b[5 * i + 1 + k] AS INTEGER) * (16 >> CAST(k AS INTEGER)))) AS INTEGER)]), 'string_agg', '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM hashed JOIN spelled USING (h)
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
words AS (SELECT row, doc_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
length AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM length),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
),
weighed AS (SELECT item_id, term, times, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN df USING (term), total),
scored AS (
    SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM weighed JOIN tf USING (term) JOIN length USING (row), total
    GROUP BY item_id, row, doc_id
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
