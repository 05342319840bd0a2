"""DuckDB SQL that states the result of each query on its own terms."""

from __future__ import annotations

from phrasewell.functions import fixed_values as fixed

V = """v AS (
  SELECT vec_id // 5 AS g, vec_id % 5 AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), q AS (SELECT g, v FROM v WHERE i = 0), c AS (SELECT * FROM v WHERE i > 0)"""

DIMS = """d AS (
  SELECT g, i, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM c
), m AS (
  SELECT g, dim, median(x) AS x FROM d GROUP BY g, dim
), med AS (SELECT g, list(x ORDER BY dim) AS v FROM m GROUP BY g)"""

PAIRS = """pr AS (
  SELECT a.g, avg(list_distance(a.v, b.v)) AS dist, avg(list_cosine_similarity(a.v, b.v)) AS cosine
  FROM c a JOIN c b ON a.g = b.g AND a.i < b.i GROUP BY a.g)"""

E = """e AS (
  SELECT o_orderkey AS row_id, 'wd:Q' || o_custkey AS c, 'P' || (o_orderkey % 25) AS p,
         'wd:Q' || (o_custkey // 10) AS t FROM orders
), sparql AS (
  SELECT row_id, 'SELECT ?v WHERE { ' || c || ' wdt:' || p || ' ?x . ?x p:' || p || ' ' || t || ' }' AS sparql FROM e
), parts AS (
  SELECT row_id, 0 AS pos, c AS part FROM e UNION ALL SELECT row_id, 1, t FROM e
  UNION ALL SELECT row_id, 2, 'wdt:' || p FROM e UNION ALL SELECT row_id, 3, 'p:' || p FROM e
), names AS (
  SELECT 'Q' || c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_name END AS label,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS description FROM customer
  UNION ALL SELECT 'P' || n_nationkey, n_name, 'region ' || n_regionkey FROM nation
), found AS (
  SELECT row_id, pos, part, label, description, coalesce('[' || label || ']', part) AS shown
  FROM parts LEFT JOIN names ON id = split_part(part, ':', 2)
), done AS (
  SELECT row_id, count(label) AS known,
         'SELECT ?v WHERE { ' || max(shown) FILTER (pos = 0) || ' ' || max(shown) FILTER (pos = 2) ||
         ' ?x . ?x ' || max(shown) FILTER (pos = 3) || ' ' || max(shown) FILTER (pos = 1) || ' }' AS translated
  FROM found GROUP BY row_id
)"""

T = """u AS (
  SELECT conv_id, arg_min(text, turn) AS query, arg_max(text, turn) AS question
  FROM conversations WHERE role = 'user' GROUP BY conv_id
), a AS (
  SELECT conv_id, list(text ORDER BY turn) AS said FROM (
    SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4) GROUP BY conv_id
), t AS (
  SELECT conv_id, query, question, coalesce(said, []) AS candidates FROM u LEFT JOIN a USING (conv_id)
)"""

VARIANT = """CASE s WHEN 0 THEN query WHEN 1 THEN query || ' please' WHEN 2 THEN replace(query, ' ', 'x ')
  ELSE 'what is ' || query END"""

L = "f AS (SELECT doc_id, quality AS eval_manual, 1 - toxic AS eval_llm FROM labels)"

COUNTS = """k AS (
  SELECT count(*) FILTER (eval_manual = 1 AND eval_llm = 1) AS tp, count(*) FILTER (eval_manual = 0 AND eval_llm = 1) AS fp,
         count(*) FILTER (eval_manual = 1 AND eval_llm = 0) AS fn, count(*) FILTER (eval_manual = 0 AND eval_llm = 0) AS tn,
         count(*) FILTER (eval_manual = eval_llm) AS same, count(eval_manual) AS labelled,
         count(*) FILTER (eval_manual = 1) AS manual_true, count(*) FILTER (eval_manual = 0) AS manual_false,
         count(*) FILTER (eval_llm = 1) AS judge_true, count(*) AS total
  FROM f)"""

RUNNING = """n AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score
), r AS (
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
         lead(score) OVER w AS lower
  FROM n WINDOW w AS (ORDER BY score DESC)
)"""

S2 = f"""s AS (
  SELECT doc_id, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)
), {RUNNING}"""

RATED = """rated AS (
  SELECT *, (score + lower) / 2 AS lim, (tp + n - fp) / (p + n) AS acc, tp / (tp + fp) AS prec, tp / p AS rec,
         coalesce(2 * (tp / (tp + fp)) * (tp / p) / nullif(tp / (tp + fp) + tp / p, 0), 0) AS f1, tp / (tp + fp) * pos / p AS gain FROM r
), tried AS (SELECT * FROM rated WHERE lower IS NOT NULL
), top_acc AS (SELECT * FROM tried ORDER BY acc DESC, score DESC LIMIT 1
), top_f1 AS (SELECT * FROM tried ORDER BY f1 DESC, score DESC LIMIT 1
), best AS (
  SELECT a.acc AS accuracy, a.lim AS accuracy_threshold, b.f1 AS f1, b.lim AS f1_threshold, b.prec AS precision, b.rec AS recall,
         (SELECT sum(gain) FROM rated) AS average_precision FROM top_acc a, top_f1 b)"""

RANKED = """ranked AS (
  SELECT score, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx,
         rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS ry FROM s)"""

CURVE = """u AS (
  SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn,
         tp / nullif(tp + fp, 0) AS prec, tp / nullif(p, 0) AS rec FROM r
)"""

# The mixed text of a document: the first part of its own words and the last part of the next one's.
B = """ring AS (
  SELECT doc_id, text AS first,
         coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS second
  FROM documents
), cut AS (
  SELECT doc_id, first, second, string_split(first, ' ') AS a, string_split(second, ' ') AS b FROM ring
), mix AS (
  SELECT doc_id, first, second,
         array_to_string(list_concat(a[1:floor(len(a) * 0.8)::BIGINT],
                         b[len(b) - floor(len(b) * 0.2)::BIGINT + 1:len(b)]), ' ') AS response FROM cut
)"""

BLEU = """sides AS (
  SELECT doc_id, 0 AS side, string_split(response, ' ') AS w FROM mix
  UNION ALL SELECT doc_id, 1, string_split(first, ' ') FROM mix
  UNION ALL SELECT doc_id, 2, string_split(second, ' ') FROM mix
), words AS (
  SELECT doc_id, side, unnest(w) AS tok, generate_subscripts(w, 1) AS pos, len(w) AS size FROM sides
), ahead AS (
  SELECT doc_id, side, pos, size, tok AS g1, tok || ' ' || lead(tok, 1) OVER o AS g2,
         tok || ' ' || lead(tok, 1) OVER o || ' ' || lead(tok, 2) OVER o AS g3,
         tok || ' ' || lead(tok, 1) OVER o || ' ' || lead(tok, 2) OVER o || ' ' || lead(tok, 3) OVER o AS g4
  FROM words WINDOW o AS (PARTITION BY doc_id, side ORDER BY pos)
), grams AS (
  SELECT doc_id, side, 1 AS n, g1 AS gram FROM ahead UNION ALL SELECT doc_id, side, 2, g2 FROM ahead WHERE pos + 1 <= size
  UNION ALL SELECT doc_id, side, 3, g3 FROM ahead WHERE pos + 2 <= size
  UNION ALL SELECT doc_id, side, 4, g4 FROM ahead WHERE pos + 3 <= size
), tally AS (
  SELECT doc_id, n, gram, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r1, count(*) FILTER (side = 2) AS r2
  FROM grams GROUP BY ALL
), per AS (
  SELECT doc_id, n, sum(least(h, greatest(r1, r2))) AS m, sum(h) AS t FROM tally GROUP BY ALL
), lens AS (
  SELECT doc_id, max(len(w)) FILTER (side = 0) AS hl, max(len(w)) FILTER (side = 1) AS l1, max(len(w)) FILTER (side = 2) AS l2
  FROM sides GROUP BY doc_id
), wide AS (
  SELECT doc_id, hl, CASE WHEN abs(l1 - hl) < abs(l2 - hl) THEN l1 WHEN abs(l2 - hl) < abs(l1 - hl) THEN l2 ELSE least(l1, l2) END AS rl,
         {counts} FROM lens JOIN per USING (doc_id) GROUP BY doc_id, hl, l1, l2
), bleu AS (
  SELECT *, CASE WHEN m1 = 0 THEN 0.0 ELSE (CASE WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / hl) END)
    * exp(({logs}) / 4) END AS score FROM wide
)""".format(
    counts=", ".join(
        f"coalesce(max(m) FILTER (n = {n}), 0)::BIGINT AS m{n}, coalesce(max(t) FILTER (n = {n}), 0)::BIGINT AS t{n}"
        for n in range(1, 5)
    ),
    logs=" + ".join(
        f"ln(CASE WHEN m{n} > 0 THEN m{n} / greatest(1, t{n}) ELSE 2.2250738585072014e-308::DOUBLE END)" for n in range(1, 5)
    ),
)


def hashed(source: str, key: str, text: str, name: str, dims: int) -> str:
    """CTEs that turn a text column into unit vectors of hashed token counts."""
    return f"""{name}_h AS (
  SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dims} AS dim, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest(string_split({text}, ' ')) AS tok FROM {source}) GROUP BY ALL
), {name}_l AS (SELECT {key}, sqrt(sum(n * n)) AS len FROM {name}_h GROUP BY {key}
), {name}_keys AS (SELECT DISTINCT {key} FROM {source}
), {name}_d AS (
  SELECT k.{key}, r.dim, coalesce(h.n, 0) / l.len AS x
  FROM {name}_keys k CROSS JOIN (SELECT unnest(range({dims})) AS dim) r
  JOIN {name}_l l ON l.{key} = k.{key}
  LEFT JOIN {name}_h h ON h.{key} = k.{key} AND h.dim = r.dim
), {name} AS (SELECT {key}, list(x::FLOAT::DOUBLE ORDER BY dim) AS v FROM {name}_d GROUP BY {key})"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def template(*lines: str, indent: str) -> str:
    """A prompt as SQL; pieces in double braces are SQL expressions."""
    joined = ("\n" + indent).join(lines)
    pieces = []
    for i, piece in enumerate(joined.replace("}}", "{{").split("{{")):
        if piece:
            pieces.append(f"coalesce({piece}, '')" if i % 2 else quoted(piece))
    return " || ".join(pieces)


def bins(score: str, source: str, count: int, where: str = "TRUE") -> str:
    """CTEs h: bin, lft, rgt, n of an equal-width histogram."""
    return f"""x AS (SELECT {score}::DOUBLE AS x FROM {source} WHERE {where}
), lim AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM x
), raw AS (
  SELECT x, lo, hi, (hi - lo) / {count} AS w, least(floor((x - lo) * ({count} / (hi - lo)))::BIGINT, {count - 1}) AS b FROM x, lim
), binned AS (
  SELECT b - (x < b * w + lo)::INT + (b < {count - 1} AND x >= (b + 1) * w + lo)::INT AS bin, count(*) AS n FROM raw GROUP BY 1
), h AS (
  SELECT r.bin, r.bin * ((hi - lo) / {count}) + lo AS lft,
         CASE WHEN r.bin = {count - 1} THEN hi ELSE (r.bin + 1) * ((hi - lo) / {count}) + lo END AS rgt, coalesce(n, 0) AS n
  FROM (SELECT unnest(range({count})) AS bin) r CROSS JOIN lim LEFT JOIN binned ON binned.bin = r.bin
)"""


A, U = fixed.ASSISTANT_TURN, fixed.USER_TURN
PY_LIST = """('[' || array_to_string(list_transform(candidates, lambda s: CASE
  WHEN contains(s, '''') AND NOT contains(s, '"') THEN '"' || replace(replace(s, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') || '"'
  ELSE '''' || replace(replace(replace(s, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '''', chr(92) || '''') || '''' END), ', ') || ']')"""
TAGGED = (
    fixed.BEGIN + fixed.SYSTEM_TURN, fixed.TRANSLATOR_ROLE + U, fixed.TASK + fixed.WORKED_QUERY,
    A + " " + fixed.WORKED_QUESTION, U + " " + fixed.CONTEXT + "{{" + PY_LIST + "}}", A + " OK.", U,
    fixed.TASK + "'{{query}}' " + A,
)

PICK = """p AS (
  SELECT g, i, s, row_number() OVER (PARTITION BY g ORDER BY round(s, 9) DESC, i) AS place FROM sc
)"""

CLUSTER_PAIRS = """a AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""

VECTOR_PAIRS = """a AS (
  SELECT vec_id, embedding::DOUBLE[] AS q,
         list_transform(embedding::DOUBLE[], lambda x, d: x * d) AS w FROM embeddings
), b AS (
  SELECT vec_id, q, w, coalesce(lead(w) OVER (ORDER BY vec_id), first_value(w) OVER (ORDER BY vec_id)) AS nw FROM a
), sim AS (
  SELECT vec_id, 1.0::DOUBLE AS label, list_cosine_similarity(q, w) AS similarity FROM b
  UNION ALL SELECT vec_id, 0.0::DOUBLE, list_cosine_similarity(q, nw) FROM b
)"""

STATS = """SELECT round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg({x}), 6) AS mean, round(median({x}), 6) AS median,
  round((SELECT {x} FROM {t} GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1), 6) AS mode FROM {t}"""

EVALUATED = f"""{T}, one_line AS (
  SELECT conv_id, replace(query, chr(10), ' ') AS question, replace(question, chr(10), ' ') AS paraphrased FROM t
), mix AS (
  SELECT conv_id AS doc_id, paraphrased AS first, question AS second, replace(question, 'e ', 'e so ') AS response FROM one_line
), {BLEU}, {hashed('mix', 'doc_id', 'first', 'hp', 64)}, {hashed('mix', 'doc_id', 'response', 'hr', 64)}, f AS (
  SELECT mix.doc_id AS row_id, second AS question, response, length(response) % 7 <> 0 AS verdict_valid,
         CASE WHEN length(response) % 7 = 0 THEN 0 WHEN abs(length(first) - length(response)) * 10 < length(first) THEN 1 ELSE 0 END AS eval_llm,
         quality AS eval_manual, list_cosine_similarity(hp.v, hr.v) AS bert, score AS bleu
  FROM mix JOIN hp USING (doc_id) JOIN hr USING (doc_id) JOIN bleu USING (doc_id) LEFT JOIN labels USING (doc_id)
)"""

SQL: dict[str, str] = {
    "scan_pairs": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "union_splits": "SELECT doc_id, lang, source, n_chars FROM documents",
    "write_results": "SELECT o_orderkey, o_custkey, o_totalprice, 'run-1' AS run_id FROM orders",
    "write_nested": f"""WITH {V}, {DIMS}, sc AS (
  SELECT c.g, c.i, list_cosine_similarity(med.v, c.v) AS s FROM c JOIN med USING (g)
), {PICK}
SELECT d.g, 'candidate ' || p.i AS best_translation_dist, d.i - 1 AS cand_idx, 'candidate ' || d.i AS translation,
       d.dim, round(d.x, 6) AS value
FROM d JOIN p ON p.g = d.g AND p.place = 1""",
    "stage_resume": """SELECT sha256(o_orderkey || chr(31) || o_orderpriority) AS row_key, o_orderkey, o_orderstatus, o_totalprice,
  round(sqrt(o_totalprice), 4) AS score FROM orders""",
    "incremental_results": "SELECT event_type, count(*) AS n, round(sum(round(value, 1)), 4) AS total FROM events GROUP BY event_type",
    "row_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM labels",
    "row_index_composite": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders",
    "head_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200",
    "tail_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200",
    "slice_split": """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS spot FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN spot < 1000 THEN spot ELSE spot - 1000 END AS row_id,
       CASE WHEN spot < 1000 THEN 'train' ELSE 'test' END AS split FROM r WHERE spot < 1300""",
    "slice_rows": """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS spot FROM orders)
SELECT o_orderkey, o_custkey, spot - 600 AS row_id FROM r WHERE spot >= 600 AND spot < 900""",
    "drop_failed": f"WITH {E} SELECT row_id, translated FROM done WHERE known = 4",
    "score_filter": "SELECT event_id, value FROM events WHERE value >= (SELECT max(value) * 0.2 FROM events)",
    "project_final": """SELECT text AS question, lang AS paraphrased_question, source AS sparql_wikidata,
  doc_id::VARCHAR AS wikidata_translated, lang || '-' || source AS model_response, n_chars::DOUBLE AS eval_bert FROM documents""",
    "coalesce_text": """SELECT doc_id, coalesce(quality::VARCHAR, 'n/a') AS quality, coalesce(toxic::VARCHAR, 'n/a') AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""",
    "extract_mentions": f"WITH {E} SELECT row_id, pos::BIGINT AS pos, part FROM parts",
    "mention_keys": f"WITH {E} SELECT DISTINCT split_part(part, ':', 2) AS id FROM parts",
    "label_lookup": f"WITH {E} SELECT row_id, pos::BIGINT AS pos, part, label, description FROM found",
    "mention_freq": f"WITH {E} SELECT part, count(*) AS n FROM parts GROUP BY part ORDER BY n DESC, part LIMIT 100",
    "substitute_labels": f"WITH {E} SELECT row_id, translated FROM done",
    "descriptions": f"""WITH {E} SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS pos,
  shown || ' is ' || description AS line FROM found WHERE description IS NOT NULL""",
    "query_mode": f"WITH {E} SELECT row_id, translated AS with_labels, sparql AS with_ids FROM done JOIN sparql USING (row_id)",
    "fewshot_prompt": f"""SELECT {quoted(fixed.BEGIN + fixed.SYSTEM_TURN + chr(10) + fixed.TRANSLATOR_ROLE + U + chr(10))} ||
  string_agg({quoted(fixed.TASK)} || text || {quoted(A + chr(10))} || 'item ' || item_id || {quoted(U + chr(10))}, '' ORDER BY item_id)
  || {quoted(fixed.TASK)} AS prompt FROM (SELECT * FROM benchmark ORDER BY item_id DESC LIMIT 20)""",
    "render_prompt": f"""WITH {T} SELECT conv_id, {template(*TAGGED, indent=fixed.FIRST_INDENT)} AS tagged,
  {template(fixed.TRANSLATOR_ROLE + ".", f"Example query: {fixed.WORKED_QUERY}, Answer: {fixed.WORKED_QUESTION}",
            "Context information: {{" + PY_LIST + "}}", fixed.TASK + "'{{query}}'", indent=fixed.FIRST_INDENT)} AS chat,
  {template(*TAGGED, "{{question}}" + U, fixed.REFLECT + A, indent=fixed.REFINE_INDENT)} AS refined,
  {template(fixed.BEGIN + fixed.SYSTEM_TURN, fixed.CRITIC_ROLE + U,
            fixed.CRITIC_TASK.replace("{candidates}", "{{" + PY_LIST + "}}").replace("{query}", "{{query}}") + A,
            indent=fixed.FIRST_INDENT)} AS critique,
  'shots ' || query || 'assistant' AS answer,
  'shots ' || query || chr(10) || question || {quoted(A)} AS judge FROM t""",
    "candidate_fanout": f"WITH {T} SELECT conv_id, query, unnest(range(3)) AS cand_idx FROM t",
    "batch_generate": f"""WITH {T}, x AS (SELECT conv_id, query, unnest(range(4)) AS s FROM t)
SELECT conv_id, s AS cand_idx, {VARIANT} AS text FROM x""",
    "refine_rounds": f"""WITH {T}, x AS (SELECT conv_id, query, unnest(range(4)) AS s FROM t)
SELECT conv_id, s AS cand_idx, ({VARIANT}) || '??' AS text FROM x""",
    "parse_chunks": "SELECT conv_id, turn, replace(text, chr(10), ' ') AS parsed FROM conversations",
    "critique_select": f"""WITH {T}, x AS (
  SELECT conv_id, unnest(candidates) AS cand, generate_subscripts(candidates, 1) - 1 AS spot FROM t
), y AS (
  SELECT conv_id, trim(cand) AS cand, spot, row_number() OVER (PARTITION BY conv_id ORDER BY length(cand), spot) AS place FROM x
)
SELECT t.conv_id, coalesce(y.cand, '') AS critique,
       (SELECT min(z.spot) FROM y z WHERE z.conv_id = t.conv_id AND z.cand = y.cand) AS critique_idx
FROM t LEFT JOIN y ON y.conv_id = t.conv_id AND y.place = 1""",
    "judge_verdict": f"""WITH {T} SELECT conv_id,
  CASE WHEN length(question) % 7 = 0 THEN 0 WHEN abs(length(query) - length(question)) * 10 < length(query) THEN 1 ELSE 0 END::BIGINT AS eval_llm,
  length(question) % 7 <> 0 AS verdict_valid FROM t""",
    "compare_template": f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS spot FROM benchmark)
SELECT 30 - spot AS place, {quoted(fixed.JUDGE_TASK + chr(10))} || text || chr(10) || 'item ' || item_id ||
  {quoted(A + chr(10) + fixed.JUDGE_BLANK + U)} AS block FROM r WHERE spot BETWEEN 1 AND 30""",
    "embed_text": f"WITH {hashed('documents', 'doc_id', 'text', 'z', 64)} SELECT doc_id, dim, round(x, 6) AS value FROM z_d",
    "encode_distinct": f"""WITH {hashed('documents', 'doc_id', 'text', 'z', 64)}
SELECT doc_id, dim, round(x::FLOAT::DOUBLE, 6) AS value FROM z_d""",
    "mean_pool": """WITH w AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents
), n AS (SELECT doc_id, length(tok) * 7 % 500 AS vec_id, count(*) AS c FROM w WHERE pos <= 512 GROUP BY ALL
), d AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT doc_id, dim, round(sum(c * x) / sum(c), 6) AS value FROM n JOIN d USING (vec_id) GROUP BY doc_id, dim""",
    "l2_normalize": """SELECT g, i, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY g, i)), 6) AS value FROM (
  SELECT vec_id // 5 AS g, vec_id % 5 AS i, unnest(embedding::DOUBLE[]) * (vec_id % 5 + 2) AS x,
         generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)""",
    "cosine_score": f"WITH {V} SELECT c.g, c.i, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM c JOIN q USING (g)",
    "pairwise_cosine": f"WITH {V}, {PAIRS} SELECT g, round(cosine, 6) AS avg_cosine_similarity FROM pr",
    "pairwise_distance": f"WITH {V}, {PAIRS} SELECT g, round(dist, 6) AS avg_pairwise_distance FROM pr",
    "cluster_cosine": f"""WITH {CLUSTER_PAIRS}, n AS (SELECT label, count(*) AS n FROM a GROUP BY label), s AS (
  SELECT x.label, avg(list_cosine_similarity(x.v, y.v)) AS s FROM a x JOIN a y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label)
SELECT label, n, round(s, 6) AS avg_cosine_similarity FROM n JOIN s USING (label)""",
    "cluster_distance": f"""WITH {CLUSTER_PAIRS}
SELECT x.label, count(*) AS pairs, round(avg(list_distance(x.v, y.v)), 6) AS avg_pairwise_distance
FROM a x JOIN a y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label""",
    "median_vector": f"WITH {V}, {DIMS} SELECT g, dim, round(x, 6) AS value FROM m",
    "cluster_median": """SELECT label, dim, round(median(x), 6) AS median FROM (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim""",
    "pick_by_median": f"""WITH {V}, {DIMS}, sc AS (SELECT c.g, c.i, list_cosine_similarity(med.v, c.v) AS s FROM c JOIN med USING (g)), {PICK}
SELECT g, i, round(s, 6) AS score FROM p WHERE place = 1""",
    "pick_by_query": f"""WITH {V}, sc AS (SELECT c.g, c.i, list_cosine_similarity(q.v, c.v) AS s FROM c JOIN q USING (g)), {PICK}
SELECT g, i, round(s, 6) AS score FROM p WHERE place = 1""",
    "assess_scores": f"""WITH {V}, {DIMS}, {PAIRS}, sc AS (
  SELECT c.g, c.i, list_cosine_similarity(med.v, c.v) AS by_median, list_cosine_similarity(q.v, list_reverse(c.v)) AS by_query,
         list_cosine_similarity(c.v, q.v) AS truth
  FROM c JOIN med USING (g) JOIN q USING (g)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(by_median, 9) DESC, i) AS pm,
         row_number() OVER (PARTITION BY g ORDER BY round(by_query, 9) DESC, i) AS pq,
         row_number() OVER (PARTITION BY g ORDER BY i DESC) AS pc FROM sc)
SELECT g, round(max(by_query) FILTER (pq = 1), 6) AS bert_q_nl_score_Q, round(max(truth) FILTER (pq = 1), 6) AS bert_nl_nl_gt_score_Q,
  round(max(by_query) FILTER (pm = 1), 6) AS bert_q_nl_score_dist, round(max(truth) FILTER (pm = 1), 6) AS bert_nl_nl_gt_score_dist,
  round(max(by_query) FILTER (pc = 1), 6) AS bert_q_nl_score_critique, round(max(truth) FILTER (pc = 1), 6) AS bert_nl_nl_gt_score_critique,
  'candidate ' || max(i) FILTER (pq = 1) AS "best_translation_Q", 'candidate ' || max(i) FILTER (pm = 1) AS best_translation_dist,
  'candidate ' || max(i) FILTER (pc = 1) AS best_translation_llm_critique,
  round(any_value(dist), 6) AS avg_pairwise_distance, round(any_value(cosine), 6) AS avg_cosine_similarity
FROM w JOIN pr USING (g) GROUP BY g""",
    "flatten_vectors": f"WITH {V}, {DIMS} SELECT g, i - 1 AS place, dim, round(x, 6) AS value FROM d",
    "ngrams": """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, n, p - 1 AS pos, array_to_string(w[p:p + n - 1], ' ') AS gram
FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4])::BIGINT AS n))""",
    "bleu_score": f"""WITH {B}, {BLEU} SELECT doc_id, {", ".join(f"m{n} AS match_{n}, t{n} AS total_{n}" for n in range(1, 5))},
  hl AS response_length, rl AS reference_length, round(score, 6) AS eval_bleu FROM bleu""",
    "attach_labels": f"WITH {L} SELECT doc_id, lang, eval_manual, eval_llm FROM documents LEFT JOIN f USING (doc_id)",
    "confusion": f"WITH {L}, {COUNTS} SELECT * FROM k",
    "classifier_metrics": f"""WITH {L}, {COUNTS} SELECT round(same / labelled, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM k""",
    "judge_summary": f"""WITH {L}, {COUNTS} SELECT judge_true AS judged_correct, total, manual_true AS first_correct,
  manual_false AS first_mistakes, fp + fn AS judge_mistakes, tp AS good, labelled AS out_of FROM k""",
    "score_stats": STATS.format(x="value", t="events"),
    "histogram": f"WITH {bins('value', 'events', 30)} SELECT bin, round(lft, 6) AS left, round(rgt, 6) AS right, n FROM h",
    "histogram_flagged": f"""WITH {bins('value', 'events', 200)}
SELECT bin, round(lft, 6) AS left, round(rgt, 6) AS right, n, lft < 87.0 AS below FROM h""",
    "accepted_labels": f"""WITH {L}, ev AS (SELECT doc_id, text, eval_manual, eval_llm FROM documents JOIN f USING (doc_id))
SELECT a.doc_id AS doc_id_x, ev.doc_id AS doc_id_y, a.n_chars, eval_manual, eval_llm
FROM documents a LEFT JOIN ev ON a.text IS NOT DISTINCT FROM ev.text WHERE a.n_chars >= 500""",
    "label_share": f"""WITH {L}, ev AS (SELECT doc_id, text, eval_manual FROM documents JOIN f USING (doc_id)), j AS (
  SELECT eval_manual FROM documents a LEFT JOIN ev ON a.text IS NOT DISTINCT FROM ev.text WHERE a.n_chars >= 500
), k AS (SELECT count(*) FILTER (eval_manual = 1) AS t, count(*) FILTER (eval_manual = 0) AS f FROM j)
SELECT t AS true_count, f AS false_count, round(100.0::DOUBLE * t / (t + f), 1) AS true_percent, round(100.0::DOUBLE * f / (t + f), 1) AS false_percent FROM k""",
    "share_split": f"""WITH {L}, {COUNTS}, z AS (SELECT floor(tn / labelled * 200)::BIGINT AS tn, floor(tp / labelled * 200)::BIGINT AS tp FROM k)
SELECT 'true negatives' AS share, tn AS size FROM z UNION ALL SELECT 'true positives', tp FROM z
UNION ALL SELECT 'false negatives', 200 - tn - tp FROM z""",
    "linear_fit": """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(corr(l_quantity, l_extendedprice), 4) AS r,
  round(sqrt((1 - corr(l_quantity, l_extendedprice) ** 2) * regr_syy(l_extendedprice, l_quantity)
    / (regr_sxx(l_extendedprice, l_quantity) * (count(*) - 2))), 4) AS stderr, count(*) AS n FROM lineitem""",
    "threshold_step": """WITH RECURSIVE q AS (SELECT avg(value / 100) AS mean FROM events), s AS (
  SELECT 0 AS n, 0.1::DOUBLE AS t UNION ALL
  SELECT n + 1, greatest(0, least(1, t + 0.01::DOUBLE * CASE WHEN mean < t THEN -1 ELSE 1 END)) FROM s, q WHERE n < 50)
SELECT round(mean, 6) AS mean_score, round(t, 6) AS threshold FROM s, q WHERE n = 50""",
    "threshold_curve": f"""WITH {S2}, {CURVE} SELECT threshold, tp, fp, fn, tn, round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(2 * prec * rec / nullif(prec + rec, 0), 6) AS f1 FROM u""",
    "threshold_sweep": f"""WITH {S2}, {CURVE} SELECT threshold, tp, fp, fn, tn, round(prec, 6) AS precision, round(rec, 6) AS recall
FROM u WHERE prec >= 0.9 ORDER BY threshold LIMIT 1""",
    "contrastive_pairs": """WITH b AS (
  SELECT doc_id, lang || '/' || source AS q, text,
         coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM documents)
SELECT doc_id, q AS sentence_0, text AS sentence_1, 1.0::DOUBLE AS label FROM b
UNION ALL SELECT doc_id, q, nxt, 0.0::DOUBLE FROM b""",
    "score_pairs": f"WITH {VECTOR_PAIRS} SELECT vec_id, label, round(similarity, 6) AS similarity FROM sim",
    "pair_similarity": f"""WITH {VECTOR_PAIRS}
SELECT 1.0::DOUBLE AS label, * FROM (WITH {bins('similarity', 'sim', 30, 'label = 1')} SELECT bin, round(lft, 6) AS left, round(rgt, 6) AS right, n FROM h)
UNION ALL
SELECT 0.0::DOUBLE AS label, * FROM (WITH {bins('similarity', 'sim', 30, 'label = 0')} SELECT bin, round(lft, 6) AS left, round(rgt, 6) AS right, n FROM h)""",
    "binary_eval": f"""WITH {S2}, {RATED} SELECT round(COLUMNS(*), 6) FROM best""",
    "similarity_eval": f"""WITH {S2}, {RANKED}
SELECT round(corr(score, label), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM ranked""",
    "evaluate_pairs": f"""WITH {T}, {hashed('t', 'conv_id', 'query', 'tq', 64)}, {hashed('t', 'conv_id', 'question', 'tn', 64)}, ring AS (
  SELECT conv_id, coalesce(lead(conv_id) OVER (PARTITION BY conv_id % 2 ORDER BY conv_id), min(conv_id) OVER (PARTITION BY conv_id % 2)) AS following FROM t
), s AS (
  SELECT round(list_cosine_similarity(tq.v, tn.v), 9) AS score, 1.0 AS label FROM tq JOIN tn USING (conv_id)
  UNION ALL SELECT round(list_cosine_similarity(tq.v, tn.v), 9), 0.0 FROM tq JOIN ring USING (conv_id) JOIN tn ON tn.conv_id = following
), {RUNNING}, {RATED}, {RANKED}, bars AS (
  SELECT 'true ' AS side, bin, n FROM (WITH {bins('score', 's', 30, 'label = 1')} SELECT bin, n FROM h)
  UNION ALL SELECT 'false ', bin, n FROM (WITH {bins('score', 's', 30, 'label = 0')} SELECT bin, n FROM h)
)
SELECT 'histogram' AS report, side || bin AS name, n::DOUBLE AS value FROM bars
UNION ALL SELECT 'binary', unnest(['accuracy', 'accuracy_threshold', 'f1', 'f1_threshold', 'precision', 'recall', 'average_precision']),
  unnest([round(accuracy, 5), round(accuracy_threshold, 5), round(f1, 5), round(f1_threshold, 5), round(precision, 5), round(recall, 5), round(average_precision, 5)]) FROM best
UNION ALL SELECT 'similarity', unnest(['pearson', 'spearman', 'n']), unnest([round(corr(score, label), 5), round(corr(rx, ry), 5), count(*)::DOUBLE]) FROM ranked""",
    "ingest_order": """SELECT row_number() OVER (ORDER BY lang <> 'en', doc_id) - 1 AS row_id, doc_id,
  row_number() OVER (ORDER BY lang <> 'en', doc_id) > count(*) OVER () - 200 AS in_prompt FROM documents""",
    "accepted_candidates": """SELECT original_query, best_translation_dist AS final_translation, bert_q_nl_score_dist AS final_score
FROM (ASSESSED) WHERE bert_q_nl_score_dist >= 0.6""",
    "preprocess_queries": f"""WITH {E}, told AS (
  SELECT row_id, coalesce(string_agg(shown || ' is ' || description, '; ' ORDER BY pos) FILTER (description IS NOT NULL), '') AS descriptions
  FROM found GROUP BY row_id)
SELECT row_id, o_orderstatus, translated AS sparql_wikidata_translated, descriptions
FROM done JOIN told USING (row_id) JOIN orders ON o_orderkey = row_id""",
    "assess_candidates": f"""WITH {T}, x AS (SELECT conv_id, query, unnest(range(4)) AS s FROM t
), cand AS (SELECT conv_id * 4 + s AS cid, conv_id, s AS i, ({VARIANT}) || '?' AS text FROM x
), {hashed('cand', 'cid', 'text', 'ct', 32)}, {hashed('cand', 'cid', 'text', 'cq', 64)},
{hashed('t', 'conv_id', 'query', 'tq', 64)}, {hashed('t', 'conv_id', 'question', 'tt', 32)},
c AS (SELECT cand.conv_id AS g, cand.i, cand.text, ct.v, cq.v AS qv FROM cand JOIN ct USING (cid) JOIN cq USING (cid)),
{DIMS}, {PAIRS}, sc AS (
  SELECT c.g, c.i, c.text, list_cosine_similarity(med.v, c.v) AS by_median, list_cosine_similarity(tq.v, c.qv) AS by_query,
         list_cosine_similarity(c.v, tt.v) AS truth
  FROM c JOIN med USING (g) JOIN tq ON tq.conv_id = g JOIN tt ON tt.conv_id = g
), w AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(by_median, 9) DESC, i) AS pm,
         row_number() OVER (PARTITION BY g ORDER BY round(by_query, 9) DESC, i) AS pq,
         row_number() OVER (PARTITION BY g ORDER BY length(text), i) AS pc FROM sc)
SELECT 'conversation ' || g AS original_query, any_value(query) AS instantiated_query, any_value(question) AS original_question,
  round(max(by_query) FILTER (pq = 1), 5) AS "bert_q_nl_score_Q", round(max(truth) FILTER (pq = 1), 5) AS "bert_nl_nl_gt_score_Q",
  round(max(by_query) FILTER (pm = 1), 5) AS bert_q_nl_score_dist, round(max(truth) FILTER (pm = 1), 5) AS bert_nl_nl_gt_score_dist,
  round(max(by_query) FILTER (pc = 1), 5) AS bert_q_nl_score_critique, round(max(truth) FILTER (pc = 1), 5) AS bert_nl_nl_gt_score_critique,
  max(text) FILTER (pq = 1) AS "best_translation_Q", max(text) FILTER (pm = 1) AS best_translation_dist,
  max(text) FILTER (pc = 1) AS best_translation_llm_critique,
  round(any_value(dist), 5) AS avg_pairwise_distance, round(any_value(cosine), 5) AS avg_cosine_similarity
FROM w JOIN pr USING (g) JOIN t ON t.conv_id = g GROUP BY g""",
    "evaluate_answers": f"""WITH {EVALUATED} SELECT row_id, question, response, verdict_valid, eval_llm, eval_manual,
  round(bert, 5) AS eval_bert, round(bleu, 5) AS eval_bleu FROM f""",
    "filtered_answers": f"""WITH {EVALUATED}, {COUNTS}, ev AS (SELECT * FROM f
), fin AS (SELECT * FROM ev WHERE bert >= 0.6
), j AS (SELECT ev.eval_manual FROM fin LEFT JOIN ev ON fin.question IS NOT DISTINCT FROM ev.question
), sh AS (SELECT count(*) FILTER (eval_manual = 1) AS t, count(*) FILTER (eval_manual = 0) AS f FROM j
), one AS (
  SELECT 'counts' AS report, unnest(['tp', 'fp', 'fn', 'tn', 'same', 'labelled', 'manual_true', 'manual_false', 'judge_true', 'total']) AS name,
         unnest([tp, fp, fn, tn, same, labelled, manual_true, manual_false, judge_true, total]::DOUBLE[]) AS value FROM k
  UNION ALL SELECT 'metrics', unnest(['accuracy', 'precision', 'recall', 'f1']),
         unnest([same / labelled, tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0)]) FROM k
  UNION ALL SELECT 'summary', unnest(['judged_correct', 'total', 'first_correct', 'first_mistakes', 'judge_mistakes', 'good', 'out_of']),
         unnest([judge_true, total, manual_true, manual_false, fp + fn, tp, labelled]::DOUBLE[]) FROM k
  UNION ALL SELECT 'bert', unnest(['min', 'max', 'mean', 'median', 'mode']),
         unnest([min(bert), max(bert), avg(bert), median(bert), (SELECT bert FROM ev GROUP BY bert ORDER BY count(*) DESC, bert LIMIT 1)]) FROM ev
  UNION ALL SELECT 'bleu', unnest(['min', 'max', 'mean', 'median', 'mode']),
         unnest([min(bleu), max(bleu), avg(bleu), median(bleu), (SELECT bleu FROM ev GROUP BY bleu ORDER BY count(*) DESC, bleu LIMIT 1)]) FROM ev
  UNION ALL SELECT 'shares', unnest(['true_count', 'false_count', 'true_percent', 'false_percent']),
         unnest([t, f, round(100 * t / nullif(t + f, 0), 1), round(100 * f / nullif(t + f, 0), 1)]::DOUBLE[]) FROM sh
  UNION ALL SELECT 'final', unnest(['rows', 'lowest']), unnest([count(*), min(bert)]::DOUBLE[]) FROM fin
)
SELECT report, name, round(value, 5) AS value FROM one""",
}
SQL["accepted_candidates"] = SQL["accepted_candidates"].replace("ASSESSED", SQL["assess_candidates"])
