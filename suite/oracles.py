"""DuckDB twins of the registered queries.

``VIEWS`` defines the inputs in SQL; a query names the views it needs and gets them, with
whatever they need in turn, as common table expressions.
"""

import re

from folioscope import fixed_values as V
from folioscope.plans.approaches import REGISTRY

from .views import IDS, OTHER, STOP_PHRASES, UNBUILT

HASH_WIDTH = 256
WORD = r"[\p{L}\p{N}_]{2,}"


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def lits(texts):
    return ", ".join(lit(t) for t in texts)


def r6(expression):
    """Six places; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, 6) + 0.0)"


STOP = lits(sorted({*V.PORTUGUESE_STOP_WORDS, *V.DOMAIN_STOP_WORDS}))


def template(text, description="description_llm", keywords="keywords_llm"):
    out = []
    for piece in re.split(r"(\{\w+\})", text):
        out.append({"{description}": description, "{keywords}": keywords}.get(piece, lit(piece)))
    return " || ".join(p for p in out if p != "''")


def unit(v):
    """Unit vector of a DOUBLE[] expression; a zero vector stays."""
    return (f"(CASE WHEN list_dot_product({v}, {v}) > 0 THEN "
            f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) ELSE {v} END)")


def fused(a, b):
    """Weighted sum of two unit vectors (not yet unit)."""
    return f"list_transform(list_zip({a}, {b}), lambda p: {V.VISUAL_WEIGHT} * p[1] + {V.TEXT_WEIGHT} * p[2])"


def relevant_text(t):
    phrases = " AND ".join(f"NOT contains(lower({t}), {lit(p)})" for p in STOP_PHRASES)
    return f"({phrases} AND NOT regexp_matches(lower({t}), '[.\\s]{{10}}\\d') AND length(lower({t})) >= {V.MIN_TEXT_LENGTH})"


APPROACH_SQL = (
    f"CASE WHEN event_id % 4 = 3 AND user_id % 10 = 8 THEN {lit(OTHER)} "
    + " ".join(f"WHEN event_id % 4 = {i} THEN {lit(a)}" for i, a in enumerate(IDS)) + " END"
)
KEY = "json_extract_string(props, '$.k')"
WHITE = "E' \\t\\n\\r\\f\\x0b'"

VIEWS = {
    "blocks": f"""
        SELECT 'd' || (doc_id % 2) AS doc_id, (doc_id // 2 + 1)::INTEGER AS page, i - 1 AS block_index,
               'p' || (doc_id // 2 + 1) || '_txt_' || (i - 1) AS id, replace(trim(raw, {WHITE}), chr(10), ' ') AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "annotations": """
        SELECT doc_id, id, page, type,
               CASE WHEN type = 'image' THEN 'images/' || id || '.png' END AS content_path,
               CASE WHEN type <> 'image' THEN text END AS original_text,
               CASE WHEN doc_id % 17 = 0 THEN 'N/A' WHEN doc_id % 19 = 0 THEN '' ELSE text END AS description_llm,
               CASE WHEN doc_id % 23 <> 0 THEN array_to_string(string_split(text, ' '), ', ') END AS keywords_llm
        FROM (SELECT *, (doc_id // 10 + 1)::INTEGER AS page,
                     CASE WHEN doc_id % 50 = 7 THEN 'table' WHEN doc_id % 3 = 0 THEN 'image' ELSE 'text' END AS type,
                     'p' || (doc_id // 10 + 1) || CASE WHEN doc_id % 3 = 0 THEN '_img_' ELSE '_txt_' END
                         || (doc_id % 10) AS id
              FROM documents)""",
    "clean": f"""
        SELECT * FROM (SELECT doc_id, id, page, type,
               CASE WHEN content_path NOT IN ({lits(V.NULL_WORDS)}) THEN content_path END AS content_path,
               CASE WHEN original_text NOT IN ({lits(V.NULL_WORDS)}) THEN original_text END AS original_text,
               CASE WHEN description_llm NOT IN ({lits(V.NULL_WORDS)}) THEN description_llm END AS description_llm,
               CASE WHEN keywords_llm NOT IN ({lits(V.NULL_WORDS)}) THEN keywords_llm END AS keywords_llm
        FROM annotations) WHERE description_llm IS NOT NULL AND keywords_llm IS NOT NULL""",
    "embedded": f"""
        SELECT *, CASE type WHEN 'text' THEN {template(V.TEMPLATE_TEXT)}
                            WHEN 'image' THEN {template(V.TEMPLATE_IMAGE)} ELSE '' END AS text_for_embedding
        FROM clean""",
    "measured": """
        SELECT *, length(description_llm) AS desc_len, length(text_for_embedding) AS embed_len,
               len(string_split(keywords_llm, ',')) AS kw_count FROM embedded""",
    "answers": """
        SELECT id, CASE page % 5
            WHEN 0 THEN 'RESUMO: ' || description_llm || ' PALAVRAS-CHAVE: ' || keywords_llm
            WHEN 1 THEN 'DESCRIÇÃO: ' || description_llm || ' PALAVRAS-CHAVE: ' || keywords_llm
            WHEN 2 THEN 'RESUMO: ' || description_llm
            WHEN 3 THEN description_llm
            ELSE 'PALAVRAS-CHAVE: ' || keywords_llm || ' RESUMO: ' || description_llm || ' PALAVRAS-CHAVE: x'
            END AS answer
        FROM clean""",
    "base": """
        SELECT e.vec_id AS id, e.label, CASE WHEN e.vec_id % 3 = 0 THEN 'image' ELSE 'text' END AS type,
               (e.vec_id // 10 + 1)::INTEGER AS page, e.embedding::DOUBLE[] AS vis,
               a.embedding::DOUBLE[] AS txt, b.embedding::DOUBLE[] AS txt2
        FROM embeddings e CROSS JOIN (SELECT count(*) AS n FROM embeddings) c
        JOIN embeddings a ON a.vec_id = (e.vec_id + 1) % c.n
        JOIN embeddings b ON b.vec_id = (e.vec_id + 2) % c.n""",
    "units": f"SELECT id, label, type, page, {unit('vis')} AS vis, {unit('txt')} AS txt, {unit('txt2')} AS txt2 FROM base",
    "items": f"""
        SELECT {lit(IDS[0])} AS approach_id, id, type, page, label, txt AS v FROM units
        UNION ALL SELECT {lit(IDS[1])}, id, type, page, label,
            CASE WHEN type = 'image' THEN {unit(fused('vis', 'txt'))} ELSE txt END FROM units
        UNION ALL SELECT {lit(IDS[2])}, id, type, page, label, CASE WHEN type = 'image' THEN vis ELSE txt END FROM units
        UNION ALL SELECT {lit(IDS[3])}, id, type, page, label,
            CASE WHEN type = 'image' THEN {unit(fused('vis', 'txt2'))} ELSE txt2 END FROM units""",
    "item_units": f"SELECT approach_id, id, type, page, label, {unit('v')} AS v FROM items",
    "hits": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY approach_id, type, query_id
                                                   ORDER BY score DESC, id)::INTEGER AS rank
            FROM (SELECT i.approach_id, i.type, q.id AS query_id, q.label AS query_label, i.id, i.page, i.label,
                         {r6('list_dot_product(q.vis, i.v)')} AS score
                  FROM item_units i CROSS JOIN units q)) WHERE rank <= {V.TOP_K}""",
    "pixels": """
        SELECT image_id, width, height, 128.0 + (100 + image_id % 5 * 50) * e::DOUBLE AS grey
        FROM (SELECT vec_id AS image_id, vec_id % 80 + 64 AS width, vec_id % 30 + 90 AS height,
                     unnest(embedding) AS e FROM embeddings)""",
    "votes": f"""
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
               CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 11 = 0 THEN ' ' ELSE user_id::VARCHAR END AS evaluator,
               {APPROACH_SQL} AS approach_id, 'q' || (user_id % 10) AS query, {KEY} AS result_id,
               CASE WHEN event_type = 'error' THEN 'image' ELSE 'text' END AS result_type,
               ({KEY}::INTEGER % 12 + 1)::INTEGER AS result_page, value AS result_score,
               CASE WHEN value >= 60 AND user_id % 10 <> 9 THEN 'relevante' ELSE 'nao_relevante' END AS evaluation
        FROM events""",
    "truth": "SELECT DISTINCT query, result_id FROM votes WHERE evaluation = 'relevante'",
    "retrieved": f"SELECT DISTINCT approach_id, query, result_id FROM votes WHERE approach_id IN ({lits(IDS)})",
    "confusion": """
        SELECT approach_id, query, tp, n - tp AS fp, relevant - tp AS fn
        FROM (SELECT r.approach_id, r.query, count(*) AS n, count(t.result_id) AS tp
              FROM retrieved r LEFT JOIN truth t ON t.query = r.query AND t.result_id = r.result_id GROUP BY ALL)
        JOIN (SELECT query, count(*) AS relevant FROM truth GROUP BY query) USING (query)""",
    "prf": """
        SELECT approach_id, query, p AS precision, r AS recall,
               CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0 END AS f1
        FROM (SELECT approach_id, query, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
                     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM confusion)""",
    "registry": "SELECT unnest([" + lits([*IDS, UNBUILT]) + "]) AS approach_id",
    "macro": """
        SELECT approach_id, coalesce(avg(precision), 0) AS precision, coalesce(avg(recall), 0) AS recall,
               coalesce(avg(f1), 0) AS f1, count(query) AS queries
        FROM registry LEFT JOIN prf USING (approach_id) GROUP BY approach_id""",
    "records": """
        SELECT 'q' || (doc_id % 10) AS query, text AS result_text,
               'Página ' || (doc_id + 1) AS page, doc_id, quality, toxic
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "flat": """
        SELECT query, result_text, page, (doc_id % 150) AS user_id, quality AS value, quality IS NOT NULL AS rated
        FROM records
        UNION ALL SELECT query, result_text, page, (doc_id + 1) % 150, 1 - toxic, true FROM records
        WHERE quality IS NOT NULL""",
    "named": """
        SELECT query, result_text, page, CASE WHEN rated THEN c_name ELSE 'N/A' END AS "user",
               value::INTEGER AS value, CASE WHEN rated THEN value::VARCHAR ELSE 'Pendente' END AS relevancia
        FROM flat LEFT JOIN customer ON c_custkey = user_id""",
    "doc_words": f"""
        SELECT doc_id AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents)""",
    "item_words": f"""
        SELECT item_id AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
        FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark)""",
}


def with_views(sql, views=None):
    """Prefix ``sql`` with the views it mentions, directly or through other views."""
    views = VIEWS if views is None else views
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in views:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(views[name])
    parts = [f"{name} AS ({views[name].strip()})" for name in views if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


def coordinates(source, vector, *keys):
    names = ", ".join(keys)
    return f"""
        SELECT {names}, (i - 1)::INTEGER AS i, {r6('x')} AS x
        FROM (SELECT {names}, unnest(v) AS x, generate_subscripts(v, 1) AS i
              FROM (SELECT {names}, {vector} AS v FROM {source}))"""


def described(name, source, column):
    quartiles = ", ".join(
        f"quantile_cont({column}::DOUBLE, {q}) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return f"""
        SELECT '{name}' AS "column", count({column}) AS "count", {r6(f'avg({column})')} AS mean,
               {r6(f'stddev_samp({column})')} AS std, min({column})::DOUBLE AS min, {quartiles},
               max({column})::DOUBLE AS max FROM {source}"""


def histogram(source, column, bins):
    return f"""
        SELECT bin, {r6(f'lo + bin * (hi - lo) / {bins}.0')} AS lower,
               {r6(f'lo + (bin + 1) * (hi - lo) / {bins}.0')} AS upper, coalesce(n, 0) AS items
        FROM (SELECT unnest(range({bins}))::INTEGER AS bin)
        CROSS JOIN (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source})
        LEFT JOIN (SELECT least(floor(({column} - lo) * {bins} / (hi - lo)), {bins - 1})::INTEGER AS bin, count(*) AS n
                   FROM {source} CROSS JOIN (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source})
                   GROUP BY 1) USING (bin)"""


def ngrams(source, text, sizes):
    grams = " UNION ALL ".join(
        f"SELECT unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS ngram "
        f"FROM words" for n in range(sizes[0], sizes[1] + 1))
    return f"""
        SELECT ngram, count(*) AS items FROM (
            WITH words AS (SELECT list_filter(regexp_extract_all(lower({text}), '{WORD}'), lambda x: x NOT IN ({STOP})) AS w
                           FROM {source})
            {grams})
        GROUP BY ngram ORDER BY items DESC, ngram LIMIT {V.TOP_NGRAMS}"""


def dense(words, width):
    return f"""
        SELECT id, list_transform(range({width}), lambda b: coalesce(m[b], 0)::DOUBLE) AS v FROM (
            SELECT id, map_from_entries(list((b, n))) AS m
            FROM (SELECT id, h % {width} AS b, count(*) AS n FROM {words} GROUP BY ALL) GROUP BY id)"""


EVENT_COLUMNS = ("timestamp, evaluator, approach_id, query, result_id, result_type, result_page, "
                 "result_score, evaluation")
PROMPT_LENGTH = len(V.TEXT_PROMPT) - 2
ANNOTATED = f"""
    SELECT doc_id, id, page, n, CASE WHEN n % 7 = 0 THEN 'ValueError: busy' END AS error,
           CASE WHEN n % 7 <> 0 THEN n || ' chars' END AS description_llm,
           CASE WHEN n % 7 <> 0 THEN 'a' || (n % 3) || ', b' || (n % 5) END AS keywords_llm
    FROM (SELECT doc_id, id, page, length(text) + {PROMPT_LENGTH} AS n FROM blocks WHERE {relevant_text('text')})"""

# grey value of the repeated pixel pattern: luma of red = green = level, blue = 255 - level
_LEVEL = "least(greatest(floor(128.0 + (100 + vec_id % 5 * 50) * e::DOUBLE), 0), 255)::BIGINT"
IMAGE_BYTES = f"""
    SELECT image_id, width, height, {r6('sqrt(greatest(sum(c * grey * grey) / sum(c) - pow(sum(c * grey) / sum(c), 2), 0))')} AS grey_std
    FROM (SELECT vec_id AS image_id, width::INTEGER AS width, height::INTEGER AS height,
                 ((g * 19595 + g * 38470 + (255 - g) * 7471 + 32768) >> 16) AS grey,
                 (width * height - i + 64) // 64 AS c
          FROM (SELECT vec_id, width, height, i, {_LEVEL} AS g
                FROM (SELECT vec_id, vec_id % 80 + 64 AS width, vec_id % 30 + 90 AS height, unnest(embedding) AS e,
                             generate_subscripts(embedding, 1) AS i FROM embeddings)))
    WHERE width >= 100 AND height >= 100
    GROUP BY ALL HAVING sqrt(greatest(sum(c * grey * grey) / sum(c) - pow(sum(c * grey) / sum(c), 2), 0)) >= 20"""

BEST = f"""
    SELECT approach_id, query_id, CASE WHEN img > txt THEN 'image' ELSE 'text' END AS type,
           CASE WHEN img > txt THEN img_id ELSE txt_id END AS id,
           CASE WHEN img > txt THEN img_page ELSE txt_page END AS page,
           CASE WHEN NOT img > txt THEN
               array_to_string(regexp_split_to_array(trim(d.text, {WHITE}), '[\\s]+')[1:{V.SNIPPET_WORDS}], ' ') END AS snippet
    FROM (SELECT approach_id, query_id,
                 coalesce(max(score) FILTER (type = 'image'), -1) AS img, coalesce(max(score) FILTER (type = 'text'), -1) AS txt,
                 max(id) FILTER (type = 'image') AS img_id, max(id) FILTER (type = 'text') AS txt_id,
                 max(page) FILTER (type = 'image') AS img_page, max(page) FILTER (type = 'text') AS txt_page
          FROM hits WHERE rank = 1 GROUP BY ALL)
    LEFT JOIN documents d ON d.doc_id = txt_id
    WHERE img > txt OR txt <> -1"""

_TEXT = "coalesce(d.text, 'd')"
_WORDS = "coalesce(array_to_string(string_split(d.text, ' '), ', '), 'k')"

# The flagship judges search hits instead of votes: the same views over another "votes".
HITS_AS_VOTES = """
    SELECT approach_id, query_id::VARCHAR AS query, id::VARCHAR AS result_id,
           CASE WHEN label = query_label THEN 'relevante' ELSE 'nao_relevante' END AS evaluation FROM hits"""

_QUERIES = {
    "block_explode": "SELECT doc_id, id, page, block_index::INTEGER AS block_index, text FROM blocks",
    "text_relevance": f"SELECT doc_id, id, text FROM blocks WHERE {relevant_text('text')}",
    "text_length_only": f"SELECT doc_id, id, text FROM blocks WHERE length(text) > {V.MIN_TEXT_LENGTH}",
    "annotation_resume": """
        SELECT doc_id, id, text FROM blocks WHERE NOT (CASE WHEN doc_id = 'd0' THEN page % 3 = 0 ELSE block_index % 5 = 0 END)""",
    "prompt_table": f"""
        SELECT doc_id, id, replace({lit(V.TEXT_PROMPT)}, '{{}}', text) AS prompt FROM blocks WHERE {relevant_text('text')}
        UNION ALL SELECT 'images', image_id::VARCHAR, {lit(V.IMAGE_PROMPT)} FROM ({IMAGE_BYTES})""",
    "llm_response_parse": f"""
        SELECT id, coalesce(trim(string_split(string_split(answer, 'RESUMO:')[2], 'PALAVRAS-CHAVE:')[1], {WHITE}),
                            trim(string_split(string_split(answer, 'DESCRIÇÃO:')[2], 'PALAVRAS-CHAVE:')[1], {WHITE}), 'N/A')
                   AS description_llm,
               coalesce(trim(string_split(answer, 'PALAVRAS-CHAVE:')[2], {WHITE}), 'N/A') AS keywords_llm FROM answers""",
    "annotation_clean": "SELECT id, page, type, description_llm, keywords_llm FROM clean",
    "split_by_type": "SELECT id, type FROM clean WHERE type IN ('text', 'image')",
    "embedding_text_by_type": "SELECT id, text_for_embedding FROM embedded",
    "embedding_text_unified": f"SELECT id, {template(V.TEMPLATE_UNIFIED)} AS text_for_embedding FROM clean",
    "encoder_prefix": f"""
        SELECT id, {lit(V.PASSAGE_PREFIX)} || text_for_embedding AS passage,
               {lit(V.QUERY_PREFIX)} || description_llm AS question FROM embedded""",
    "snippet_label": f"""
        SELECT doc_id, array_to_string(regexp_split_to_array(trim(text, {WHITE}), '[\\s]+')[1:{V.SNIPPET_WORDS}], ' ') AS snippet,
               substr(text, 1, {V.LABEL_CHARS}) || '...' AS label FROM documents""",
    "annotate_batch": f"SELECT doc_id, id, description_llm, keywords_llm, error FROM ({ANNOTATED})",
    "annotate_images": f"""
        SELECT 'd' || (image_id % 2) AS doc_id, 'p' || (image_id // 2 + 1) || '_img_0' AS id, (image_id // 2 + 1)::INTEGER AS page,
               'image' AS type, 'images/' || image_id || '.png' AS content_path, n || ' chars' AS description_llm,
               'a' || (n % 3) || ', b' || (n % 5) AS keywords_llm
        FROM (SELECT image_id, {len(V.IMAGE_PROMPT)} + width * height * 3 AS n FROM ({IMAGE_BYTES})) WHERE n % 7 <> 0""",
    "image_filter_pixels": f"""
        SELECT image_id, width, height, {r6('stddev_pop(grey)')} AS grey_std FROM pixels
        WHERE width >= 100 AND height >= 100 GROUP BY ALL HAVING stddev_pop(grey) >= 20""",
    "image_filter_bytes": IMAGE_BYTES,
    "vector_normalize": coordinates(
        "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 4)) AS e FROM embeddings)",
        unit("e"), "vec_id"),
    "vector_fuse": coordinates(f"(SELECT id, {fused('vis', 'txt')} AS f FROM units)", unit("f"), "id"),
    "vector_zero_fallback": """
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS length, 64 AS width FROM embeddings""",
    "topk_search": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
            FROM (SELECT q.id AS query_id, i.id, i.label, {r6('list_dot_product(q.vis, i.vis)')} AS score
                  FROM units q CROSS JOIN units i)) WHERE rank <= {V.TOP_K}""",
    "dual_search": "SELECT approach_id, type, query_id, rank, id, score, page FROM hits",
    "approach_compare": """
        SELECT query_id, approach_id, count(*) AS results, count(DISTINCT page) AS pages, max(score) AS best_score,
               arg_max(id, (score, -id)) AS best_id FROM hits GROUP BY ALL""",
    "best_page": BEST,
    "approach_build": coordinates("items", unit("v"), "approach_id", "type", "id", "page"),
    "encode_batch": coordinates(f"""(SELECT doc_id, coalesce(v, list_transform(range(64), lambda b: 0.0::DOUBLE)) AS e
        FROM documents LEFT JOIN ({dense('doc_words', 64)}) w ON w.id = doc_id)""", unit("e"), "doc_id"),
    "hashed_text_search": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
            FROM (SELECT q.id AS query_id, d.id, {r6('list_dot_product(q.v, d.v)')} AS score
                  FROM (SELECT id, {unit('v')} AS v FROM ({dense('item_words', HASH_WIDTH)})) q
                  CROSS JOIN (SELECT doc_id AS id, coalesce(v, list_transform(range({HASH_WIDTH}), lambda b: 0.0::DOUBLE)) AS v
                      FROM documents LEFT JOIN (SELECT id, {unit('v')} AS v FROM ({dense('doc_words', HASH_WIDTH)})) w
                      ON w.id = doc_id) d)) WHERE rank <= {V.TOP_K}""",
    "truth_sets": "SELECT query, result_id FROM truth",
    "truth_size": "SELECT query, count(*) AS relevant FROM truth GROUP BY query",
    "relevance_labels": """
        SELECT approach_id, evaluation, sum((evaluation = 'relevante')::INTEGER)::BIGINT AS relevant, count(*) AS votes
        FROM votes GROUP BY ALL""",
    "retrieval_confusion": "SELECT approach_id, query, tp, fp, fn FROM confusion",
    "retrieval_prf": f"""
        SELECT approach_id, query, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM prf""",
    "retrieval_macro": f"""
        SELECT approach_id, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, queries FROM macro""",
    "metrics_report": f"""
        SELECT approach_id, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
               printf('%.2f%%', round(precision * 100, 2)) AS precision_text,
               printf('%.2f%%', round(recall * 100, 2)) AS recall_text, printf('%.3f', round(f1, 3)) AS f1_text FROM macro""",
    "false_positives": """
        SELECT approach_id, query, result_id FROM retrieved WHERE query IN (SELECT query FROM truth)
        EXCEPT SELECT r.approach_id, t.query, t.result_id FROM truth t CROSS JOIN (SELECT DISTINCT approach_id FROM retrieved) r""",
    "false_negatives": """
        SELECT r.approach_id, t.query, t.result_id
        FROM truth t JOIN (SELECT DISTINCT approach_id, query FROM retrieved) r ON r.query = t.query
        EXCEPT SELECT approach_id, query, result_id FROM retrieved""",
    "retrieved_relevant": f"""
        SELECT query, result_id FROM retrieved WHERE approach_id = {lit(IDS[1])}
        INTERSECT SELECT query, result_id FROM truth""",
    "evaluation_guards": """
        SELECT * FROM (SELECT event_id,
            CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 11 = 0 THEN ' ' ELSE user_id::VARCHAR END AS evaluator,
            CASE WHEN user_id % 13 = 0 THEN '' WHEN user_id % 5 = 0 THEN ' ' ELSE 'q' || (user_id % 10) END AS query
            FROM events) WHERE evaluator <> '' AND query <> ''""",
    "evaluation_events": f"""
        SELECT c.evaluator, c.approach_id, c.query_id AS query, c.result_id, h.type AS result_type, h.page AS result_page,
               h.score AS result_score, CASE WHEN liked THEN 'relevante' ELSE 'nao_relevante' END AS evaluation
        FROM (SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE user_id::VARCHAR END AS evaluator, {APPROACH_SQL} AS approach_id,
                     {KEY}::BIGINT AS query_id, {KEY}::BIGINT + event_id % 3 - 1 AS result_id, value >= 60 AS liked
              FROM events) c
        JOIN hits h ON h.approach_id = c.approach_id AND h.query_id = c.query_id AND h.id = c.result_id
        WHERE c.evaluator <> ''""",
    "rating_records": f"""
        SELECT query_id AS query, {template(V.TEMPLATE_TEXT, _TEXT, _WORDS)} AS result_text,
               'Página ' || page AS page, score AS exact, true AS label_fits
        FROM hits LEFT JOIN documents d ON d.doc_id = hits.id WHERE approach_id = {lit(IDS[0])} AND type = 'text'""",
    "rating_records_multimodal": f"""
        SELECT query_id AS query, CASE type WHEN 'text' THEN 'Texto' ELSE 'Imagem' END AS type,
               CASE WHEN type = 'text' THEN '' WHEN hits.id % 4 <> 0 AND d.text IS NOT NULL THEN
                   {lit(V.IMAGE_TAG_HEAD)} || to_base64(encode(d.text)) || {lit(V.IMAGE_TAG_TAIL + V.IMAGE_CAPTION)}
               ELSE {lit(V.IMAGE_MISSING + V.IMAGE_CAPTION)} END
               || {template(V.TEMPLATE_UNIFIED, _TEXT, _WORDS)} AS content
        FROM hits LEFT JOIN documents d ON d.doc_id = hits.id WHERE approach_id = {lit(IDS[3])}""",
    "ratings_flatten": 'SELECT query, result_text, page, "user", value, relevancia FROM named',
    "ratings_completed": 'SELECT query, page, "user", value FROM named WHERE value IS NOT NULL',
    "rating_overall": f"SELECT {r6('avg(value)')} AS precision, count(value) AS ratings FROM flat",
    "rating_by_user": f"""
        SELECT "user", {r6('avg(value)')} AS precision, count(*) AS ratings FROM named WHERE value IS NOT NULL GROUP BY "user\"""",
    "rating_domain": """
        SELECT doc_id, value, coalesce(value IN (0, 1), false) AS accepted
        FROM (SELECT doc_id, (quality + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END)::INTEGER AS value
              FROM documents LEFT JOIN labels USING (doc_id))""",
    "page_count": "SELECT max(page) AS pages FROM clean",
    "items_per_page_stats": described("items", "(SELECT page, count(*) AS items FROM clean GROUP BY page)", "items"),
    "describe_lengths": " UNION ALL ".join(
        described(c, "measured", c) for c in ("desc_len", "kw_count", "embed_len")),
    "mean_len_by_type": f"SELECT type, {r6('avg(desc_len)')} AS mean_desc_len FROM measured GROUP BY type",
    "count_by_type": "SELECT type, count(*) AS items FROM clean GROUP BY type",
    "column_overview": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) AS rows FROM annotations"
        for c in ("id", "page", "type", "content_path", "original_text", "description_llm", "keywords_llm")),
    "first_rows": "SELECT id, page, type, keywords_llm FROM clean ORDER BY id LIMIT 5",
    "table_counts": """
        SELECT 'annotations' AS table_name, count(*) AS rows FROM annotations
        UNION ALL SELECT 'clean', count(*) FROM clean UNION ALL SELECT 'records', count(*) FROM records""",
    "length_histogram": histogram("measured", "embed_len", V.LENGTH_BINS),
    "page_histogram": histogram("clean", "page", V.PAGE_BINS),
    "top_pages": f"SELECT page, count(*) AS items FROM clean GROUP BY page ORDER BY items DESC, page LIMIT {V.TOP_PAGES}",
    "word_frequency": f"""
        SELECT word, items, {r6('items / max(items) OVER ()')} AS weight FROM (
            SELECT word, count(*) AS items
            FROM (SELECT unnest(regexp_extract_all(lower(description_llm), '{WORD}')) AS word FROM clean)
            WHERE word NOT IN ({STOP}) GROUP BY word ORDER BY items DESC, word LIMIT {V.TOP_WORDS})""",
    "top_ngrams": ngrams("clean", "description_llm", (2, 2)),
    "top_ngrams_two_three": ngrams("documents", "text", (2, 3)),
    "csv_roundtrip": """
        SELECT id, page, type, content_path, original_text, nullif(description_llm, '') AS description_llm, keywords_llm
        FROM annotations""",
    "clean_table_roundtrip": "SELECT id, page, type, text_for_embedding FROM embedded",
    "jsonl_roundtrip": f"SELECT {EVENT_COLUMNS} FROM votes WHERE evaluator <> ''",
    "nested_roundtrip": """
        SELECT query, page, responses, u.user_id, u.value::INTEGER AS value FROM (
            SELECT query, page, (CASE WHEN quality IS NULL THEN 0 ELSE 2 END)::INTEGER AS responses, unnest(
                CASE WHEN quality IS NULL THEN [{user_id: NULL::VARCHAR, value: NULL::BIGINT}] ELSE
                [{user_id: (doc_id % 150)::VARCHAR, value: quality::BIGINT},
                 {user_id: ((doc_id + 1) % 150)::VARCHAR, value: (1 - toxic)::BIGINT}] END) AS u FROM records)""",
    "vector_store_roundtrip": """
        SELECT approach_id, type, id::VARCHAR AS id, page, (i - 1)::INTEGER AS i, round(x::FLOAT::DOUBLE, 5) + 0.0 AS x
        FROM (SELECT approach_id, type, id, page, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM item_units)""",
    "vector_store_status": """
        SELECT approach_id, count(id) AS items, count(id) > 0 AS built, CASE WHEN count(id) > 0 THEN 0::BIGINT END AS failed
        FROM registry LEFT JOIN items USING (approach_id) GROUP BY approach_id""",
    "evaluation_stream": f"SELECT {EVENT_COLUMNS} FROM votes WHERE evaluator <> ''",
    "stream_precision": f"""
        SELECT approach_id, count(*) AS votes, {r6("avg((evaluation = 'relevante')::INTEGER)")} AS precision
        FROM votes GROUP BY approach_id""",
    "annotate_stream": f"""
        SELECT doc_id, id, page, 'text' AS type, coalesce(description_llm, 'second ' || n) AS description_llm,
               coalesce(keywords_llm, 'again') AS keywords_llm FROM ({ANNOTATED})""",
}
# Hashed words of the four inputs an encoder reads, and of the two forms of a query.
_SOURCES = f"""
    SELECT 'passage' AS kind, id, {lit(V.PASSAGE_PREFIX)} || text_for_embedding AS t FROM embedded
    UNION ALL SELECT 'plain', id, text_for_embedding FROM embedded
    UNION ALL SELECT 'unified', id, {template(V.TEMPLATE_UNIFIED)} FROM clean
    UNION ALL SELECT 'file', id, CASE WHEN doc_id % 4 <> 0 THEN d.text END FROM clean JOIN documents d USING (doc_id)
    UNION ALL SELECT 'ask', item_id::VARCHAR, {lit(V.QUERY_PREFIX)} || text FROM benchmark
    UNION ALL SELECT 'ask plain', item_id::VARCHAR, text FROM benchmark"""
VIEWS["hashed"] = f"""
    SELECT kind, id, {unit('v')} AS v FROM (
        SELECT kind, id, list_transform(range(64), lambda b: coalesce(m[b], 0)::DOUBLE) AS v FROM (
            SELECT kind, id, map_from_entries(list((b, n))) AS m FROM (
                SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*) AS n
                FROM (SELECT kind, id, unnest(regexp_extract_all(lower(t), '{WORD}')) AS w FROM ({_SOURCES}))
                GROUP BY ALL) GROUP BY kind, id))"""
_ZERO = "list_transform(range(64), lambda b: 0.0::DOUBLE)"
VIEWS["built"] = f"""
    WITH rows AS (SELECT c.id, c.type, c.page, p.v AS passage, t.v AS plain, u.v AS unified, f.v AS file
        FROM clean c LEFT JOIN hashed p ON p.id = c.id AND p.kind = 'passage'
        LEFT JOIN hashed t ON t.id = c.id AND t.kind = 'plain' LEFT JOIN hashed u ON u.id = c.id AND u.kind = 'unified'
        LEFT JOIN hashed f ON f.id = c.id AND f.kind = 'file' WHERE c.type IN ('text', 'image'))
    SELECT {lit(IDS[0])} AS approach_id, id, type, page, passage AS v FROM rows
    UNION ALL SELECT {lit(IDS[1])}, id, type, page, CASE WHEN type = 'text' THEN passage WHEN file IS NULL THEN {_ZERO}
        ELSE {unit(fused('file', 'plain'))} END FROM rows
    UNION ALL SELECT {lit(IDS[2])}, id, type, page, CASE WHEN type = 'text' THEN plain ELSE coalesce(file, {_ZERO}) END FROM rows
    UNION ALL SELECT {lit(IDS[3])}, id, type, page, CASE WHEN type = 'text' THEN unified WHEN file IS NULL THEN {_ZERO}
        ELSE {unit(fused('file', 'unified'))} END FROM rows"""
_QUERIES["search_job"] = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY approach_id, type, query_id ORDER BY score DESC, id)::INTEGER AS rank
        FROM (SELECT b.approach_id, b.type, q.id::BIGINT AS query_id, b.id, b.page, {r6('list_dot_product(q.v, b.v)')} AS score
              FROM built b JOIN hashed q ON q.kind = CASE WHEN b.approach_id = {lit(IDS[0])}
                  OR (b.approach_id = {lit(IDS[1])} AND b.type = 'text') THEN 'ask' ELSE 'ask plain' END))
    WHERE rank <= {V.TOP_K}"""
_QUERIES["approach_lookup"] = f"""
    SELECT approach_id, votes, text_model, image_model, image_from, template
    FROM (SELECT approach_id, count(*) AS votes FROM votes GROUP BY approach_id)
    LEFT JOIN (VALUES {', '.join(
        "(" + lits([a.approach_id, a.text_model, a.image_model, a.image_from,
                    'unified' if isinstance(a.templates, str) else 'by_type']) + ")" for a in REGISTRY)})
        r(approach_id, text_model, image_model, image_from, template) USING (approach_id)"""
_QUERIES["rebuild_vectors"] = coordinates("built", unit("v"), "approach_id", "type", "id", "page")


def _sources_of(description):
    """The texts that the text models of all approaches read, for one form of the description."""
    by_type = f"CASE type WHEN 'text' THEN {template(V.TEMPLATE_TEXT, description)} ELSE {template(V.TEMPLATE_IMAGE, description)} END"
    rows = "FROM clean WHERE type IN ('text', 'image')"
    return f"""SELECT {lit(V.TEXT_MODEL)} AS model, {lit(V.PASSAGE_PREFIX)} || {by_type} AS t {rows}
        UNION SELECT {lit(V.JOINT_MODEL)}, {by_type} {rows}
        UNION SELECT {lit(V.JOINT_MODEL)}, {template(V.TEMPLATE_UNIFIED, description)} {rows}"""


_EARLIER = "CASE WHEN doc_id % 5 = 0 THEN 'earlier ' || description_llm ELSE description_llm END"
VIEWS["asked_first"], VIEWS["asked_second"] = _sources_of(_EARLIER), _sources_of("description_llm")
VIEWS["asked_files"] = "SELECT DISTINCT d.text AS t FROM clean JOIN documents d USING (doc_id) WHERE type = 'image' AND doc_id % 4 <> 0"
_QUERIES["rebuild_encodes"] = f"""
    SELECT run, model, kind, count(*) AS encoded FROM (
        SELECT 'first' AS run, model, 'text' AS kind, t FROM asked_first
        UNION ALL SELECT 'second', model, 'text', t FROM (SELECT * FROM asked_second EXCEPT SELECT * FROM asked_first)
        UNION ALL SELECT 'first', {lit(V.JOINT_MODEL)}, 'image', t FROM asked_files)
    WHERE regexp_matches(lower(t), '{WORD}') GROUP BY run, model, kind"""
_QUERIES["topk_search_grid"] = _QUERIES["topk_search_clustered"] = _QUERIES["topk_search"]
_QUERIES["stream_quality"] = _QUERIES["retrieval_macro"]

SQL = {name: with_views(sql) for name, sql in _QUERIES.items()}

SQL["retrieval_flagship"] = with_views(_QUERIES["retrieval_macro"], {**VIEWS, "votes": HITS_AS_VOTES})
