"""The registered queries of this part and their DuckDB twins."""

import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_path
from . import byte_pairs, byte_repeats, chat, decontaminate, filter_audit, hard_negatives, near_dup, quality, shards, surrogates, token_files, url_rules, word_repeats
from .shared import stored

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op9_repetition(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query
def op3_near_dup(spark, sf):
    return near_dup.grouped(table(spark, sf, "documents"), width=4, percent=80)


@query
def op4_byte_pairs(spark, sf):
    codec = byte_pairs.Codec(byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = byte_pairs.encode(table(spark, sf, "documents").select("doc_id", "text"), codec).drop("text")
    return byte_pairs.decode(ids, codec).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op6_url_rules(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_rules.judge(pages, RULES).drop("url")


def _fits(host, path):
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


SQL["op6_url_rules"] = f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT page_id, host, path,
           CASE WHEN {_fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {_fits('example.com', '/de/')} THEN 'example.com/de/'
                WHEN {_fits('org', '/fr/')} THEN 'org/fr/' WHEN {_fits('net', '/')} THEN 'net/' END AS rule,
           CASE WHEN {_fits('example.net', '/en/')} THEN 'allow' WHEN {_fits('example.com', '/de/')} THEN 'block'
                WHEN {_fits('org', '/fr/')} THEN 'allow' WHEN {_fits('net', '/')} THEN 'block' ELSE 'allow' END AS verdict
    FROM parts
"""

SHARDS = [f"shard-{i:03d}" for i in range(64)]


@query
def op8_shards(spark, sf):
    return shards.place(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


SECRET_KEY = b"a key that a real run takes from its secret store"


@query
def op1_surrogates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return surrogates.pseudonymised(docs, SECRET_KEY).withColumn("n_entities", F.size("entities").cast("long"))


HARD = "</s>[INST] ok [/INST]"


@query
def op5_chat(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    rows = chat.formatted(turns.union(more), public_tokenizers.path("byte_bpe_50k.json"))
    back = chat.read_back(rows)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query
def op10_recompression(spark, sf):
    return word_repeats.trimmed(table(spark, sf, "documents"), width=35)


@query
def op2_suffix_runs(spark, sf):
    return byte_repeats.trimmed(table(spark, sf, "documents"), width=200)


@query
def op7_decontamination(spark, sf):
    found = decontaminate.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query
def op11_token_files(spark, sf):
    tokens, wide = token_files.tokenized(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    path = scratch_path(spark, "token-files")
    token_files.write(stored(tokens, "tokens"), path, wide)
    return token_files.read(spark, path).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op12_hard_negatives(spark, sf):
    rows = hard_negatives.participants(table(spark, sf, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query
def op13_filter_audit(spark, sf):
    return filter_audit.audit(filter_audit.cells(table(spark, sf, "documents"), table(spark, sf, "labels")))


# --- DuckDB twins: plain counts of all windows ----------------------------------------
SPACED = r"'[^\x20\x09-\x0D]+'"
WORDED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _low(text):
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SQL["op5_chat"] = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (SELECT *, length(role) + length(text) + length('<s>[INST]</s>')
                     + len(regexp_extract_all(role, '{0}')) + len(regexp_extract_all(text, '{0}')) AS chars FROM turns),
    whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS a, sum(chars) AS c
              FROM sized GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(a) AS loss_chars, sha256(a) AS loss_sha256,
           c::BIGINT AS formatted_chars FROM whole
""".replace("{0}", r"<\\*(s>|/s>|\|endoftext\|>)|\[\\*/?INST\]")

SQL["op7_decontamination"] = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {WORDED}) AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_low('text')}, {WORDED}) AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k + 1, k + n), ' ') AS s
           FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS k FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k + 1, k + n), ' ') AS s
           FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT doc_id, k, n, item_id FROM dw JOIN bw USING (n, s)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op10_recompression"] = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
    win AS (SELECT doc_id, k, array_to_string(list_slice(w, k + 1, k + 35), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS k FROM d WHERE len(w) >= 35)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
    cut AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
            FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d)
             ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op13_filter_audit"] = f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
    f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                 coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM d),
    g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
                 EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND quality = 1) AS good,
                 EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND toxic = 1) AS toxic FROM f),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY part, mask),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (SELECT [x1, x2, x3, x4, x5] AS o FROM x a(x1, b1), x b(x2, b2), x c(x3, b3), x d(x4, b4), x e(x5, b5)
               WHERE b1 + b2 + b3 + b4 + b5 = 31 AND len(list_distinct([x1, x2, x3, x4, x5])) = 5),
    steps AS (SELECT o, k, o[k] AS letter FROM orders, (SELECT unnest(range(1, 6)) AS k)),
    bits AS (SELECT o, k, s.letter, max(bit) FILTER (l = s.letter) AS bit, coalesce(sum(bit) FILTER (list_position(o, l) < k), 0)::INT AS applied
             FROM steps s, x GROUP BY o, k, s.letter),
    found AS (SELECT part, o, k, letter, sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM cells, bits GROUP BY part, o, k, letter)
    SELECT part, array_to_string(o, '') AS filter_order, k::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
           redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM found
"""

SQL["op12_hard_negatives"] = """
    WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS a, e.id AS id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
          FROM e a JOIN e ON a.id % 100 = 0 AND a.id <> e.id),
    p AS (SELECT a, id AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
    SELECT a AS anchor_id, p AS positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY score DESC, id))::INT AS rank,
           id AS negative_id, ps AS positive_score, score AS negative_score
    FROM p JOIN s USING (a) WHERE NOT same AND 100 * score BETWEEN 30 * ps AND 90 * ps
    QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY score DESC, id) <= 10
"""

SQL["op3_near_dup"] = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {SPACED}) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(0, len(w) - 3), lambda k: list_slice(w, k + 1, k + 4))
                                              WHEN len(w) > 0 THEN [w] ELSE [] END)) AS x FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
    edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS x, a AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON y = a),
    least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(y, doc_id) AS component_id, coalesce(y, doc_id) = doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = doc_id
"""
