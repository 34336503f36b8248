"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from textveil.llm.crc import POLYNOMIAL
from textveil.llm.jaccard_join import NGRAM, PERCENT
from textveil.llm.mixing import BLOCK, DECIMALS, HALVINGS, MOST_BLOCKS, MOST_REPEATS, TARGET_ENTROPY, WORDS
from textveil.llm.quality import BUCKETS, FEWEST, MOST_REPEATED, PRIOR, SYMBOLS, THRESHOLD, TRUSTED, WINDOW

OP3 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS n_tokens FROM documents
), s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
k AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n, min(tokens)::DOUBLE AS least, max(tokens)::DOUBLE AS most FROM s WHERE tokens > 0),
p AS (SELECT tokens / total AS p FROM s, k WHERE tokens > 0),
h1 AS (SELECT -sum(p * ln(p)) >= {TARGET_ENTROPY} * ln(count(*)) AS ok FROM p),
he(step, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid,
          (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) >= {TARGET_ENTROPY} * ln(count(*)) FROM p) AS ok
        FROM he WHERE step < {HALVINGS})
), hr(step, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid, pow(most / least, 1 - (low + high) / 2) > {MOST_REPEATS} AS ok FROM hr, k WHERE step < {HALVINGS})
), a AS (
  SELECT CASE WHEN n <= 1 OR least = most THEN 1.0 ELSE round(greatest(
    CASE WHEN (SELECT ok FROM h1) THEN 1.0 ELSE (SELECT max(low) FROM he) END,
    CASE WHEN most / least <= {MOST_REPEATS} THEN 0.0 ELSE (SELECT max(low) FROM hr) END), {DECIMALS}) END::DOUBLE AS a, most FROM k
), q AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(tokens * pow(tokens / most, a - 1) + 1e-6) ELSE 0 END::BIGINT AS quota FROM s, a),
g AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS part,
    greatest(1, least({MOST_BLOCKS}, tokens // {BLOCK})) AS n_blocks FROM q
), dealt AS (
  SELECT d.*, epochs, part, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % n_blocks)::INT AS block FROM d JOIN g USING (source)
), sums AS (SELECT source, epochs, part, block, sum(n_tokens) AS tokens FROM dealt WHERE part > 0 GROUP BY ALL),
last AS (
  SELECT source, block, room, tokens <= room AS whole FROM (
    SELECT *, part - coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY md5(source || '|' || epochs || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM sums)
  WHERE room >= 0
), taken AS (
  SELECT doc_id, source, n_tokens, unnest(range(epochs + CASE WHEN whole THEN 1 ELSE 0 END)) AS epoch, block FROM dealt LEFT JOIN last USING (source, block)
  UNION ALL
  SELECT doc_id, source, n_tokens, epochs, block FROM (
    SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY md5(epochs || '|' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS up_to
    FROM dealt JOIN last USING (source, block) WHERE NOT whole)
  WHERE up_to <= room
)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, block, (row_number() OVER (PARTITION BY source, epoch, block ORDER BY md5(epoch || '|' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens) - 1)::INT AS slot
FROM taken
"""

OP5 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS role_chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(text_chars + CASE WHEN opens THEN length('<|turn|>') + role_chars + 1 + length('<|end|>') + 1 ELSE length('<|and|>') END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), r AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM r) WHERE rank <= 5
"""

#: CRC-32 by bytes, with the table that its polynomial gives.
_TABLE = [0] * 256
for _n in range(256):
    _c = _n
    for _ in range(8):
        _c = (_c >> 1) ^ (POLYNOMIAL if _c & 1 else 0)
    _TABLE[_n] = _c

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
), w AS (SELECT row, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
grams8 AS (
  SELECT row, k, list(word) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g FROM w
), twice AS (
  SELECT row, k, count(*) OVER (PARTITION BY row, g) > 1 AS again FROM grams8 WHERE len(g) = {WINDOW}
), repeated AS (
  SELECT row, sum(least({WINDOW}, next - k)) AS n_repeat_words
  FROM (SELECT row, k, coalesce(lead(k) OVER (PARTITION BY row ORDER BY k), k + {WINDOW}) AS next FROM twice WHERE again) GROUP BY row
), lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORDS}') GROUP BY row
), octets AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
crcs AS (
  SELECT word, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT),
    lambda c, b: xor(({_TABLE})[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM octets
), n AS (
  SELECT row, doc_id, crc % {BUCKETS} AS bucket FROM w JOIN crcs USING (word)
  UNION ALL
  SELECT row, doc_id, {BUCKETS} + (crc * 31 + next) % {BUCKETS} FROM (SELECT row, doc_id, crc, lead(crc) OVER (PARTITION BY row ORDER BY k) AS next FROM w JOIN crcs USING (word)) WHERE next IS NOT NULL
), good AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED}
), counts AS (SELECT bucket, bucket >= {BUCKETS} AS pairs, count(*) AS raw, count(good.doc_id) AS trusted FROM n LEFT JOIN good USING (doc_id) GROUP BY bucket),
ratios AS (
  SELECT bucket, ln((trusted + {PRIOR}) / (raw * all_trusted / all_raw + {PRIOR})) AS ratio
  FROM counts JOIN (SELECT pairs, sum(raw) AS all_raw, sum(trusted) AS all_trusted FROM counts GROUP BY pairs) USING (pairs)
), scores AS (SELECT row, avg(ratio) AS score FROM n JOIN ratios USING (bucket) GROUP BY row),
base AS (
  SELECT d.row, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(score, 0) AS score
  FROM d LEFT JOIN lines USING (row) LEFT JOIN repeated USING (row) LEFT JOIN scores USING (row)
), failed AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {THRESHOLD} AS kept FROM failed
"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < {NGRAM} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {NGRAM} + 2), lambda k: array_to_string(words[k:k + {NGRAM} - 1], ' ')) END) AS shingle FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= {PERCENT} * (a.n + b.n - i)),
reach(doc_id, to_id) AS (SELECT x, y FROM links UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.to_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

SQL = {"op8_jaccard_join": OP8, "op7_quality_rules": OP7, "op3_mixing": OP3, "op5_chat_formatting": OP5, "op10_top_k": OP10}
