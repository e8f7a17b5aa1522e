"""SQL twins of the queries that SQL can say, for DuckDB over the same tables."""

from __future__ import annotations

_WORD, _SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

#: Rows of a table have a number each, since doc_id may repeat.
_ROWS = "d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents)"

OVERLAPS = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]+', '', 'g'), '\s+'), lambda w: w <> '') AS w FROM documents),
 iw AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]+', '', 'g'), '\s+'), lambda w: w <> '') AS w FROM benchmark),
 dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM dw),
 it AS (SELECT item_id, len(w) AS n, least(len(w), 13) AS need, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM iw WHERE len(w) >= 5),
 eq AS (SELECT doc_id, item_id, dt.pos - it.pos AS diag, it.pos AS pos, need, it.n AS n_item, dt.n AS n_doc FROM dt JOIN it USING (tok)),
 lines AS (SELECT doc_id, item_id, diag, any_value(need) AS need, greatest(0, -diag) AS a, least(any_value(n_item), any_value(n_doc) - diag) AS b, list(pos) AS same
  FROM eq GROUP BY doc_id, item_id, diag HAVING count(*) >= ceil(0.8 * any_value(need))),
 starts AS (SELECT *, unnest(generate_series(a, b - need)) AS s FROM lines WHERE b - a >= need),
 good AS (SELECT doc_id, item_id, diag, need, same, list(s) AS ss, min(s) AS low FROM starts WHERE len(list_filter(same, lambda p: p >= s AND p < s + need)) >= ceil(0.8 * need) GROUP BY ALL),
 covered AS (SELECT *, list_distinct(flatten(list_transform(ss, lambda s: generate_series(s, s + need - 1)))) AS c FROM good),
 told AS (SELECT doc_id, item_id, (diag + low)::BIGINT AS start, len(c)::BIGINT AS n_tokens, len(list_filter(same, lambda p: list_contains(c, p)))::BIGINT AS n_equal FROM covered),
 best AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start, n_tokens DESC) = 1)
SELECT * FROM best UNION ALL
SELECT doc_id, item_id, 0, len(iw.w), len(iw.w) FROM dw JOIN iw ON dw.w = iw.w WHERE len(iw.w) BETWEEN 1 AND 4"""

REPEATS = rf"""
WITH {_ROWS}, b AS (SELECT *, octet_length(encode(text)) AS n, lower(hex(encode(text))) AS x, list_filter(string_split_regex(text, '{_SPACES}'), lambda w: w <> '') AS w FROM d),
 windows AS (SELECT r, i, hash(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(generate_series(0, n - 400)) AS i FROM b WHERE n >= 400)),
 again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
 hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows SEMI JOIN again USING (h)),
 spans AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
 stay AS (SELECT r, string_agg(substr(x, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS head, max(z) AS z, sum(z - a)::BIGINT AS gone, count(*) AS k
  FROM (SELECT s.*, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS prior FROM spans s) JOIN b USING (r) GROUP BY r),
 pw AS (SELECT r, i, hash(array_to_string(w[i + 1:i + 51], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(0, len(w) - 51)) AS i FROM b WHERE len(w) >= 51)),
 pagain AS (SELECT h FROM pw GROUP BY h HAVING count(DISTINCT r) > 1),
 phit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM pw SEMI JOIN pagain USING (h)),
 pruns AS (SELECT r, count(*) AS n_passages FROM phit WHERE before IS NULL OR i > before + 51 GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
 sha256(CASE WHEN k IS NULL THEN encode(text) ELSE from_hex(head || substr(x, 2 * z + 1)) END) AS kept_sha256, coalesce(n_passages, 0)::BIGINT AS n_passages
FROM b LEFT JOIN stay USING (r) LEFT JOIN pruns USING (r)"""

_CONTROLS = r"\\|<\||\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<start_of_turn>|<end_of_turn>"

CHATS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) + length(role) - length(replace(role, chr(10), '')) + length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + 17 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

QUALITY = rf"""
WITH {_ROWS}, w AS (SELECT *, list_filter(string_split_regex(text, '{_SPACES}'), lambda w: w <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
 win AS (SELECT r, i, a FROM (SELECT r, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i:i + 2])) AS a, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
 twice AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT *, count(*) OVER (PARTITION BY r, a) AS k FROM win) WHERE k > 1),
 rep AS (SELECT r, sum(CASE WHEN before IS NULL THEN 3 ELSE least(3, i - before) END)::BIGINT AS n FROM twice GROUP BY r),
 m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 hosts AS (SELECT source AS host, count(*)::DOUBLE AS k, count(*) FILTER (base_failed)::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
 p AS (SELECT coalesce(sum(bad) / sum(k), 0) AS mean, coalesce(var_pop(bad / k), 0) AS var, coalesce(avg(1 / k), 0) AS inv FROM hosts),
 q AS (SELECT mean, greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-6) - 1, 1e-3) AS strength FROM p),
 judged AS (SELECT host FROM hosts, q WHERE (bad + mean * strength) / (k + strength) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host IS NULL AS kept FROM f LEFT JOIN judged ON source = host"""

#: Equal texts, the row with the largest doc_id stays; of repeated rows one.
EXACT = f"""
WITH {_ROWS}, k AS (SELECT r, doc_id, sha256(text) AS text_sha256, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST, r) AS nth, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, nth = 1 AS kept, text_sha256 FROM k"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = rf"""
WITH {_ROWS}, t AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts FROM d),
 c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM t WHERE len(ts) > 0),
 p AS (SELECT r, doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM t) GROUP BY ALL),
 q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
 w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
 s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL HAVING score > 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10"""


def _centroids(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assignment and means, one after another."""
    far = """d{i} AS MATERIALIZED (SELECT r, j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS far FROM v JOIN c{i} c USING (dim) GROUP BY r, j),
 a{i} AS MATERIALIZED (SELECT r, arg_min(j, (far, j)) AS j, min(far) AS far FROM d{i} GROUP BY r),"""
    mean = """m{i} AS (SELECT j, dim, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{before} USING (r) GROUP BY j, dim),
 c{i} AS MATERIALIZED (SELECT j, dim, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{before} c LEFT JOIN m{i} USING (j, dim)),"""
    steps = " ".join(mean.format(i=i, before=i - 1) + "\n " + far.format(i=i) for i in range(1, rounds + 1))
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 v AS MATERIALIZED (SELECT r, vec_id, unnest(range(1, 65)) AS dim, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
 first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS j FROM e QUALIFY j < {k}),
 c0 AS MATERIALIZED (SELECT j, dim, x FROM v JOIN first USING (r)), {far.format(i=0)} {steps}
 sums AS (SELECT j, sum(far)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY j),
 named AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j::INTEGER AS cluster, far AS distance, cluster_inertia, (SELECT sum(far)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256 FROM e JOIN a{rounds} USING (r) JOIN sums USING (j) JOIN named USING (j)"""


ORACLE_SQL = {"op4_decontamination": OVERLAPS, "op5_suffix_dedup": REPEATS, "op6_reply_trees": CHATS, "op9_quality_rules": QUALITY, "op11_centroids": _centroids(), "op12_exact_dedup": EXACT, "op13_ranked_search": RANKED}
