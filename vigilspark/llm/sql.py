"""DuckDB SQL for those queries of this subpackage that SQL can express."""

#: tab: the table of the CRC-32 of ISO 3309, by its rule.
_CRC = """bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def _run(digits: str, start: int) -> str:
    """The register after the bytes of a text of hex digits; tab of the CTE crc is in scope."""
    octets = f"list_transform(range(1, len({digits}), 2), lambda i: ('0x' || {digits}[i:i + 1])::BIGINT)"
    return f"list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), {start})"


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a short text's UTF-8 bytes."""
    return f"xor({_run(f'hex(encode({text}))', 4294967295)}, 4294967295)"


#: CRC-32 (h_crc: id, text_crc32) of the texts of hx (id, h: hex digits): bytes beyond whole blocks of 256 come first, each block's register is then moved on linearly.
_LONG_CRC = f"""z AS (SELECT i, 1::BIGINT << i AS v, 0 AS k FROM range(32) t(i) UNION ALL SELECT i, xor(v >> 8, tab[(v & 255) + 1]), k + 1 FROM z, crc WHERE k < 256),
ahead AS (SELECT list(v ORDER BY i) AS adv FROM z WHERE k = 256),
heads AS (SELECT id, {_run("h[:len(h) % 512]", 4294967295)} AS s FROM hx, crc),
blocks AS (SELECT id, i, {_run("b", 0)} AS r FROM (SELECT id, i, h[i:i + 511] AS b FROM (SELECT id, h, unnest(range(len(h) % 512 + 1, len(h), 512)) AS i FROM hx)), crc),
listed AS (SELECT id, list(r ORDER BY i) AS rs FROM blocks GROUP BY id),
h_crc AS (SELECT id, xor(list_reduce(coalesce(rs, []), lambda s, r: xor(r, list_reduce(list_transform(range(32), lambda i: CASE WHEN (s >> i) & 1 = 1 THEN adv[i + 1] ELSE 0 END), lambda a, b: xor(a, b))), s), 4294967295) AS text_crc32 FROM heads LEFT JOIN listed USING (id), ahead)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of the distinct four-word shingles of each document, links between documents, and what links reach.
_LINKS = f"""w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
one AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)"""

ORACLES: dict[str, str] = {
    "op2_near_copies": f"""
WITH RECURSIVE {_LINKS}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id FROM s LEFT JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(s.s)
""",
    "op2_near_links": f"""
WITH RECURSIVE {_LINKS},
c AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM s),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, class_id, least(c.doc_id, coalesce(m.least, c.doc_id)) AS component_id, coalesce(k.n, 0)::BIGINT AS n_links FROM c LEFT JOIN m ON m.a = c.doc_id LEFT JOIN k ON k.a = c.doc_id
""",
    "op12_shards": f"""
WITH RECURSIVE {_CRC},
hx AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
{_LONG_CRC},
d AS (SELECT id, doc_id, len(h) // 2 + 1 AS size, text_crc32, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:16])::UBIGINT::HUGEINT AS key FROM hx JOIN h_crc USING (id)),
walk AS (SELECT id, key, -1::BIGINT AS b, 0::BIGINT AS j FROM d UNION ALL
  SELECT id, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM walk WHERE j < 16)),
ends AS (SELECT id, max(j) FILTER (j < 16) AS shard, CASE WHEN max(j) = 16 THEN 16 ELSE max(j) FILTER (j < 16) END AS grown FROM walk GROUP BY id)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard FROM d JOIN ends USING (id)
""",
    "op11_spelling": f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
once AS (SELECT doc_id, w, count(*) AS m FROM runs GROUP BY ALL),
h AS (SELECT w, m, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM once, crc),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, m FROM h),
words AS (SELECT word, sum(m)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
gap AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS g FROM words, unnest(range(1, length(word) + 1)) t(i)),
pairs AS (SELECT a.word AS a, b.word AS b FROM gap a JOIN gap b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM gap a JOIN words b ON a.g = b.word UNION SELECT b.word, a.word FROM gap a JOIN words b ON a.g = b.word),
best AS (SELECT p.a, count(*) AS n_near, arg_min(struct_pack(w := w.word, n := w.n), struct_pack(n := -w.n, w := encode(w.word))) AS f FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * n THEN f.w END AS form, CASE WHEN f.n >= 2 * n THEN f.n END AS form_n FROM words LEFT JOIN best ON a = word),
follow AS (SELECT word, word AS root, form FROM named UNION ALL SELECT f.word, n.word, n.form FROM follow f JOIN named n ON n.word = f.form)
SELECT n.word, n.form, f.root, n.n, n.n_near, n.form_n FROM named n JOIN follow f ON f.word = n.word AND f.form IS NULL
""",
    "op13_collocations": f"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w, count(*) AS m FROM cut GROUP BY ALL),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, sum(m)::HUGEINT AS f FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k)) GROUP BY ALL),
tot AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, 1000 * c.a * n // (l.f * r.f) AS score, j FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ') JOIN tot ON tot.lang = c.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, k, unnest(list_transform(flatten(list_transform(range(2, k), lambda n: list_transform(range(1, k - n + 2), lambda i: w[i:i + n - 1]))), lambda x: array_to_string(x, ' '))) AS phrase FROM c) s JOIN c ON c.lang = s.lang AND c.phrase = s.phrase AND 100 * s.a >= 100 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""",
}
