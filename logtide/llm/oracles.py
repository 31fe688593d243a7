"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from string import Template

from .sharding import layout

_OP1 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS r,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, text_sha256 FROM w
"""

_OP3 = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / (CASE WHEN length(text) = 0 THEN 1.0::DOUBLE ELSE
    greatest(0.1::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * (CAST(length(text) - length(translate(text, '#*$%&|<>!', '')) AS DOUBLE) / CAST(length(text) AS DOUBLE))) END) AS sample_key
  FROM t
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM k GROUP BY source
), r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)
), g AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(rate) OVER () * weight) AS target FROM r
), j AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY sample_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM j
"""

_OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, regexp_replace(role, '(\\*(?:</?s>|\[/?INST\]))', '\\\1', 'g') AS r,
            regexp_replace(text, '(\\*(?:</?s>|\[/?INST\]))', '\\\1', 'g') AS t
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST] ' || r || ' [/INST]' || chr(10) || t || chr(10) || '</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _unit(parts: str) -> str:
    return f"(CAST(('0x' || substr(md5({parts}), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def _op7() -> str:
    def level(n: int, name: str, parent: str | None, child: str, above: str) -> str:
        sums: dict[tuple[int, int], float] = {}
        for s in layout(n):
            key = (getattr(s, parent) if parent else 0, getattr(s, child))
            sums[key] = sums.get(key, 0.0) + s.weight
        values = ", ".join(f"({p}, {c}, {w}::DOUBLE)" for (p, c), w in sums.items())
        at = "a.at" if parent else "0"
        draw = _unit(f"a.id || ':{child}' || v.c")
        return f"{name} AS (SELECT a.id, arg_min(v.c, -ln({draw}) / v.w) AS at FROM {above} a JOIN (VALUES {values}) v(p, c, w) ON v.p = {at} GROUP BY a.id)"

    steps = []
    for n, tag in ((40, "b"), (41, "g")):
        steps += [
            level(n, f"{tag}1", None, "region", "ids"),
            level(n, f"{tag}2", "region", "rack", f"{tag}1"),
            level(n, f"{tag}3", "rack", "shard", f"{tag}2"),
        ]
    # DuckDB has no crc32: eight table steps a byte are unrolled by a fold over the bytes of the text's hex form.
    return f"""
WITH ids AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents), {", ".join(steps)},
t AS (
  SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) + 16 AS BIGINT) AS size, b3.at AS shard, g3.at AS grown,
         floor({_unit("'slot:' || coalesce(CAST(d.doc_id AS VARCHAR), '')")} * 1024) AS bucket, coalesce(d.text, '') AS text
  FROM documents d JOIN b3 ON b3.id = coalesce(CAST(d.doc_id AS VARCHAR), '') JOIN g3 ON g3.id = b3.id
), tab AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))
)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 16), lambda p: CAST(('0x' || substr(hex(encode(text)), 2 * p + 1, 2)) AS BIGINT))),
           lambda x, b: xor(x >> 8, crc[(xor(x, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
       'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM t, tab
"""


_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

_OP10 = r"""
WITH ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, i, lines[i] AS line, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS ws
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM ls)),
f AS (SELECT array_to_string(ws, ' ') AS s, len(ws) AS n, any_value(ws) AS ws, min({'d': doc_id, 'i': i}) AS loc FROM x WHERE len(ws) > 0 GROUP BY 1, 2),
v AS (SELECT n, s, loc, p, array_to_string(list_concat(list_slice(ws, 1, p - 1), list_slice(ws, p + 1, n)), ' ') AS v
      FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM f WHERE n >= 6)),
pairs AS (
  SELECT late.s FROM v late JOIN (SELECT n, p, v, min(loc) AS loc FROM v GROUP BY 1, 2, 3) early
    ON early.n = late.n AND early.p = late.p AND early.v = late.v AND early.loc < late.loc
  UNION SELECT CASE WHEN v.loc > f.loc THEN v.s ELSE f.s END FROM v JOIN f ON f.n = v.n - 1 AND f.n >= 6 AND f.s = v.v
), flagged AS (
  SELECT x.doc_id, x.i, x.line,
         len(x.ws) > 0 AND ({'d': x.doc_id, 'i': x.i} <> f.loc OR p.s IS NOT NULL) AS gone
  FROM x LEFT JOIN f ON f.s = array_to_string(x.ws, ' ') AND len(x.ws) > 0 LEFT JOIN pairs p ON p.s = f.s
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS BIGINT) AS kept_chars,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM flagged GROUP BY doc_id
"""

#: crc32 of the decimal doc_id: a table of 256 remainders, and a fold over the bytes.
_CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda x, b: xor(x >> 8, crc[(xor(x, b) & 255) + 1])), 4294967295::BIGINT)"""

_OP11 = r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), items AS (
  SELECT DISTINCT id AS item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM words WHERE kind = 'b' AND len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM items), places AS (
  SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT words.*, sizes.m, unnest(generate_series(1, len(w) - sizes.m + 1)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= sizes.m)
), hits AS (SELECT p.row, p.i, p.m, t.item FROM places p JOIN items t ON p.m = t.m AND p.win = t.win
), covered AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + m - 1)) AS k FROM (SELECT DISTINCT row, i, m FROM hits)) GROUP BY row
), named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, coalesce(CAST(item AS VARCHAR), '') AS item FROM hits) GROUP BY row)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
WHERE w.kind = 'd'
"""

_OP12 = r"""
WITH $table, src AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents
), crc AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE $crc END AS h, len(w0) AS n FROM src, tab
), plan AS (
  SELECT *, h % 10 = 0 AND n > 0 AS changed, (h // 10) % greatest(n, 1) AS a, h // 10 AS g FROM crc
), text AS (
  SELECT row, doc_id, CASE WHEN changed THEN w0[:a] || list_transform(range(0, n - a), lambda k: w0[a + k % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE w0 END AS w FROM plan
), places AS (SELECT row, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM text
), equal AS (
  SELECT a.row, a.i, b.i - a.i AS p FROM places a JOIN places b ON a.row = b.row AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4
), island AS (SELECT row, p, i, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS g FROM equal
), stretch AS (SELECT row, min(i) AS start, count(*) + p AS length, p FROM island GROUP BY row, p, g HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (SELECT row, start, length, min(p) AS period FROM stretch GROUP BY row, start, length
), dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM places p WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.row = p.row AND d.i = p.i) GROUP BY row
), told AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row
), best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.row = r.row AND (o.length * r.period > r.length * o.period
      OR o.length * r.period = r.length * o.period AND (o.start < r.start OR o.start = r.start AND o.period < r.period)))
)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
       CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM text t LEFT JOIN told USING (row) LEFT JOIN best b USING (row) LEFT JOIN kept k USING (row)
"""



def _field(name: str, value: str | None = None) -> str:
    text = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_OP13 = r"""
WITH RECURSIVE $table, leaves AS (
  SELECT row_number() OVER () AS row, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         sha256(concat($doc_id, $source, $lang, $n_chars, $text)) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND $crc % 7 = 0 THEN sha256(concat($doc_id, $source, $lang, $more, $text))
              ELSE sha256(concat($doc_id, $source, $lang, $n_chars, $text)) END AS start
  FROM documents, tab
), nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), inner_climb AS (
  SELECT row, tree, 0 AS level, pos, n, start AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.row, c.tree, c.level + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.proof || coalesce(s.digest, '')
  FROM inner_climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
), outer_climb AS (
  SELECT row, 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, folded, proof FROM inner_climb WHERE n = 1
  UNION ALL
  SELECT c.row, c.level + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.proof || coalesce(s.digest, '')
  FROM outer_climb c LEFT JOIN tops s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
)
SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
FROM leaves l JOIN subroots r USING (tree) JOIN outer_climb c USING (row), tops t
WHERE c.n = 1 AND t.n = 1
"""

_FIELDS = {name: _field(name) for name in ("doc_id", "source", "lang", "n_chars", "text")} | {"more": _field("n_chars", "(n_chars + 1)")}


def _filled(sql: str) -> str:
    return Template(sql).substitute(_FIELDS, table=_CRC_TABLE, crc=_CRC)


ORACLES: dict[str, str] = {
    "op1_exact_dedup": _OP1, "op3_source_mixing": _OP3, "op4_chat_format": _OP4, "op7_sharding": _op7(), "op8_ngram_jaccard": _OP8, "op10_line_dedup": _OP10,
    "op11_decontamination": _OP11, "op12_periodic_runs": _filled(_OP12), "op13_merkle_manifest": _filled(_OP13),
}
