"""SQL of the chunkers for DuckDB, from the description of their results: recursive splitting level by level, packing one part at a time.

Separators are tried from strong to weak; a text goes down to the first one that it holds. The results of a level are put together from those of
the levels below it.
"""

from __future__ import annotations

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "'; '", "', '", "' '")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def split(roots: str, size: int = 1000, overlap: int = 200) -> str:
    """CTEs that end in ``pieces`` (root, ord, piece): the recursive split of each row (root, text) of ``roots``."""
    out = [f"down0 AS (SELECT root::VARCHAR AS node, text FROM {roots} WHERE length(text) > {size})"]
    for k, sep in enumerate(SEPARATORS):
        out.append(f"at{k} AS (SELECT node, string_split(text, {sep}) AS parts FROM down{k} WHERE contains(text, {sep}))")
        # One step takes one part: what is held grows, or is given out and the part is held; a part above the size is given out for the levels below.
        joined = f"CASE WHEN held = '' THEN parts[i + 1] ELSE held || {sep} || parts[i + 1] END"
        out.append(
            f"""pack{k} AS (
  SELECT node, 0 AS i, '' AS held, NULL::VARCHAR AS piece, NULL::VARCHAR AS big FROM at{k}
  UNION ALL SELECT node, i + 1, CASE WHEN length(j) <= {size} THEN j WHEN length(part) <= {size} THEN part ELSE '' END, CASE WHEN length(j) > {size} THEN held END, CASE WHEN length(j) > {size} AND length(part) > {size} THEN part END
  FROM (SELECT p.node, p.i, p.held, a.parts[p.i + 1] AS part, {joined} AS j FROM (SELECT node, i, held FROM pack{k}) p JOIN at{k} a USING (node) WHERE p.i < len(a.parts)))"""
        )
        last = f"SELECT p.node, p.i, held FROM pack{k} p JOIN at{k} a USING (node) WHERE p.i = len(a.parts)"
        out.append(f"own{k} AS (SELECT node, i, 0 AS sub, {strip('piece')} AS piece FROM pack{k} WHERE piece IS NOT NULL UNION ALL SELECT node, i + 1, 0, {strip('held')} FROM ({last}))")
        out.append(f"down{k + 1} AS (SELECT node, text FROM down{k} WHERE NOT contains(text, {sep}) UNION ALL SELECT node || '/' || i, big FROM pack{k} WHERE big IS NOT NULL)")
    n = len(SEPARATORS)
    step = size - overlap
    windows = f"SELECT node, w AS ord, {strip(f'substring(text, w * {step} + 1, {size})')} AS piece FROM (SELECT node, text, unnest(range(0, (length(text) - 1) // {step} + 1)) AS w FROM down{n})"
    out.append(f"up{n} AS (SELECT * FROM ({windows}) WHERE piece != '')")
    for k in reversed(range(n)):
        below = f"SELECT p.node, p.i, 1 + u.ord AS sub, u.piece FROM pack{k} p JOIN up{k + 1} u ON u.node = p.node || '/' || p.i WHERE p.big IS NOT NULL"
        out.append(f"line{k} AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY i, sub) - 1 AS ord, piece FROM (SELECT * FROM own{k} WHERE piece != '' UNION ALL {below}))")
        begun = f"SELECT node, ord, CASE WHEN ord > 0 THEN right(lag(piece) OVER (PARTITION BY node ORDER BY ord), {overlap}) || ' ' || piece ELSE piece END AS piece FROM line{k}"
        out.append(f"up{k} AS ({begun} UNION ALL SELECT u.node, u.ord, u.piece FROM up{k + 1} u JOIN down{k} d USING (node) WHERE NOT contains(d.text, {SEPARATORS[k]}))")
    out.append(f"pieces AS (SELECT r.root, u.ord, u.piece FROM {roots} r JOIN up0 u ON u.node = r.root::VARCHAR UNION ALL SELECT root, 0, text FROM {roots} WHERE length(text) <= {size} AND {strip('text')} != '')")
    return ",\n".join(out)


def placed(labelled: str) -> str:
    """CTEs that end in the chunks of ``labelled`` (doc_id, chunk_index, label, given, piece), with offsets found one after the other."""
    return f"""
walk AS (
  SELECT doc_id, -1 AS k, 0 AS reached, 0 AS start_char FROM (SELECT DISTINCT doc_id FROM {labelled})
  UNION ALL SELECT doc_id, k + 1, CASE WHEN found > 0 THEN reached + found - 1 ELSE reached + length(piece) END, CASE WHEN found > 0 THEN reached + found - 1 ELSE reached END
  FROM (SELECT w.doc_id, w.k, w.reached, l.piece, instr(substring(d.text, w.reached + 1), left(l.piece, 50)) AS found FROM (SELECT doc_id, k, reached FROM walk) w JOIN {labelled} l ON l.doc_id = w.doc_id AND l.chunk_index = w.k + 1 JOIN documents d ON d.doc_id = w.doc_id))
SELECT doc_id, chunk_index::INT AS chunk_index, label AS section, given AS parent_section, piece AS text, start_char::INT AS start_char, (start_char + length(piece))::INT AS end_char,
  len(regexp_extract_all(piece, '[\\p{{L}}\\p{{N}}_]+|[^{SPACE}\\p{{L}}\\p{{N}}_]'))::INT AS token_count, sha256(concat_ws(chr(1), doc_id::VARCHAR, label, chunk_index::VARCHAR, piece)) AS chunk_id
FROM {labelled} l JOIN (SELECT doc_id, k AS chunk_index, start_char FROM walk WHERE k >= 0) USING (doc_id, chunk_index)"""


_TEXTS = f"texts AS (SELECT doc_id, text, coalesce(section, '') AS given FROM documents WHERE text IS NOT NULL AND {strip('text')} != '')"
_HEADING = rf"^[A-Z][A-Za-z{SPACE},&]{{5,80}}\n"
#: The text is cut at each newline before what looks like a heading; a short first line that begins with a capital labels its part.
_PARTS = rf"""
newlines AS (SELECT doc_id, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM texts))),
spotted AS (SELECT doc_id, list(p::BIGINT ORDER BY p) AS spots FROM newlines JOIN texts USING (doc_id) WHERE p <= length(text) AND regexp_matches(substring(text, p::BIGINT + 1, 100), '{_HEADING}') GROUP BY doc_id),
breaks AS (SELECT doc_id, text, given, coalesce(spots, []) AS spots FROM texts LEFT JOIN spotted USING (doc_id)),
cut AS (SELECT doc_id, given, n, {strip("substring(text, a, z - a)")} AS part FROM (SELECT doc_id, given, text, n, CASE WHEN n = 0 THEN 1 ELSE spots[n] + 1 END AS a, CASE WHEN n < len(spots) THEN spots[n + 1] ELSE length(text) + 1 END AS z FROM (SELECT *, unnest(range(0, len(spots) + 1)) AS n FROM breaks))),
headed AS (SELECT doc_id, given, n, part, {strip("split_part(part, chr(10), 1)")} AS first, instr(part, chr(10)) AS brk FROM cut WHERE part != ''),
titled AS (SELECT *, length(first) < 100 AND regexp_matches(first, '^\p{{Lu}}') AS t FROM headed),
bodies AS (SELECT doc_id, n, given, doc_id::VARCHAR || '-' || n AS root, CASE WHEN NOT t THEN given WHEN given != '' THEN given || ' > ' || first ELSE first END AS label,
  CASE WHEN NOT t THEN part WHEN brk > 0 THEN {strip("substring(part, brk + 1)")} ELSE first END AS text FROM titled)"""

RECURSIVE = f"""WITH RECURSIVE {_TEXTS}, roots AS (SELECT doc_id AS root, text FROM texts), {split("roots")},
labelled AS (SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY p.ord) - 1 AS chunk_index, t.given AS label, t.given, p.piece FROM pieces p JOIN texts t ON t.doc_id = p.root), {placed("labelled")}"""
SECTION_AWARE = f"""WITH RECURSIVE {_TEXTS}, {_PARTS}, {split("bodies")},
labelled AS (SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.n, p.ord) - 1 AS chunk_index, b.label, b.given, p.piece FROM pieces p JOIN bodies b ON b.root = p.root), {placed("labelled")}"""


def _semantic(threshold: float = 0.75, least: int = 200, most: int = 1000) -> str:
    """Runs of sentences, one at a time with the mean of their hashed vectors; a lone sentence is taken as it stands."""
    tokens = "regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+')"
    counts = f"list_transform({tokens}, lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64)"
    cosine = "list_dot_product(mean, v) / (sqrt(list_dot_product(mean, mean)) * sqrt(list_dot_product(v, v)))"
    near = f"CASE WHEN list_dot_product(mean, mean) = 0 OR list_dot_product(v, v) = 0 THEN 0 ELSE {cosine} END"
    return rf"""WITH RECURSIVE {_TEXTS},
cutup AS (SELECT doc_id, given, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip("s")}), lambda s: s != '') AS ss FROM texts),
hashed AS (SELECT doc_id, i, s, list_transform(range(0, 64), lambda b: len(list_filter(h, lambda x: x = b))::DOUBLE) AS raw FROM (SELECT doc_id, i, s, {counts} AS h FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM cutup))),
sentence AS (SELECT doc_id, i, s, CASE WHEN list_dot_product(raw, raw) = 0 THEN raw ELSE list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) END AS v FROM hashed),
runs AS (
  SELECT doc_id, 0 AS i, 0 AS run, 0 AS n, 0 AS size, NULL::DOUBLE[] AS mean FROM cutup WHERE len(ss) > 0
  UNION ALL SELECT doc_id, i + 1, CASE WHEN fresh THEN run + 1 ELSE run END, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN length(s) ELSE size + 1 + length(s) END,
    CASE WHEN fresh THEN v ELSE list_transform(list_zip(mean, v), lambda z: z[1] + (z[2] - z[1]) / (n + 1)) END
  FROM (SELECT r.*, t.s, t.v, r.i = 0 OR size >= {most} OR (({near}) < {threshold} AND size >= {least}) AS fresh FROM (SELECT * FROM runs) r JOIN sentence t ON t.doc_id = r.doc_id AND t.i = r.i + 1)),
labelled AS (SELECT r.doc_id, run - 1 AS chunk_index, c.given AS label, c.given, string_agg(s, ' ' ORDER BY r.i) AS piece FROM runs r JOIN sentence t ON t.doc_id = r.doc_id AND t.i = r.i JOIN cutup c ON c.doc_id = r.doc_id WHERE r.i > 0 GROUP BY ALL), {placed("labelled")}"""


CHUNKS = {"recursive_chunks": RECURSIVE, "section_chunks": SECTION_AWARE, "semantic_chunks": _semantic()}
