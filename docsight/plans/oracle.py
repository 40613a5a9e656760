"""The core's queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from .chunk_sql import CHUNKS, SECTION_AWARE

#: Fixed values, written out here as well so that the SQL does not depend on what it checks: entities, sections, patterns of entities and relations.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8212;", " -- "))
SECTIONS = {
    "Business": (r"(?i)item\s+1[\.\s]*[-—]?\s*business", r"(?i)part\s+i\s*[\n\r]+\s*item\s+1\b"),
    "Risk Factors": (r"(?i)item\s+1a[\.\s]*[-—]?\s*risk\s+factors",),
    "Properties": (r"(?i)item\s+2[\.\s]*[-—]?\s*properties",),
    "Legal Proceedings": (r"(?i)item\s+3[\.\s]*[-—]?\s*legal\s+proceedings",),
    "MD&A": (r"(?i)item\s+7[\.\s]*[-—]?\s*management'?s?\s+discussion",),
    "Financial Statements": (r"(?i)item\s+8[\.\s]*[-—]?\s*financial\s+statements",),
    "Controls and Procedures": (r"(?i)item\s+9a[\.\s]*[-—]?\s*controls?\s+and\s+procedures",),
}
MONEY = r"(?i)\$\s*[\d,]+\.?\d*\s*(?:billion|million|thousand|trillion)?"
PERCENT = r"(?i)\d+\.?\d*\s*(?:%|percent)"
DATE = r"(?i)(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|(?:fiscal\s+)?(?:year|quarter)\s+(?:ended?\s+)?\d{4}|(?:FY|Q[1-4])\s*\d{4})"
METRIC = r"(?i)\b(?:revenue|net income|gross profit|operating income|ebitda|total assets|total liabilities|shareholders equity|cash flow|operating cash flow|free cash flow|earnings per share|eps|gross margin|operating margin|net margin|return on equity|return on assets|debt to equity|current ratio|cost of revenue|research and development|selling general and administrative|depreciation|amortization|capital expenditures|dividends)\b"
COMPANY = r"([A-Z][\p{L}\p{N}_\s&.-]+\s+(?:Inc\.|Corp\.|Corporation|Company|Ltd\.|LLC|L\.P\.|Group|Holdings))"
SUBSIDIARY = r"(?i)(?:subsidiary|subsidiaries|wholly[- ]owned)\s+(?:of\s+)?([A-Z][\p{L}\p{N}_\s,]+?)(?:\.|,|\band\b)"
COMPETES = r"(?i)(?:compet(?:e|es|ing|itor|itors|ition)\s+(?:with|from|include|including))\s+([A-Z][\p{L}\p{N}_\s,]+?)(?:\.|,|\band\b)"
OPERATES = r"(?i)(?:operat(?:e|es|ing)\s+in)\s+([A-Z][\p{L}\p{N}_\s,]+?)(?:\.|,|\band\b)"
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NUMBER = r"(?i)\$?\s*\d[\d,]*\.?\d*\s*(?:billion|million|thousand|trillion|%|percent)?"
_CLAIM = (
    r"(?i)(?:revenue|income|profit|loss|earnings|ebitda|margin|growth|debt|assets|liabilities|equity|cash\s+flow|expense|cost|sales|dividend|eps|share\s+price)"
    r"\s*(?:of|was|were|is|totaled|totalled|reached|increased|decreased|grew|declined)[^.]*?(\$?\s*\d[\d,]*\.?\d*\s*(?:billion|million|thousand|trillion|%|percent)?)"
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, plain in ENTITIES:
        x = f"replace({x}, {_q(entity)}, {_q(plain)})"
    x = f"replace(replace({x}, chr(160), ' '), chr(9), ' ')"
    for pattern, new in ((" {2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"\n[-=_]{3,}\n", "chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return _strip(x)


def _tokens(x: str, least: str = "+") -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{least}')"


def _sentences(x: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {_strip('s')}), lambda s: s != '')"


def _numbers(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{_NUMBER}'), lambda s: {_strip('s')}), lambda s: s != '')"


def _value(x: str) -> str:
    t = _strip(f"regexp_replace(lower({x}), '[$,]', '', 'g')")
    word = f"CASE WHEN contains({t}, 'trillion') THEN 'trillion' WHEN contains({t}, 'billion') THEN 'billion' WHEN contains({t}, 'million') THEN 'million' WHEN contains({t}, 'thousand') THEN 'thousand' ELSE '%' END"
    factor = f"CASE WHEN contains({t}, 'trillion') THEN 1e12 WHEN contains({t}, 'billion') THEN 1e9 WHEN contains({t}, 'million') THEN 1e6 WHEN contains({t}, 'thousand') THEN 1e3 ELSE 1.0 END"
    number = f"TRY_CAST(nullif({_strip(f'''regexp_replace(replace({t}, {word}, ''), '%|percent', '', 'g')''')}, '') AS DOUBLE)"
    return f"(CASE WHEN contains({t}, '%') OR contains({t}, 'percent') THEN {number} ELSE {number} * {factor} END)"


_ORDER = ["text", "company_name", "cik", "filing_date", "filing_type", "section", "parent_section", "source_file", "accession_number", "chunk_index", "start_char", "end_char", "token_count"]
_CORPUS = "corpus AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, " + ", ".join(f"{c} DESC NULLS LAST" for c in _ORDER) + ") = 1)"
_INDEX = f"""
words AS (SELECT chunk_id, unnest({_tokens("coalesce(text, '')")}) AS term FROM corpus),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT chunk_id, sum(tf) AS dl FROM postings GROUP BY ALL),
size AS (SELECT count(*)::DOUBLE AS n FROM corpus),
mean AS (SELECT (SELECT sum(tf) FROM postings)::DOUBLE / n AS avgdl FROM size),
counted AS (SELECT term, count(*) AS df, ln((SELECT n FROM size) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
dictionary AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM counted) ELSE raw END AS idf FROM counted)"""


def _scored(asked: str, keys: str = "query_id") -> str:
    on = " AND ".join(f"f.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return f"""
asked AS (SELECT {keys}, term, count(*) AS times FROM (SELECT {keys}, unnest({_tokens("query")}) AS term FROM {asked}) GROUP BY ALL),
hits AS (SELECT {keys}, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM mean)))), 9) AS score
  FROM asked JOIN dictionary USING (term) JOIN postings USING (term) JOIN lengths USING (chunk_id) GROUP BY ALL),
peak AS (SELECT {keys}, max(score) AS best FROM hits GROUP BY ALL),
shares AS (SELECT {own}, f.chunk_id, f.score, round(f.score / CASE WHEN b.best > 0 THEN b.best ELSE 1 END, 9) AS share FROM hits f JOIN peak b ON {on})"""


_VARIANTS = """variants AS (
  SELECT query_id, 0 AS variant_no, query FROM queries UNION ALL SELECT query_id, 1, 'What does the 10-K filing say about: ' || query FROM queries
  UNION ALL SELECT query_id, 2, 'financial data related to ' || query FROM queries UNION ALL SELECT query_id, 3, 'SEC filing information: ' || query FROM queries)"""
_FIRST = "first AS (SELECT query_id, chunk_id, arg_min(score, variant_no * 1000 + rank) AS score FROM ranked GROUP BY ALL)"
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id}) AS INT) AS rank"


def _hashed(name: str, source: str, key: str, text: str) -> str:
    """A table of hashed bags of words: lists of 64 counts, and their length."""
    return f"""
{name}_b AS (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 7) AS BIGINT) % 64 AS b, count(*) AS c FROM (SELECT {key}, unnest({_tokens(f"coalesce({text}, '')")}) AS tok FROM {source}) GROUP BY ALL),
{name} AS (SELECT {key}, sqrt(sum(c * c)::DOUBLE) AS norm FROM {name}_b GROUP BY {key})"""


def _cosines(left: str, lkey: str, right: str, rkey: str, pairs: str | None = None) -> str:
    """Cosine of hashed bags; pairs without a common bucket have 0."""
    dots = f"SELECT l.{lkey}, r.{rkey}, sum(l.c * r.c)::DOUBLE AS dot FROM {left}_b l JOIN {right}_b r USING (b) GROUP BY ALL"
    return f"SELECT {lkey}, {rkey}, round(dot / (l.norm * r.norm), 9) AS score FROM ({dots}) JOIN {left} l USING ({lkey}) JOIN {right} r USING ({rkey})" + (f" JOIN {pairs} USING ({lkey}, {rkey})" if pairs else "")


def _dense(k: int, where: str = "", after: str = "") -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score FROM q, embeddings {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k} {after}"""


def _hybrid(k: int, deep: int, dw: float, sw: float, threshold: str) -> str:
    return f"""
WITH {_CORPUS}, {_INDEX}, {_scored("queries")},
{_hashed("hc", "corpus", "chunk_id", "text")}, {_hashed("hq", "queries", "query_id", "query")},
dn AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({_cosines("hq", "query_id", "hc", "chunk_id")})),
sp AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, chunk_id) AS rank FROM shares),
parts AS (SELECT query_id, chunk_id, {dw} / (60 + rank) AS part FROM dn WHERE rank <= {deep} {threshold} UNION ALL SELECT query_id, chunk_id, {sw} / (60 + rank) FROM sp WHERE rank <= {deep}),
fused AS (SELECT query_id, chunk_id, round(sum(part), 12) AS score FROM parts GROUP BY ALL),
placed AS (SELECT query_id, chunk_id, round(score, 9) AS score, {_RANK.format(id="chunk_id")} FROM fused)
SELECT * FROM placed WHERE rank <= {k}"""


def _sections(text: str = "text", show: str = "CAST(no AS INT) AS section_no, section, length(body) AS n_chars, md5(body) AS digest") -> str:
    rows = []
    for k, (name, patterns) in enumerate(SECTIONS.items()):
        bare = [p.removeprefix("(?i)") for p in patterns]
        at = "NULL"
        for p in reversed(bare):
            at = f"CASE WHEN regexp_matches(text, {_q('(?i)' + p)}) THEN length(regexp_extract(text, {_q('(?is)^(.*?)' + p)}, 1)) + 1 ELSE {at} END"
        rows.append(f"SELECT doc_id, text, {k} AS k, {_q(name)} AS section, {at} AS pos FROM filing")
    return f"""
WITH filing AS (SELECT doc_id, {text} AS text FROM documents WHERE text IS NOT NULL),
found AS (SELECT * FROM ({" UNION ALL ".join(rows)}) WHERE pos IS NOT NULL),
cut AS (SELECT doc_id, k, pos, section, {_strip("substring(text, pos, coalesce(lead(pos) OVER w, length(text) + 1) - pos)")} AS body FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY pos, k)),
parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS no FROM cut WHERE body != ''),
whole AS (SELECT doc_id, 0 AS no, 'Full Document' AS section, text AS body FROM filing f WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.doc_id = f.doc_id))
SELECT doc_id, {show} FROM (SELECT doc_id, no, section, body FROM parts UNION ALL SELECT * FROM whole) JOIN (SELECT doc_id, source_file FROM documents) USING (doc_id)"""


def _mentions() -> str:
    metric = f"list_distinct(list_transform(regexp_extract_all(text, {_q(METRIC)}), lambda m: lower({_strip('m')})))"
    kinds = [("monetary_amount", f"regexp_extract_all(text, {_q(MONEY)})"), ("percentage", f"regexp_extract_all(text, {_q(PERCENT)})"), ("date", f"regexp_extract_all(text, {_q(DATE)})"), ("financial_metric", metric), ("company", f"regexp_extract_all(text, {_q(COMPANY)}, 1)")]
    rows = [f"SELECT doc_id, source_file, {_q(k)} AS entity_type, {_strip('m')} AS name, {n} AS kind_no FROM (SELECT doc_id, source_file, unnest({x}) AS m FROM documents WHERE text IS NOT NULL)" for n, (k, x) in enumerate(kinds)]
    return f"mentions AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE entity_type != 'company' OR length(name) > 3)"


def _edges() -> str:
    def names(pattern: str, kind: str, src: str, dst: str, n: int) -> str:
        whole = f"list_zip(regexp_extract_all(text, {_q(pattern)}), regexp_extract_all(text, {_q(pattern)}, 1), range(1, 100000))"
        return f"SELECT doc_id, {src} AS src, {dst} AS dst, {_q(kind)} AS relation_type, substring(m[1], 1, 200) AS source_text, {n} AS kind_no, m[3] AS i FROM (SELECT doc_id, company_name, m, regexp_replace({_strip('m[2]')}, '[,. ]+$', '') AS nm FROM (SELECT doc_id, company_name, unnest(list_filter({whole}, lambda z: z[1] IS NOT NULL)) AS m FROM firms)) WHERE length(nm) > 2"

    company = "'company::' || company_name"
    return f"""
firms AS (SELECT * FROM documents WHERE company_name != ''),
links AS ({names(SUBSIDIARY, "subsidiary_of", "'company::' || nm", company, 0)}
  UNION ALL {names(COMPETES, "competes_with", company, "'company::' || nm", 1)}
  UNION ALL {names(OPERATES, "operates_in", company, "'location::' || nm", 2)}
  UNION ALL SELECT doc_id, {company}, 'financial_metric::' || lower({_strip('m')}), 'reports', '', 3, min(i) FROM (SELECT doc_id, company_name, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (SELECT doc_id, company_name, regexp_extract_all(text, {_q(METRIC)}) AS found FROM firms WHERE text IS NOT NULL)) GROUP BY ALL
  UNION ALL SELECT doc_id, {company}, 'filing_section::' || section, 'mentioned_in', '', 4, 0 FROM firms WHERE coalesce(section, '') != '' AND text IS NOT NULL)"""


_GRAPH = f"""{_mentions()}, {_edges()},
named AS (SELECT entity_type || '::' || name AS node_id, name, entity_type FROM mentions GROUP BY ALL),
edges AS (SELECT src, dst, arg_max(relation_type, doc_id * 10000000.0 + kind_no * 100000 + i) AS relation_type, arg_max(source_text, doc_id * 10000000.0 + kind_no * 100000 + i) AS source_text, min(doc_id * 10000000 + kind_no * 100000 + i) AS seq FROM links GROUP BY ALL),
nodes AS (SELECT node_id, name, entity_type FROM named UNION ALL SELECT node_id, NULL, NULL FROM (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges) WHERE node_id NOT IN (SELECT node_id FROM named)),
seeds AS (SELECT DISTINCT 'company::' || company_name AS node_id FROM filings WHERE filing_id % 50 = 0 AND company_name != '')"""


def _walk(where: str = "") -> str:
    """What a breadth-first walk of two steps finds, in its order: outgoing edges first, then by first write."""
    key = "(parent::HUGEINT * 2 + way) * 1000000000000000 + seq"
    return f"""
step AS (SELECT src AS origin, dst AS nxt, relation_type, 0 AS way, seq FROM edges {where} UNION ALL SELECT dst, src, relation_type, 1, seq FROM edges {where}),
s AS (SELECT node_id AS seed FROM seeds WHERE node_id IN (SELECT node_id FROM nodes)),
hop1 AS (SELECT seed, nxt AS node_id, min({key}) AS k, arg_min(relation_type, {key}) AS relation FROM (SELECT *, 0 AS parent FROM s JOIN step ON origin = seed WHERE nxt != seed) GROUP BY ALL),
one AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k, node_id) AS position FROM hop1),
hop2 AS (SELECT seed, nxt AS node_id, min({key}) AS k, arg_min(relation_type, {key}) AS relation FROM (SELECT o.seed, o.position AS parent, t.* FROM one o JOIN step t ON origin = o.node_id WHERE nxt != o.seed) GROUP BY ALL),
new AS (SELECT * FROM hop2 h WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.seed = h.seed AND o.node_id = h.node_id)),
base AS (SELECT seed, count(*) AS n FROM one GROUP BY seed),
two AS (SELECT seed, node_id, k, relation, n + row_number() OVER (PARTITION BY seed ORDER BY k, node_id) AS position FROM new JOIN base USING (seed)),
walked AS (SELECT seed, node_id, relation, 1::INT AS distance, position FROM one UNION ALL SELECT seed, node_id, relation, 2::INT, position FROM two)"""


_JUDGED = """
best AS (SELECT query_id, leg, chunk_id, max(score) AS score FROM results WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan') GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, chunk_id) AS rank FROM best WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL)"""
_IR = f"""WITH {_JUDGED},
run AS (SELECT * FROM ranked WHERE leg = 'sparse'), truth AS (SELECT query_id, chunk_id FROM ranked WHERE leg = 'rerank' AND rank <= 5),
n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY ALL),
h AS (SELECT query_id, sum((rank <= 5)::INT) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS gain FROM run JOIN truth USING (query_id, chunk_id) GROUP BY ALL),
m AS (SELECT query_id, coalesce(hits / 5.0, 0) AS p, coalesce(hits / n.n::DOUBLE, 0) AS r, coalesce(1.0 / first, 0) AS rr,
  coalesce(gain / list_sum(list_transform(range(1, least(n.n, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS g
  FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN n USING (query_id) LEFT JOIN h USING (query_id))"""
_KNOWN = f"""sourced AS (SELECT *, coalesce(array_to_string(sources, ' '), '') AS src FROM answers),
known AS (SELECT *, lower(src) AS low, list_filter(list_transform({_numbers("src")}, lambda n: {_value("n")}), lambda x: x IS NOT NULL) AS vals FROM sourced)"""
_ANSWERS = f"""{_CORPUS}, {_JUDGED},
texts AS (SELECT chunk_id, coalesce(text, '') AS text FROM corpus),
answers AS (SELECT q.query_id AS answer_id, q.query, b.text || ' ' || q.query AS answer, coalesce(s.sources, []) AS sources FROM queries q
  JOIN (SELECT query_id, text FROM ranked JOIN texts USING (chunk_id) WHERE leg = 'rerank' AND rank = 1) b USING (query_id)
  LEFT JOIN (SELECT query_id, list(text ORDER BY rank) AS sources FROM ranked JOIN texts USING (chunk_id) WHERE leg = 'dense' AND rank <= 5 GROUP BY ALL) s USING (query_id)),
{_KNOWN}"""
_PARTS = f"sents AS (SELECT answer_id, low, s, {_tokens('s', '{4,}')} AS w FROM (SELECT answer_id, low, unnest({_sentences('answer')}) AS s FROM known))"
_FACTUAL = f"""factual AS (SELECT answer_id, CASE WHEN o < 0.1 THEN 'high' ELSE 'medium' END AS severity, 'Sentence may not be grounded in sources (overlap=' || CAST(round_even(o * 100, 0) AS INT)::VARCHAR || '%).' AS message, substring(s, 1, 200) AS span
  FROM (SELECT answer_id, s, len(list_filter(w, lambda x: contains(low, x)))::DOUBLE / len(w) AS o FROM sents WHERE len(w) > 0 AND length(s) >= 20 AND NOT regexp_matches(s, '^(?i)(?:based on|according to|the sources|as mentioned)')) WHERE o < 0.3)"""
_CLAIMED = f"""claimed AS (SELECT answer_id, CASE WHEN len(vals) > 0 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN len(vals) > 0 THEN 'Financial figure ''' || c || ''' not found in source documents.' ELSE 'Could not verify figure ''' || c || ''' against sources.' END AS message, c AS span
  FROM (SELECT answer_id, src, vals, c, {_value("c")} AS v FROM (SELECT answer_id, src, vals, {_strip("u")} AS c FROM (SELECT answer_id, src, vals, unnest(regexp_extract_all(answer, '{_CLAIM}', 1)) AS u FROM known)))
  WHERE c != '' AND NOT contains(src, c) AND v IS NOT NULL AND len(list_filter(vals, lambda s: abs(v - s) / greatest(abs(s), 1e-10) < 0.01)) = 0)"""
_COUNTED = f"counted_numbers AS (SELECT answer_id, src, vals, c, {_value('c')} AS v FROM (SELECT answer_id, src, vals, unnest({_numbers('answer')}) AS c FROM known))"
_NUMERIC = "numeric_ AS (SELECT answer_id, 'medium' AS severity, 'Number ''' || c || ''' could not be verified in sources.' AS message, c AS span FROM counted_numbers WHERE v IS NOT NULL AND NOT contains(src, c) AND len(list_filter(vals, lambda s: abs(v - s) / greatest(abs(s), 1e-10) < 0.02)) = 0)"
_FORM = r"""form AS (
  SELECT answer_id, 'low' AS severity, 'No source citations found in the response.' AS message FROM answers WHERE len(sources) > 0 AND NOT regexp_matches(answer, '\[Source\s+\d+\]')
  UNION ALL SELECT answer_id, 'low', 'Response is unusually short given available sources.' FROM answers WHERE len(sources) > 0 AND len(list_filter(regexp_split_to_array(answer, '\s+'), lambda w: w != '')) < 20
  UNION ALL SELECT answer_id, 'low', 'Response contains code block markers.' FROM answers WHERE contains(answer, '```'))"""
_FINDINGS = f"{_PARTS}, {_FACTUAL}, {_CLAIMED}, {_COUNTED}, {_NUMERIC}, {_FORM}"
_BLOCK = "'Section: ' || coalesce(section, 'Unknown') || chr(10) || 'Company: ' || coalesce(company_name, 'Unknown') || chr(10) || 'Filing Date: ' || coalesce(filing_date, 'Unknown') || chr(10) || 'Content:' || chr(10) || substring(coalesce(text, ''), 1, 3000) || chr(10) || '---'"



def _mmr(k: int, trade: float) -> str:
    """CTEs over ``cand`` (query_id, chunk_id, rank, near, score) and ``sim`` (query_id, a, b, sim) that end in ``picked`` (query_id, chunk_id, score, rank)."""
    value = lambda worst: f"row_number() OVER (PARTITION BY query_id ORDER BY round({trade} * near - {1 - trade} * {worst}, 12) DESC, rank) = 1"
    out = [
        f"many AS (SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM cand GROUP BY query_id HAVING count(*) > {k}))",
        f"taken0 AS (SELECT query_id, chunk_id, near, 1 AS n FROM many QUALIFY {value(0)})",
    ]
    for n in range(1, k):
        t = f"taken{n - 1}"
        left = f"SELECT m.query_id, m.chunk_id, m.near, m.rank, max(s.sim) AS worst FROM many m JOIN {t} t ON t.query_id = m.query_id JOIN sim s ON s.query_id = m.query_id AND s.a = m.chunk_id AND s.b = t.chunk_id WHERE NOT EXISTS (SELECT 1 FROM {t} x WHERE x.query_id = m.query_id AND x.chunk_id = m.chunk_id) GROUP BY ALL"
        out.append(f"taken{n} AS (SELECT * FROM {t} UNION ALL SELECT query_id, chunk_id, near, {n + 1} FROM ({left}) QUALIFY {value('worst')})")
    out.append(f"picked AS (SELECT query_id, chunk_id, near AS score, n::INT AS rank FROM taken{k - 1} UNION ALL SELECT query_id, chunk_id, score, rank::INT FROM cand WHERE query_id NOT IN (SELECT query_id FROM many))")
    return ",\n".join(out)


_MMR_SELECT = f"""
WITH e AS (SELECT vec_id, vec_id::VARCHAR AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, e.chunk_id, e.v, round(list_cosine_similarity(q.v, e.v), 9) AS score, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v)) + 1e-10) AS near FROM e q, e WHERE q.vec_id % 50 = 0),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 15),
sim AS (SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)) + 1e-10) AS sim FROM cand x JOIN cand y USING (query_id)),
{_mmr(5, 0.3)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM picked"""

#: Each question by the strategy that it names.
_STRATEGIES = f"""
WITH {_CORPUS}, {_INDEX},
qs AS (SELECT query_id, query, CASE WHEN strategy IN ('dense', 'sparse', 'mmr') THEN strategy ELSE 'ensemble' END AS strategy FROM queries),
variants AS (SELECT query_id, strategy, 0 AS variant_no, query FROM qs UNION ALL SELECT query_id, strategy, 1, 'What does the 10-K filing say about: ' || query FROM qs
  UNION ALL SELECT query_id, strategy, 2, 'financial data related to ' || query FROM qs UNION ALL SELECT query_id, strategy, 3, 'SEC filing information: ' || query FROM qs),
kids AS (SELECT query_id * 10 + variant_no AS kid, query_id, variant_no, strategy, query FROM variants WHERE strategy != 'sparse' AND (strategy != 'ensemble' OR variant_no = 0)),
{_hashed("hc", "corpus", "chunk_id", "text")}, {_hashed("hq", "kids", "kid", "query")},
cosines AS ({_cosines("hq", "kid", "hc", "chunk_id")}),
near AS (SELECT k.*, chunk_id, score, row_number() OVER (PARTITION BY kid ORDER BY score DESC, chunk_id) AS rank FROM cosines JOIN kids k USING (kid)),
seen AS (SELECT query_id, strategy, chunk_id, arg_min(score, variant_no * 1000 + rank) AS score FROM near WHERE score >= 0.3 AND ((strategy = 'dense' AND rank <= 5) OR (strategy = 'mmr' AND rank <= 15)) GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM seen),
cand AS (SELECT o.query_id, o.chunk_id, o.rank, o.score, coalesce(c.score, 0) AS near FROM ordered o LEFT JOIN cosines c ON c.kid = o.query_id * 10 AND c.chunk_id = o.chunk_id WHERE strategy = 'mmr' AND rank <= 15),
sim AS (SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, coalesce(dot / (n.norm * m.norm), 0) AS sim FROM cand x JOIN cand y USING (query_id) JOIN hc n ON n.chunk_id = x.chunk_id JOIN hc m ON m.chunk_id = y.chunk_id
  LEFT JOIN (SELECT l.chunk_id AS p, r.chunk_id AS q, sum(l.c * r.c)::DOUBLE AS dot FROM hc_b l JOIN hc_b r USING (b) WHERE l.chunk_id IN (SELECT chunk_id FROM cand) AND r.chunk_id IN (SELECT chunk_id FROM cand) GROUP BY ALL) ON p = x.chunk_id AND q = y.chunk_id),
{_mmr(5, 0.3)},
words_asked AS (SELECT query_id, variant_no, query FROM variants WHERE strategy = 'sparse' OR (strategy = 'ensemble' AND variant_no = 0)),
{_scored("words_asked", "query_id, variant_no")},
sparse AS (SELECT query_id, variant_no, chunk_id, share, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY share DESC, chunk_id) AS rank FROM shares),
first_sparse AS (SELECT query_id, chunk_id, arg_min(share, variant_no * 1000 + rank) AS score FROM sparse JOIN qs USING (query_id) WHERE strategy = 'sparse' AND rank <= 5 GROUP BY ALL),
parts AS (SELECT query_id, chunk_id, 0.6::DOUBLE / (60 + rank) AS part FROM near WHERE strategy = 'ensemble' AND rank <= 15 AND score >= 0.3 UNION ALL SELECT query_id, chunk_id, 0.4::DOUBLE / (60 + rank) FROM sparse JOIN qs USING (query_id) WHERE strategy = 'ensemble' AND rank <= 15),
found AS (SELECT query_id, chunk_id, score, 'dense' AS strategy FROM ordered WHERE strategy = 'dense' UNION ALL SELECT *, 'sparse' FROM first_sparse UNION ALL SELECT query_id, chunk_id, round(sum(part), 12), 'ensemble' FROM parts GROUP BY ALL),
placed AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, strategy FROM found QUALIFY rank <= 5)
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank, strategy FROM placed UNION ALL SELECT query_id, chunk_id, round(score, 6), rank, 'mmr' FROM picked"""

_COMPRESS = f"""
WITH {_CORPUS}, retrieved AS (SELECT DISTINCT query_id, chunk_id FROM results JOIN (SELECT DISTINCT query_id FROM queries) USING (query_id) WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan')),
texts AS (SELECT chunk_id, text, {_sentences("text")} AS ss FROM corpus WHERE chunk_id IN (SELECT chunk_id FROM retrieved)),
sents AS (SELECT chunk_id, i, s, chunk_id || '#' || i AS sid FROM (SELECT chunk_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM texts WHERE len(ss) > 3)),
{_hashed("hs", "sents", "sid", "s")}, {_hashed("hq", "queries", "query_id", "query")},
dots AS (SELECT r.query_id, x.sid, sum(l.c * q.c)::DOUBLE AS dot FROM retrieved r JOIN sents x USING (chunk_id) JOIN hs_b l ON l.sid = x.sid JOIN hq_b q ON q.query_id = r.query_id AND q.b = l.b GROUP BY ALL),
near AS (SELECT r.query_id, x.chunk_id, x.i, x.s, coalesce(round(dot / (hs.norm * hq.norm), 12), 0) AS near FROM retrieved r JOIN sents x USING (chunk_id) LEFT JOIN dots d ON d.query_id = r.query_id AND d.sid = x.sid LEFT JOIN hs ON hs.sid = x.sid LEFT JOIN hq ON hq.query_id = r.query_id),
kept AS (SELECT query_id, chunk_id, string_agg(s, ' ' ORDER BY i) AS text FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY near DESC, i) <= 3) GROUP BY ALL)
SELECT r.query_id, r.chunk_id, coalesce(k.text, t.text) AS text FROM retrieved r JOIN texts t USING (chunk_id) LEFT JOIN kept k ON k.query_id = r.query_id AND k.chunk_id = r.chunk_id"""

_LINES = f"""
lists AS (SELECT query_id, list(coalesce(text, '') ORDER BY rank) AS texts FROM found GROUP BY ALL),
split AS (SELECT query_id, query, i, {_sentences("t")} AS ss FROM (SELECT query_id, query, unnest(texts) AS t, generate_subscripts(texts, 1) AS i FROM lists JOIN queries USING (query_id))),
lines AS (SELECT query_id, i, unnest(ss) AS s, generate_subscripts(ss, 1) AS j, list_distinct({_tokens("query", "{4,}")}) AS w FROM split),
shared AS (SELECT query_id, i, j, s, len(list_intersect(w, list_distinct({_tokens("s", "{4,}")}))) AS o FROM lines),
chosen AS (SELECT query_id, string_agg(s || ' [Source ' || i || ']', ' ' ORDER BY o DESC, i, j) AS answer FROM (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o DESC, i, j) <= 3) GROUP BY ALL),
said AS (SELECT q.query_id, q.query, CASE WHEN l.texts IS NULL THEN 'No relevant passage was found in the indexed filings for this question.' ELSE coalesce(b.answer, '') END AS answer, coalesce(l.texts, []) AS texts
  FROM queries q LEFT JOIN lists l ON l.query_id = q.query_id LEFT JOIN chosen b ON b.query_id = q.query_id)"""
_GENERATED = f"""WITH {_CORPUS}, {_INDEX}, {_scored("queries")},
found AS (SELECT query_id, rank, text FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, chunk_id) AS rank FROM shares QUALIFY rank <= 5) JOIN corpus USING (chunk_id)), {_LINES}
SELECT query_id, answer, 'extractive' AS model, len(texts) > 0 AS has_sources FROM said"""
_CHECKED = f"""answers AS (SELECT query_id AS answer_id, query, answer, texts AS sources FROM said WHERE len(texts) > 0), {_KNOWN}, {_FINDINGS},
notes AS (SELECT answer_id, severity FROM factual UNION ALL SELECT answer_id, severity FROM claimed UNION ALL SELECT answer_id, severity FROM numeric_ UNION ALL SELECT answer_id, severity FROM form),
per AS (SELECT answer_id, sum(CASE severity WHEN 'low' THEN 0.02 WHEN 'medium' THEN 0.08 ELSE 0.15 END::DOUBLE) AS cost, count(*) AS findings FROM notes GROUP BY ALL),
judged AS (SELECT answer_id AS query_id, round(greatest(0, least(1, 1 - coalesce(cost, 0))), 9) AS confidence, coalesce(findings, 0)::BIGINT AS findings FROM answers LEFT JOIN per USING (answer_id))"""
_RAG = f"""{_hybrid(5, 15, 0.6, 0.4, "AND score >= 0.3").rsplit("SELECT * FROM placed", 1)[0]},
found AS (SELECT p.query_id, p.rank, c.text FROM placed p JOIN corpus c USING (chunk_id) WHERE p.rank <= 5), {_LINES}, {_CHECKED}
SELECT s.query_id, query, answer, len(texts) > 0 AS has_sources, confidence, confidence >= 0.7 AS passed, findings FROM said s LEFT JOIN judged j USING (query_id)"""


def _over_documents(sql: str) -> str:
    """SQL over the delivered chunks turned into SQL over those that the engine cuts documents into."""
    assert sql.lstrip().startswith(f"WITH {_CORPUS}")
    cut = SECTION_AWARE.rsplit("SELECT doc_id, chunk_index::INT", 1)
    return f"{cut[0].rstrip()},\ncorpus AS (SELECT doc_id, chunk_index::INT{cut[1]})" + sql.lstrip().removeprefix(f"WITH {_CORPUS}")


_INGESTED = _over_documents(f"""WITH {_CORPUS}, {_hashed("h", "corpus", "chunk_id", "text")}
SELECT chunk_id, doc_id, chunk_index, c.section, parent_section, d.company_name, d.filing_type, token_count, coalesce(used, 0)::INT AS used FROM corpus c JOIN documents d USING (doc_id) LEFT JOIN (SELECT chunk_id, count(*) AS used FROM h_b GROUP BY ALL) USING (chunk_id)""")
#: Vectors are kept as floats, so cosines are compared to six digits.
_WARNED = """, warned AS (SELECT answer_id AS query_id, sum((severity = 'high')::INT) AS high FROM notes GROUP BY ALL)
SELECT s.query_id, answer, len(texts) > 0 AS has_sources, coalesce(round(confidence, 6), 1) AS confidence, coalesce(confidence >= 0.7, true) AS passed,
  CASE WHEN len(texts) = 0 THEN 1 ELSE coalesce(high, 0) + (confidence < 0.7)::INT END::INT AS warnings FROM said s LEFT JOIN judged USING (query_id) LEFT JOIN warned USING (query_id)"""
_ENGINE_QUERY = _over_documents(_RAG.rsplit("\nSELECT s.query_id", 1)[0].strip() + _WARNED).replace("round(dot / (l.norm * r.norm), 9)", "round(dot / (l.norm * r.norm), 6)")
_EVALUATED = f"""{_RAG.rsplit("SELECT s.query_id", 1)[0].rstrip()}, {_JUDGED}, truth AS (SELECT query_id, chunk_id FROM ranked WHERE leg = 'rerank' AND rank <= 5),
counts AS (SELECT query_id, count(*) AS n FROM truth GROUP BY ALL),
hits_in AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM placed JOIN truth USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY ALL),
ir AS (SELECT query_id, coalesce(hits / 5.0, 0) AS precision, coalesce(hits / n::DOUBLE, 0) AS recall, coalesce(1.0 / first, 0) AS reciprocal_rank,
  coalesce(gain / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN counts USING (query_id) LEFT JOIN hits_in USING (query_id)),
long AS (SELECT answer_id, len(w) = 0 OR len(list_filter(w, lambda x: contains(low, x)))::DOUBLE / greatest(len(w), 1) >= 0.3 AS good FROM sents WHERE length(s) > 15),
faithful AS (SELECT answer_id, coalesce(avg(good::INT), 1) AS faithfulness FROM answers LEFT JOIN long USING (answer_id) GROUP BY ALL),
wanted AS (SELECT answer_id, sources, list_distinct({_tokens('query', '{4,}')}) AS q FROM answers),
relevant AS (SELECT answer_id, CASE WHEN len(q) > 0 AND len(sources) > 0 THEN len(list_filter(sources, lambda t: len(list_intersect(q, {_tokens('t', '{4,}')}))::DOUBLE / len(q) >= 0.2))::DOUBLE / len(sources) ELSE 0 END AS context_relevancy FROM wanted),
verified AS (SELECT answer_id, contains(src, c) OR (v IS NOT NULL AND len(list_filter(vals, lambda s: abs(v - s) / greatest(abs(s), 1e-10) < 0.02)) > 0) AS good FROM counted_numbers),
numbered AS (SELECT answer_id, coalesce(avg(good::INT), 1) AS numerical_accuracy FROM answers LEFT JOIN verified USING (answer_id) GROUP BY ALL),
heads AS (SELECT answer_id, query, substring(answer, 1, 500) AS head FROM answers), {_hashed('hx', 'heads', 'answer_id', 'query')}, {_hashed('hy', 'heads', 'answer_id', 'head')},
dotted AS (SELECT answer_id, sum(x.c * y.c)::DOUBLE AS dot FROM hx_b x JOIN hy_b y USING (answer_id, b) GROUP BY ALL),
near_query AS (SELECT answer_id, coalesce(dot / (hx.norm * hy.norm), 0) AS answer_relevancy FROM answers LEFT JOIN dotted USING (answer_id) LEFT JOIN hx USING (answer_id) LEFT JOIN hy USING (answer_id))
SELECT ir.query_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "reciprocal_rank", "ndcg", "faithfulness", "context_relevancy", "numerical_accuracy", "answer_relevancy"))}
FROM ir LEFT JOIN faithful f ON f.answer_id = ir.query_id LEFT JOIN relevant r ON r.answer_id = ir.query_id LEFT JOIN numbered n ON n.answer_id = ir.query_id LEFT JOIN near_query a ON a.answer_id = ir.query_id""".replace("round(dot / (l.norm * r.norm), 9)", "round(dot / (l.norm * r.norm), 6)")

ORACLE: dict[str, str] = {
    "engine_ingest": _INGESTED,
    "engine_query": _ENGINE_QUERY,
    "engine_evaluate": _EVALUATED,
    **CHUNKS,
    "mmr_select": _MMR_SELECT,
    "strategy_results": _STRATEGIES,
    "sentence_compress": _COMPRESS,
    "generated_answers": _GENERATED,
    "rag_answers": _RAG,
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "filing_header": rf"""
WITH made AS (SELECT DISTINCT filing_id, concat_ws(chr(10), 'COMPANY CONFORMED NAME: ' || company_name, 'CENTRAL INDEX KEY: ' || cik, 'FILED AS OF DATE: ' || regexp_replace(filing_date, '[^0-9]', '', 'g'), 'ACCESSION NUMBER: ' || accession_number) AS text FROM filings),
f AS (SELECT filing_id, {_strip("regexp_extract(text, '(?i)COMPANY CONFORMED NAME:[[:space:]]*([^\n]+)', 1)")} AS company_name, regexp_extract(text, '(?i)CENTRAL INDEX KEY:\s*(\d+)', 1) AS cik, regexp_extract(text, '(?i)FILED AS OF DATE:\s*(\d{{8}})', 1) AS r, regexp_extract(text, '(?i)ACCESSION NUMBER:\s*([\d-]+)', 1) AS accession_number FROM made)
SELECT filing_id, company_name, cik, CASE WHEN r != '' THEN substr(r, 1, 4) || '-' || substr(r, 5, 2) || '-' || substr(r, 7, 2) ELSE '' END AS filing_date, accession_number FROM f""",
    "filing_sections": _sections(),
    "load_filings": _sections(_clean("text"), "source_file, section, CAST(no AS INT) AS section_no, '10-K' AS filing_type, length(body) AS n_chars"),
    "token_stats": rf"SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct, coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')), 0)::INT AS n_counted FROM (SELECT doc_id, text, {_tokens("coalesce(text, '')")} AS w FROM documents)",
    "sentence_stats": f"SELECT doc_id, len(s)::INT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::INT AS n_chars FROM (SELECT doc_id, {_sentences("coalesce(text, '')")} AS s FROM documents)",
    "numbers_extract": f"SELECT doc_id, CAST(p - 1 AS INT) AS pos, number, {_value('number')} AS value FROM (SELECT doc_id, unnest(n) AS number, generate_subscripts(n, 1) AS p FROM (SELECT doc_id, {_numbers('text')} AS n FROM documents WHERE text IS NOT NULL))",
    "term_dictionary": f"WITH {_CORPUS}, {_INDEX} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM dictionary",
    "hard_windows": r"""
WITH w AS (SELECT doc_id, CAST(i AS INT) AS window_no, CAST(i * 800 AS INT) AS start_char, regexp_replace(substring(text, i * 800 + 1, 1000), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 800 + 1)) AS i FROM documents WHERE length(text) > 0))
SELECT doc_id, window_no, start_char, md5(piece) AS digest FROM w WHERE piece != ''""",
    "latest_chunks": f"WITH {_CORPUS} SELECT chunk_id, section, parent_section, chunk_index, md5(coalesce(text, '')) AS digest FROM corpus",
    "index_stats": f"WITH {_CORPUS} SELECT filing_type, count(*) AS chunks, count(DISTINCT cik) AS ciks, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM corpus GROUP BY ALL",
    "embed_cache_misses": f"WITH {_CORPUS} SELECT md5(x) AS digest, length(x)::INT AS n_chars FROM (SELECT DISTINCT coalesce(text, '') AS x FROM corpus) WHERE x NOT IN (SELECT coalesce(text, '') FROM corpus WHERE filing_type = '10-K')",
    "hash_embed": f"WITH {_hashed('h', 'documents', 'doc_id', 'text')} SELECT d.doc_id, coalesce(u, 0)::INT AS used, round(coalesce(m, 0), 6) AS most, round(coalesce(k, 0), 6) AS checksum FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS u, max(c / norm) AS m, sum(c / norm * (b + 1)) AS k FROM h_b JOIN h USING (doc_id) GROUP BY ALL) USING (doc_id)",
    "query_variants": f"WITH {_VARIANTS} SELECT query_id, variant_no, query FROM variants",
    "bm25_topk": f"WITH {_CORPUS}, {_INDEX}, {_scored('queries')}, placed AS (SELECT *, {_RANK.format(id='chunk_id')} FROM shares) SELECT query_id, chunk_id, round(score, 6) AS score, round(share, 6) AS share, rank FROM placed WHERE rank <= 10",
    "bm25_filtered": f"WITH {_CORPUS}, {_INDEX}, {_scored('queries')}, kept AS (SELECT query_id, chunk_id, share AS score FROM shares WHERE chunk_id IN (SELECT chunk_id FROM corpus WHERE filing_type = '10-K' AND (section = 'Risk Factors' OR parent_section = 'Risk Factors'))), placed AS (SELECT *, {_RANK.format(id='chunk_id')} FROM kept) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5",
    "bm25_multi_query": f"WITH {_CORPUS}, {_INDEX}, {_VARIANTS}, {_scored('variants', 'query_id, variant_no')}, ranked AS (SELECT query_id, variant_no, chunk_id, share AS score, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY share DESC, chunk_id) AS rank FROM shares QUALIFY rank <= 5), {_FIRST}, placed AS (SELECT query_id, chunk_id, score, {_RANK.format(id='chunk_id')} FROM first) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5",
    "dense_topk": _dense(10),
    "dense_threshold": _dense(5, after="AND score >= 0.3"),
    "dense_filtered": _dense(5, "WHERE label = 1"),
    "dense_questions": f"WITH {_CORPUS}, {_hashed('hc', 'corpus', 'chunk_id', 'text')}, {_hashed('hq', 'queries', 'query_id', 'query')}, s AS ({_cosines('hq', 'query_id', 'hc', 'chunk_id')}), placed AS (SELECT query_id, chunk_id, score, {_RANK.format(id='chunk_id')} FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5",
    "rrf_hybrid": _hybrid(5, 15, 0.6, 0.4, "AND score >= 0.3"),
    "rrf_weighted": _hybrid(10, 30, 0.2, 0.8, ""),
    "rrf_recorded_legs": f"WITH legs AS (SELECT query_id, chunk_id, leg, min(rank) AS rank FROM results WHERE rank IS NOT NULL AND score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan') GROUP BY ALL), fused AS (SELECT query_id, chunk_id, round(sum(CASE leg WHEN 'dense' THEN 0.6 ELSE 0.4 END::DOUBLE / (60 + rank)), 12) AS score FROM legs WHERE leg IN ('dense', 'sparse') GROUP BY ALL), placed AS (SELECT query_id, chunk_id, round(score, 9) AS score, {_RANK.format(id='chunk_id')} FROM fused) SELECT * FROM placed WHERE rank <= 5",
    "multi_query_dense": f"WITH {_CORPUS}, {_VARIANTS}, v2 AS (SELECT query_id * 10 + variant_no AS kid, query FROM variants), {_hashed('hc', 'corpus', 'chunk_id', 'text')}, {_hashed('hq', 'v2', 'kid', 'query')}, s AS ({_cosines('hq', 'kid', 'hc', 'chunk_id')}), ranked AS (SELECT kid // 10 AS query_id, kid % 10 AS variant_no, chunk_id, score, row_number() OVER (PARTITION BY kid ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5), {_FIRST}, placed AS (SELECT query_id, chunk_id, score, {_RANK.format(id='chunk_id')} FROM first) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5",
    "rerank_cosine": f"WITH {_CORPUS}, {_hashed('hc', 'corpus', 'chunk_id', 'text')}, {_hashed('hq', 'queries', 'query_id', 'query')}, want AS (SELECT DISTINCT query_id, chunk_id FROM results WHERE query_id IN (SELECT query_id FROM queries) AND chunk_id IN (SELECT chunk_id FROM corpus)), c AS ({_cosines('hq', 'query_id', 'hc', 'chunk_id', 'want')}), s AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM want LEFT JOIN c USING (query_id, chunk_id)), placed AS (SELECT query_id, chunk_id, score, {_RANK.format(id='chunk_id')} FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5",
    "ir_metrics": _IR + " SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(rr, 6) AS reciprocal_rank, round(g, 6) AS ndcg FROM m",
    "ir_averages": _IR + " SELECT round(coalesce(avg(p), 0), 6) AS avg_precision, round(coalesce(avg(r), 0), 6) AS avg_recall, round(coalesce(avg(rr), 0), 6) AS avg_reciprocal_rank, round(coalesce(avg(g), 0), 6) AS avg_ndcg, count(*) AS num_questions FROM m",
    "kg_entities": f"WITH {_mentions()} SELECT doc_id, entity_type, name, count(*) AS n FROM mentions GROUP BY ALL",
    "kg_relations": f"WITH {_edges()} SELECT doc_id, src, dst, relation_type, count(*) AS n FROM links GROUP BY ALL",
    "kg_edges": f"WITH {_GRAPH} SELECT src, dst, relation_type, source_text FROM edges",
    "kg_nodes": f"WITH {_GRAPH}, docs AS (SELECT entity_type || '::' || name AS node_id, arg_max(coalesce(source_file, ''), doc_id) AS source_document, max(CASE WHEN entity_type IN ('monetary_amount', 'percentage', 'date') THEN name END) AS raw FROM mentions GROUP BY 1) SELECT node_id, name, entity_type, source_document, raw FROM nodes LEFT JOIN docs USING (node_id)",
    "kg_degree": f"WITH {_GRAPH}, e AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges), c AS (SELECT node_id, count(*) AS n FROM e GROUP BY ALL) SELECT node_id, coalesce(n, 0)::BIGINT AS degree FROM nodes LEFT JOIN c USING (node_id)",
    "kg_related": f"WITH {_GRAPH}, {_walk()} SELECT seed, node_id, distance, position FROM walked",
    "kg_rivals": f"""WITH {_GRAPH}, {_walk("WHERE relation_type = 'competes_with'")} SELECT seed, node_id, distance FROM walked""",
    "kg_context": f"""WITH {_GRAPH}, {_walk()}
SELECT seed, 'Knowledge Graph Context for ' || regexp_replace(seed, '^[^:]*::', '') || ':' || chr(10) || string_agg('  - [' || relation || '] ' || coalesce(name, node_id) || ' (type: ' || coalesce(entity_type, '') || ', hops: ' || distance::VARCHAR || ')', chr(10) ORDER BY position) AS context
FROM walked JOIN nodes USING (node_id) WHERE position <= 20 GROUP BY seed""",
    "kg_summary": f"WITH {_GRAPH}, ends AS (SELECT src AS node_id, 'out' AS direction, relation_type, dst AS other FROM edges UNION ALL SELECT dst, 'in', relation_type, src FROM edges) SELECT e.node_id, direction, relation_type, count(*) AS n, min(coalesce(n.name, e.other)) AS first, max(coalesce(n.name, e.other)) AS last FROM ends e JOIN nodes n ON n.node_id = e.other WHERE e.node_id IN (SELECT node_id FROM seeds) GROUP BY ALL",
    "kg_stored_degree": "WITH e AS (SELECT DISTINCT 'filing::' || source_document AS src, node_id AS dst FROM entities WHERE source_document IS NOT NULL) SELECT node_id, count(*)::BIGINT AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY ALL",
    "guard_factual": f"WITH {_ANSWERS}, {_PARTS}, {_FACTUAL} SELECT answer_id, severity, message, span FROM factual",
    "guard_hallucination": f"WITH {_ANSWERS}, {_CLAIMED} SELECT answer_id, severity, message, span FROM claimed",
    "guard_numeric": f"WITH {_ANSWERS}, {_COUNTED}, {_NUMERIC} SELECT answer_id, severity, message, span FROM numeric_",
    "guard_format": f"WITH {_ANSWERS}, {_FORM} SELECT answer_id, severity, message FROM form",
    "guard_confidence": f"WITH {_ANSWERS}, {_FINDINGS}, found AS (SELECT answer_id, severity FROM factual UNION ALL SELECT answer_id, severity FROM claimed UNION ALL SELECT answer_id, severity FROM numeric_ UNION ALL SELECT answer_id, severity FROM form), per AS (SELECT answer_id, sum(CASE severity WHEN 'low' THEN 0.02 WHEN 'medium' THEN 0.08 ELSE 0.15 END::DOUBLE) AS cost, count(*) AS findings, sum((severity = 'high')::INT) AS high FROM found GROUP BY ALL), c AS (SELECT answer_id, round(greatest(0, least(1, 1 - coalesce(cost, 0))), 9) AS confidence, coalesce(findings, 0)::BIGINT AS findings, coalesce(high, 0)::BIGINT AS high FROM (SELECT DISTINCT answer_id FROM answers) LEFT JOIN per USING (answer_id)) SELECT answer_id, round(confidence, 6) AS confidence, confidence >= 0.7 AS passed, findings, high FROM c",
    "faithfulness": f"WITH {_ANSWERS}, {_PARTS}, long AS (SELECT answer_id, len(w) = 0 OR len(list_filter(w, lambda x: contains(low, x)))::DOUBLE / greatest(len(w), 1) >= 0.3 AS good FROM sents WHERE length(s) > 15) SELECT answer_id, round(coalesce(avg(good::INT), 1), 6) AS faithfulness FROM answers LEFT JOIN long USING (answer_id) GROUP BY ALL",
    "context_relevancy": f"WITH {_ANSWERS}, w AS (SELECT answer_id, sources, list_distinct({_tokens('query', '{4,}')}) AS q FROM answers) SELECT answer_id, round(CASE WHEN len(q) > 0 AND len(sources) > 0 THEN len(list_filter(sources, lambda t: len(list_intersect(q, {_tokens('t', '{4,}')}))::DOUBLE / len(q) >= 0.2))::DOUBLE / len(sources) ELSE 0 END, 6) AS context_relevancy FROM w",
    "numerical_accuracy": f"WITH {_ANSWERS}, {_COUNTED}, c AS (SELECT answer_id, contains(src, c) OR (v IS NOT NULL AND len(list_filter(vals, lambda s: abs(v - s) / greatest(abs(s), 1e-10) < 0.02)) > 0) AS good FROM counted_numbers) SELECT answer_id, round(coalesce(avg(good::INT), 1), 6) AS numerical_accuracy FROM answers LEFT JOIN c USING (answer_id) GROUP BY ALL",
    "answer_relevancy": f"WITH {_ANSWERS}, aa AS (SELECT answer_id, query, substring(answer, 1, 500) AS head FROM answers), {_hashed('hq', 'aa', 'answer_id', 'query')}, {_hashed('ha', 'aa', 'answer_id', 'head')}, c AS (SELECT answer_id, sum(x.c * y.c)::DOUBLE AS dot FROM hq_b x JOIN ha_b y USING (answer_id, b) GROUP BY ALL) SELECT answer_id, round(coalesce(dot / (hq.norm * ha.norm), 0), 6) AS answer_relevancy FROM answers LEFT JOIN c USING (answer_id) LEFT JOIN hq USING (answer_id) LEFT JOIN ha USING (answer_id)",
    "prompt_sources": f"WITH {_CORPUS}, {_INDEX}, {_scored('queries')}, placed AS (SELECT query_id, chunk_id, share AS score, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, chunk_id) AS rank FROM shares QUALIFY rank <= 5), made AS (SELECT query_id, string_agg('[Source ' || rank::VARCHAR || ']' || chr(10) || {_BLOCK}, chr(10) ORDER BY rank) AS sources FROM placed JOIN corpus USING (chunk_id) GROUP BY ALL) SELECT query_id, length(coalesce(sources, ''))::INT AS n_chars, md5(coalesce(sources, '')) AS digest, md5('Sources:' || chr(10) || coalesce(sources, '') || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer from the sources above, cite them, and show how numbers were computed.') AS prompt_digest FROM queries LEFT JOIN made USING (query_id)",
}
