"""SQL equivalents that need several steps, for queries of the other modules.

Where Spark looks ahead or behind in a pattern, the SQL marks the places first and splits there.
"""

from __future__ import annotations

from folioscope.functions import text as T
from folioscope.operators import planning as G
from folioscope.plans import evidence, records
from folioscope.plans.common import SPACE, sql_ascii_tokens, sql_squash, sql_text, sql_tokens

QUERIES: dict = {}

_PAP, _SEC, _OBJ, _CHK = evidence._PAP, evidence._SEC, evidence._OBJ, evidence._CHK
_CUT = "chr(1)"

# sentences: a blank behind . ! or ?
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({sql_squash('text')}, '([.!?]) +', '\\1' || {_CUT}, 'g'), {_CUT}), lambda x: trim(x)), lambda x: x <> '')"

# list items: words that are markers and not the last
_MARK = "(?:[-•*–]|\\(?\\d{1,3}[.)]|\\([a-z]\\))"
_ITEMS = f"""w AS (SELECT object_id, {sql_squash("coalesce(text, '')")} AS s, string_split({sql_squash("coalesce(text, '')")}, ' ') AS ws FROM {_OBJ} WHERE object_type = 'list_block'),
m AS (SELECT object_id, s, list_filter(list_transform(string_split(array_to_string(list_transform(ws, lambda x, i: CASE WHEN regexp_full_match(x, '{_MARK}') AND i < len(ws) THEN {_CUT} || x ELSE x END), ' '), {_CUT}), lambda x: trim(x)), lambda x: regexp_matches(x, '^{_MARK}\\s+\\S')) AS a,
  list_filter(list_transform(string_split(s, '; '), lambda x: trim(x)), lambda x: x <> '') AS b FROM w),
items AS (SELECT object_id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM (SELECT object_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) >= 2 THEN b ELSE [] END AS l FROM m))"""

# author lines: commas before a capital, and the word "and"
_LINE = f"array_to_string(list_transform(list_filter(authors, lambda a: trim(a) <> ''), lambda a: {sql_squash('a')}), ' and ')"
_PARTS = f"string_split(regexp_replace(regexp_replace({_LINE}, '\\s*,\\s*(\\p{{Lu}})', {_CUT} || '\\1', 'g'), '\\s+and\\s+', {_CUT}, 'g'), {_CUT})"
_MARKS = "[\\d*†‡§¶,]+"


def _known(names: dict[str, str], words: str) -> str:
    """The names that the words stand for, in order, each once."""
    table = "MAP {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in names.items()) + "}"
    found = f"list_filter(list_transform({words}, lambda w: {table}[w]), lambda x: x IS NOT NULL)"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def _constraints(lead: str) -> str:
    """(item_id, q, venues, years, tracks, priors) of the items' texts behind a lead."""
    q = f"SELECT item_id, {sql_text(lead)} || text AS q, lower({sql_text(lead)} || text) AS t, {sql_tokens(sql_text(lead) + ' || text')} AS ws FROM eval_items"
    years = "list_sort(list_distinct(list_transform(regexp_extract_all(q, '\\b(20\\d{2})\\b', 1), lambda y: y::INT)))"
    return f"SELECT item_id, q, {_known(G.VENUES, 'ws')} AS venues, {years} AS years, {_known(G.TRACKS, 'ws')} AS tracks, list_filter(string_split({records._PRIORS}, ','), lambda x: x <> '') AS priors FROM ({q})"


_NODES = "list_concat(list_concat(list_transform(venues, lambda x: ['scope', x]), list_transform(years, lambda x: ['scope', x::VARCHAR])), list_concat(list_transform(tracks, lambda x: ['scope', x]), list_transform(priors, lambda x: ['section', x])))"


def _escape(c: str) -> str:
    return f"replace(replace(replace(replace({c}, chr(92), chr(1)), '{{', chr(92) || '{{'), '}}', chr(92) || '}}'), chr(1), chr(92) || 'textbackslash{{}}')"


_AUTHORS = f"list_transform(list_filter(coalesce(authors, []), lambda a: trim(a) <> ''), lambda a: {sql_squash('a')})"
_FIELDS = (("title", sql_squash("title")), ("author", f"array_to_string({_AUTHORS}, ' and ')"), ("booktitle", "upper(venue)"), ("year", "year::VARCHAR"), ("doi", "doi"), ("url", "url"), ("abstract", sql_squash("abstract")))
_BIB = ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '  {n} = {{' || {_escape(c)} || '}}' END" for n, c in _FIELDS)
_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower(paper_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '')"
_TAG = lambda t, c: f"CASE WHEN coalesce({c}, '') <> '' THEN '{t}  - ' || {c} END"
_AU = f"list_transform({_AUTHORS}, lambda a: 'AU  - ' || a)"
_RIS = f"list_concat(list_concat(['TY  - CONF', {_TAG('TI', sql_squash('title'))}], {_AU}), [{_TAG('T2', 'upper(venue)')}, {_TAG('PY', 'year::VARCHAR')}, {_TAG('DO', 'doi')}, {_TAG('UR', 'url')}, {_TAG('AB', sql_squash('abstract'))}, 'ER  - '])"

_TYPED = f"(SELECT c.paper_id, c.chunk_id, c.heading AS section_title, s.section_path, c.text FROM {_CHK} c LEFT JOIN {_SEC} s USING (section_id))"
_INTRO = evidence.ORACLE["intro_summaries"].split(" SELECT paper_id, md5(")[0].removeprefix("WITH ")

# abstracts: what follows the mark, up to the next part or the end, between 40 and 3000 characters
_BODY = sql_squash("coalesce(text, '')")
_WORDS = lambda c: f"len(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
_FORM = "upper(" + sql_squash("regexp_replace(section_title, '^[\\s#■▪•*]*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?', '')") + ")"
_ABSTRACTS = f"""WITH s0 AS (SELECT paper_id, ordinal, {_BODY} AS b, {_FORM} AS h FROM {_SEC}),
s1 AS (SELECT *, regexp_extract(b, '(?i)^.*?\\babstract\\b\\s*[:.—-]+\\s*', 0) AS lead FROM s0 WHERE b <> ''),
s2 AS (SELECT *, CASE WHEN lead <> '' THEN substr(b, length(lead) + 1) ELSE '' END AS rest FROM s1),
s3 AS (SELECT *, regexp_matches(substr(rest, 41), '(?i)\\b(?:introduction|keywords)\\b') AS named, 40 + length(regexp_extract(substr(rest, 41), '(?i)^(.*?)\\b(?:introduction|keywords)\\b', 1)) AS upto FROM s2),
s4 AS (SELECT *, trim(CASE WHEN length(rest) < 40 THEN '' WHEN named AND upto <= 3000 THEN substr(rest, 1, upto) WHEN length(rest) <= 3000 THEN rest ELSE '' END) AS i FROM s3),
hit AS (SELECT paper_id, arg_min(CASE WHEN contains(h, 'ABSTRACT') THEN [b, 'section.abstract'] ELSE [i, 'section.inline_abstract'] END, ordinal) AS hit FROM s4 WHERE contains(h, 'ABSTRACT') OR {_WORDS('i')} >= 20 GROUP BY paper_id),
intro AS (SELECT paper_id, {evidence._short("arg_min(b, ordinal)", 1200)} AS t FROM s4 WHERE contains(h, 'INTRODUCTION') GROUP BY paper_id),
j AS (SELECT paper_id, {sql_squash("coalesce(abstract, '')")} AS own, substr({_BODY}, 1, 2000) AS head, hit, t FROM {_PAP} LEFT JOIN hit USING (paper_id) LEFT JOIN intro USING (paper_id)),
x AS (SELECT CASE WHEN {_WORDS('own')} >= 20 THEN [own, 'paper_record.abstract'] WHEN hit IS NOT NULL THEN hit WHEN {_WORDS("coalesce(t, '')")} >= 20 THEN [t, 'paper_record.intro_summary'] ELSE [head, 'paper_record.text_prefix'] END AS v FROM j)
SELECT v[2] AS abstract_source, count(*) AS n, sum(length(v[1]))::BIGINT AS n_chars FROM x GROUP BY ALL"""

#: Cosine of hashed token counts of every question with every chunk of at least 20 characters.
_HYBRID = f"""WITH {evidence._BM25},
chk AS (SELECT chunk_id, paper_id, concat_ws(chr(10), heading, text) AS t FROM {_CHK} WHERE length(trim(text)) >= 20), qs AS (SELECT item_id, text AS t FROM eval_items WHERE kind = 'question'),
cc AS (SELECT chunk_id, slot, count(*)::DOUBLE AS c FROM (SELECT chunk_id, unnest({evidence._slots('t')}) AS slot FROM chk) GROUP BY ALL), qc AS (SELECT item_id, slot, count(*)::DOUBLE AS c FROM (SELECT item_id, unnest({evidence._slots('t')}) AS slot FROM qs) GROUP BY ALL),
cn AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM cc GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qc GROUP BY 1),
dots AS (SELECT item_id, chunk_id, sum(qc.c * cc.c) AS dot FROM qc JOIN cc USING (slot) GROUP BY ALL),
sim AS (SELECT q.item_id, k.chunk_id, k.paper_id, round(coalesce(dot / (qn.n * cn.n), 0.0), 6) AS s FROM qs q CROSS JOIN chk k LEFT JOIN dots d ON d.item_id = q.item_id AND d.chunk_id = k.chunk_id LEFT JOIN qn ON qn.item_id = q.item_id LEFT JOIN cn ON cn.chunk_id = k.chunk_id),
best AS (SELECT item_id, paper_id, max(s) AS s, arg_min(chunk_id, (-s, chunk_id)) AS chunk_id FROM sim GROUP BY ALL),
every AS (SELECT q.item_id, p.paper_id, coalesce(b.s, '-infinity'::DOUBLE) AS s, b.chunk_id, coalesce(sc.score, 0.0) AS f FROM qs q CROSS JOIN docs p LEFT JOIN best b ON b.item_id = q.item_id AND b.paper_id = p.paper_id LEFT JOIN sc ON sc.item_id = q.item_id AND sc.paper_id = p.paper_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY f DESC, paper_id) AS rf, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, paper_id) AS rs FROM every),
fu AS (SELECT item_id, paper_id, chunk_id, round(1.0::DOUBLE / (60 + rf) + 1.0::DOUBLE / (60 + rs), 12) AS score FROM rk)
SELECT item_id, paper_id, round(score, 9) AS score, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paper_id) AS rank FROM fu) WHERE rank <= 20"""

_NEAR = f"""WITH RECURSIVE o AS (SELECT *, bbox[1] + bbox[3] AS sx, bbox[2] + bbox[4] AS sy FROM {_OBJ} WHERE len(coalesce(bbox, [])) = 4),
b AS (SELECT paper_id, object_id, page_idx, sx, sy, row_number() OVER (PARTITION BY paper_id ORDER BY ordinal, object_id) AS i FROM o WHERE object_type IN ('text_block', 'list_block')),
x AS (SELECT paper_id, object_id, page_idx, sx, sy FROM o WHERE object_type IN ('table_block', 'figure_block')),
go AS (
  SELECT DISTINCT paper_id, 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS block_id, NULL::VARCHAR AS supplement_id, NULL::DOUBLE AS distance FROM b
  UNION ALL
  SELECT g.paper_id, b.i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, b.object_id, pick, far
  FROM go g JOIN b ON b.paper_id = g.paper_id AND b.i = g.i + 1
  LEFT JOIN LATERAL (SELECT arg_min(x.object_id, (sqrt(power((b.sx - x.sx) / 2, 2) + power((b.sy - x.sy) / 2, 2)), x.object_id)) AS pick, min(sqrt(power((b.sx - x.sx) / 2, 2) + power((b.sy - x.sy) / 2, 2))) AS far
    FROM x WHERE x.paper_id = b.paper_id AND x.page_idx = b.page_idx AND NOT list_contains(g.used, x.object_id)) n ON true
)
SELECT paper_id AS doc, block_id, supplement_id, round(distance, 6) AS distance FROM go WHERE supplement_id IS NOT NULL"""

ORACLE = {
    "rationale_points": f"SELECT item_id, s[1] AS main_reason, len(list_distinct(list_filter(s[2:4], lambda x: lower(x) <> lower(s[1]))))::INT AS n_points FROM (SELECT item_id, {_SENTENCES} AS s FROM eval_items)",
    "list_item_units": f"WITH {_ITEMS} SELECT object_id, (pos - 1)::INT AS pos, md5(item) AS item_md5 FROM items",
    "author_lines": f"""WITH p AS (SELECT paper_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT paper_id, {_PARTS} AS l FROM {_PAP} WHERE authors IS NOT NULL)),
n AS (SELECT paper_id, i, {sql_squash(f"regexp_replace(p, '{_MARKS}{SPACE}*$', '')")} AS name, len(list_filter(string_split(regexp_replace(regexp_extract(p, '({_MARKS})\\s*$', 1), '([*†‡§¶])', ',\\1', 'g'), ','), lambda x: x <> '')) AS n_markers FROM p)
SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1)::INT AS pos, name, n_markers::INT AS n_markers FROM n WHERE name <> ''""",
    "question_constraints": f"SELECT item_id, array_to_string(venues, ',') AS venues, array_to_string(years, ',') AS years, array_to_string(tracks, ',') AS tracks, array_to_string(priors, ',') AS priors FROM ({_constraints('ACL or NIPS 2021, no demo: ')})",
    "constraint_graphs": f"""SELECT item_id, concat_ws(',', CASE WHEN regexp_matches(lower(q), '\\bor\\b') THEN 'or' END, CASE WHEN regexp_matches(lower(q), '\\b(?:not|without|except)\\b') THEN 'not' END) AS operators,
array_to_string(list_transform({_NODES}, lambda n, i: n[1] || '_' || i || '=' || n[2]), ',') AS nodes FROM ({_constraints('ACL or NIPS 2021, no demo without baseline: ')})""",
    "release_fingerprints": """SELECT corpus_key, n_rows, sha256(concat_ws(':', n_rows, a, b, c, d)) AS fingerprint FROM (SELECT corpus_key, count(*) AS n_rows, """
    + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT) AS {n}" for i, n in enumerate("abcd"))
    + " FROM (SELECT corpus_key, sha256(to_json({'paper_id': paper_id, 'title': title, 'year': year})::VARCHAR) AS h FROM (SELECT DISTINCT corpus_key, paper_id, title, year FROM papers)) GROUP BY corpus_key)",
    "bibtex_export": f"SELECT paper_id, '@inproceedings{{' || {_SLUG} || ',' || chr(10) || array_to_string(list_filter([{_BIB}], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS value FROM {_PAP}",
    "ris_export": f"SELECT paper_id, array_to_string(list_filter({_RIS}, lambda x: x IS NOT NULL), chr(10)) AS value FROM {_PAP}",
    "evidence_units": records.ORACLE["evidence_core"].replace("WITH s AS", f"WITH {_ITEMS}, s AS", 1)
    + f"\nUNION ALL SELECT 'evidence_' || {records._SHA.format("s.paper_id || ':' || i.object_id || ':list_item:' || i.pos")}, s.paper_id, 'list_item_unit', s.section_id, s.section_kind, length(i.item), 1, 0 FROM items i JOIN o USING (object_id) JOIN s ON s.section_id = o.section_id",
    "paper_search_texts": records._sql_evidence_scores(_TYPED, "paper_id, chunk_id")
    + f""", {_INTRO}, ty AS (SELECT paper_id, string_agg(trim(repeat(replace(evidence_type, '_', ' ') || ' evidence ', least(3, n)::INT)), ' ' ORDER BY evidence_type) AS types FROM (SELECT paper_id, evidence_type, count(*) AS n FROM allscores WHERE score >= 0.35 GROUP BY ALL) GROUP BY paper_id),
hd AS (SELECT paper_id, string_agg(section_title, ' ' ORDER BY ordinal, section_id) AS heads FROM {_SEC} GROUP BY paper_id)
SELECT p.paper_id, md5({evidence._join("' '", "p.title", "p.abstract", "heads", evidence._short("t.t", 1200), "array_to_string(p.keywords, ' ')", "types")}) AS text_md5 FROM {_PAP} p LEFT JOIN t USING (paper_id) LEFT JOIN hd USING (paper_id) LEFT JOIN ty USING (paper_id)""",
    "abstract_sources": _ABSTRACTS,
    "hybrid_retrieval": _HYBRID,
    "nearest_supplements": _NEAR,
}
