"""SQL equivalents of the search: every stage over all rows, with the hashed encoder, no reranker and thresholds as verifier."""

from __future__ import annotations

from folioscope.functions import text as T
from folioscope.operators import search as S
from folioscope.plans import evidence, records
from folioscope.plans.common import sql_match, sql_squash, sql_text, sql_tokens
from folioscope.plans.equivalents import _INTRO, _TYPED

QUERIES: dict = {}

_PAP, _SEC, _CHK = evidence._PAP, evidence._SEC, evidence._CHK
_BLANK = "' '"
_ORDER = "[" + ", ".join(map(sql_text, T.EVIDENCE_CUES)) + "]"


def _rank(by: str, score: str, key: str) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, {key})"


def _scaled(x: str, by: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY {by})", f"max({x}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {hi} - {lo} < 1e-9 THEN CASE WHEN {hi} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE ELSE ({x} - {lo}) / ({hi} - {lo}) END"


def _best3(source: str, by: str, score: str, tie: str) -> str:
    return f"SELECT {by}, sum(CASE r WHEN 1 THEN 0.7 WHEN 2 THEN 0.2 ELSE 0.1 END::DOUBLE * {score}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {tie}) AS r FROM {source}) WHERE r <= 3 GROUP BY {by}"


#: Search texts of the three levels.
_TEXTS = f"""{records._sql_evidence_scores(_TYPED, "paper_id, chunk_id")}, {_INTRO},
kinds AS (SELECT chunk_id, string_agg(evidence_type || ' evidence', ' ' ORDER BY score DESC, list_position({_ORDER}, evidence_type)) AS types FROM allscores WHERE score >= 0.35 GROUP BY chunk_id),
tw AS (SELECT paper_id, string_agg(trim(repeat(replace(evidence_type, '_', ' ') || ' evidence ', least(3, n)::INT)), ' ' ORDER BY evidence_type) AS types FROM (SELECT paper_id, evidence_type, count(*) AS n FROM allscores WHERE score >= 0.35 GROUP BY ALL) GROUP BY paper_id),
hd AS (SELECT paper_id, string_agg(section_title, ' ' ORDER BY ordinal, section_id) AS heads FROM {_SEC} GROUP BY paper_id),
pt AS (SELECT p.paper_id AS k, {evidence._join(_BLANK, "p.title", "p.abstract", "heads", evidence._short("t.t", 1200), "array_to_string(p.keywords, ' ')", "types")} AS x FROM {_PAP} p LEFT JOIN t USING (paper_id) LEFT JOIN hd USING (paper_id) LEFT JOIN tw USING (paper_id)),
st AS (SELECT section_id AS k, paper_id, {evidence._join(_BLANK, "section_title", "array_to_string(section_path, ' ')", evidence._short(sql_squash("text"), 900), "text")} AS x FROM {_SEC}),
ct AS (SELECT c.chunk_id AS k, c.section_id, c.paper_id, c.chunk_type, c.heading, c.text, {evidence._join(_BLANK, "c.heading", "array_to_string(s.section_path, ' ')", "c.text", "kinds.types")} AS x FROM {_CHK} c LEFT JOIN (SELECT section_id, section_path FROM {_SEC}) s USING (section_id) LEFT JOIN kinds USING (chunk_id))"""


def _scores(level: str, queries: str) -> str:
    """{level}s(q, k, s): Okapi scores, {level}d(q, k, s): cosines of hashed counts; rows without a common term are absent."""
    x = level
    return f"""
{x}t AS (SELECT k, {sql_tokens("x")} AS t FROM {x}), {x}n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM {x}t),
{x}p AS (SELECT k, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT k, len(t) AS dl, unnest(t) AS term FROM {x}t) GROUP BY ALL),
{x}f AS (SELECT term, ln((SELECT n_docs FROM {x}n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {x}p GROUP BY term),
{x}i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {x}f) ELSE raw END AS idf FROM {x}f),
{x}s AS (SELECT q, k, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM {x}n)))) AS s FROM {x}p JOIN asked USING (term) JOIN {x}i USING (term) GROUP BY ALL),
{x}c AS (SELECT k, slot, count(*)::DOUBLE AS c FROM (SELECT k, unnest({evidence._slots("x")}) AS slot FROM {x}) GROUP BY ALL), {x}l AS (SELECT k, sqrt(sum(c * c)) AS l FROM {x}c GROUP BY k),
{x}d AS (SELECT q, k, dot / ((ql.l + 1e-12) * (dl.l + 1e-12)) AS s FROM (SELECT q, k, sum(a.c * b.c) AS dot FROM qc a JOIN {x}c b USING (slot) GROUP BY ALL) JOIN ql USING (q) JOIN {x}l dl USING (k))"""


def _search(profile: str, result: str) -> str:
    planned = profile != "no_planner"
    extra = """
  UNION ALL SELECT plan_id, 'aspect', 'a' || r, trim(query), 1.0::DOUBLE / 3 FROM (SELECT topic AS plan_id, text AS query, row_number() OVER (PARTITION BY topic ORDER BY length(text) DESC, item_id) AS r FROM eval_items WHERE kind = 'question') WHERE r <= 3
  UNION ALL SELECT plan_id, 'bucket', 'b1', trim(plan_id || ' reaction yield and conversion'), 1.0 FROM topics UNION ALL SELECT plan_id, 'bucket', 'b2', trim(plan_id || ' reference measured by loading'), 1.0 FROM topics"""
    w = "CASE WHEN kind = 'global' THEN 1.0 ELSE weight END"
    weights = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SOURCE_WEIGHTS.items()) + " END::DOUBLE"
    results = " OR ".join(f"contains(description, '{x}')" for x in S.RESULT_WORDS)
    limit, cut = S.SOURCE_LIMIT, max(S.SOURCE_LIMIT * 12, 300)
    nothing = "" if planned else " WHERE false"
    pre = f"SELECT plan_id, paper_id, coarse, {_scaled('coarse', 'plan_id')} AS pre FROM pool" if profile == "no_content_refinement" else "SELECT plan_id, paper_id, coarse, 0.35 * a + 0.25 * b + 0.40 * c AS pre FROM scaled_"
    judged = "'satisfied' AS verdict, pre AS final_score" if profile == "no_verifier" else "CASE WHEN pre >= 0.6 THEN 'satisfied' WHEN pre >= 0.3 THEN 'partial' ELSE 'rejected' END AS verdict, least(1.0, greatest(0.0, pre)) + 0.05 * coarse AS final_score"
    return f"""{_TEXTS},
topics AS (SELECT DISTINCT topic AS plan_id FROM eval_items),
queries AS (SELECT * FROM (SELECT plan_id, 'global' AS kind, 'global' AS name, trim(plan_id) AS q, 1.0::DOUBLE AS weight FROM topics{extra if planned else ""}) WHERE q <> ''),
terms AS (SELECT * FROM (SELECT plan_id, 'entity' AS kind, {sql_match("plan_id")} AS m FROM topics UNION ALL SELECT plan_id, 'phrase', {sql_match("plan_id || ' step is'")} FROM topics){nothing}),
buckets AS (SELECT * FROM (SELECT plan_id, 'b1' AS bucket_id, 'evaluation result' AS description, 2 AS target FROM topics UNION ALL SELECT plan_id, 'b2', 'background', 1 FROM topics){nothing}),
uq AS (SELECT DISTINCT q FROM queries),
asked AS (SELECT q, term, count(*) AS qf FROM (SELECT q, unnest({sql_tokens("q")}) AS term FROM uq) GROUP BY ALL),
qc AS (SELECT q, slot, count(*)::DOUBLE AS c FROM (SELECT q, unnest({evidence._slots("q")}) AS slot FROM uq) GROUP BY ALL), ql AS (SELECT q, sqrt(sum(c * c)) AS l FROM qc GROUP BY q),{_scores("pt", "uq")},{_scores("st", "uq")},{_scores("ct", "uq")},
cq AS (SELECT * FROM queries WHERE kind IN ('global', 'aspect')),
rs AS (SELECT * FROM (SELECT *, {_rank('q', 's', 'k')} AS rank FROM pts WHERE s > 0) WHERE rank <= {limit}), rd AS (SELECT * FROM (SELECT *, {_rank('q', 's', 'k')} AS rank FROM ptd WHERE s > 0) WHERE rank <= {limit}),
ss AS (SELECT * FROM (SELECT *, {_rank('q', 's', 'k')} AS rank FROM sts WHERE s > 0) WHERE rank <= {cut}), sd AS (SELECT * FROM (SELECT *, {_rank('q', 's', 'k')} AS rank FROM std WHERE s > 0) WHERE rank <= {cut}),
mixed AS (SELECT m.q, m.k, st.paper_id, score FROM (SELECT coalesce(ss.q, sd.q) AS q, coalesce(ss.k, sd.k) AS k, 0.55 * coalesce(ss.s, 0) + 0.45 * coalesce(sd.s, 0) AS score FROM ss FULL JOIN sd ON ss.q = sd.q AND ss.k = sd.k) m JOIN st USING (k) WHERE score > 0),
per AS (SELECT c.*, b.paper_id, b.score FROM ({_best3('mixed', 'q, paper_id', 'score', 'k')}) b JOIN cq c USING (q)),
ph AS (SELECT t.plan_id, t.kind, c.paper_id, count(DISTINCT m) + 0.05 * count(DISTINCT c.k) AS score FROM (SELECT k, paper_id, {sql_match("concat_ws(' ', heading, text)")} AS h FROM ct) c JOIN terms t ON m <> '' AND contains(' ' || h || ' ', ' ' || m || ' ') GROUP BY ALL),
sources AS (
  SELECT plan_id, k AS paper_id, 'paper_sparse' AS source, sum({w} / (60 + rank)) AS score FROM rs JOIN cq USING (q) GROUP BY ALL UNION ALL SELECT plan_id, k, 'paper_dense', sum({w} / (60 + rank)) FROM rd JOIN cq USING (q) GROUP BY ALL
  UNION ALL SELECT plan_id, paper_id, 'section_aggregated', sum({w} * score) FROM per GROUP BY ALL
  UNION ALL SELECT plan_id, paper_id, CASE kind WHEN 'entity' THEN 'literal_entity' ELSE 'exact_phrase' END, score::DOUBLE FROM ph),
ranked AS (SELECT * FROM (SELECT *, {_rank('plan_id, source', 'score', 'paper_id')} AS rank FROM sources) WHERE rank <= {limit}),
fused AS (SELECT plan_id, paper_id, sum({weights} / (60 + rank)) AS rrf, count(*) AS n_sources, max((source = 'literal_entity')::INT) AS literal, max((source = 'exact_phrase')::INT) AS phrase FROM ranked GROUP BY ALL),
covered AS (SELECT plan_id, paper_id, count(DISTINCT name) AS n FROM (SELECT plan_id, k AS paper_id, name FROM rs JOIN cq USING (q) WHERE kind = 'aspect' UNION ALL SELECT plan_id, k, name FROM rd JOIN cq USING (q) WHERE kind = 'aspect' UNION ALL SELECT plan_id, paper_id, name FROM per WHERE kind = 'aspect') GROUP BY ALL),
aspects AS (SELECT plan_id, count(DISTINCT name) AS n FROM cq WHERE kind = 'aspect' GROUP BY plan_id), used AS (SELECT plan_id, count(DISTINCT source) AS n FROM ranked GROUP BY plan_id),
coarse_ AS (SELECT f.plan_id, f.paper_id, rrf + 0.08 * coalesce(c.n / a.n, 0.0) + 0.05 * n_sources / u.n + 0.08 * literal + 0.04 * phrase AS coarse FROM fused f LEFT JOIN covered c USING (plan_id, paper_id) LEFT JOIN aspects a USING (plan_id) JOIN used u USING (plan_id)),
pool AS (SELECT * FROM (SELECT *, {_rank('plan_id', 'coarse', 'paper_id')} AS rank FROM coarse_) WHERE rank <= {S.POOL}),
nb AS (SELECT plan_id, name, count(*) AS n FROM queries WHERE kind = 'bucket' GROUP BY ALL),
wq AS (SELECT q.*, CASE q.kind WHEN 'global' THEN 1.0 WHEN 'aspect' THEN weight ELSE 0.35 / n END AS w FROM queries q LEFT JOIN nb ON nb.plan_id = q.plan_id AND nb.name = q.name),
grid AS (SELECT p.plan_id, p.paper_id, st.k, wq.q, wq.w, coalesce(a.s, 0.0) AS a, coalesce(b.s, 0.0) AS b FROM pool p JOIN st USING (paper_id) JOIN wq USING (plan_id) LEFT JOIN sts a ON a.q = wq.q AND a.k = st.k LEFT JOIN std b ON b.q = wq.q AND b.k = st.k),
tot AS (SELECT plan_id, paper_id, k, sum(0.55 * w * x) + sum(0.45 * w * y) AS s FROM (SELECT *, {_scaled('a', 'plan_id, q, paper_id')} AS x, {_scaled('b', 'plan_id, q, paper_id')} AS y FROM grid) GROUP BY ALL),
bonus AS (SELECT t.plan_id, g.k, max((t.kind = 'entity')::INT) * 0.08 + max((t.kind = 'phrase')::INT) * 0.05 AS b FROM (SELECT k, {sql_match("x")} AS h FROM st) g JOIN terms t ON m <> '' AND contains(' ' || h || ' ', ' ' || m || ' ') GROUP BY ALL),
narrowed AS (SELECT * FROM (SELECT plan_id, paper_id, k AS section_id, s + coalesce(b, 0.0) AS score, {_rank('plan_id, paper_id', '(s + coalesce(b, 0.0))', 'k')} AS r FROM tot LEFT JOIN bonus USING (plan_id, k)) WHERE r <= {S.SECTIONS} AND score > 0),
eg AS (SELECT n.plan_id, n.paper_id, b.bucket_id, b.description, b.target, ct.k, ct.chunk_type, q.q, coalesce(a.s, 0.0) AS a, coalesce(d.s, 0.0) AS d FROM narrowed n JOIN ct USING (section_id) JOIN buckets b USING (plan_id) JOIN queries q ON q.plan_id = n.plan_id AND q.kind = 'bucket' AND q.name = b.bucket_id LEFT JOIN cts a ON a.q = q.q AND a.k = ct.k LEFT JOIN ctd d ON d.q = q.q AND d.k = ct.k),
es AS (SELECT *, 0.35 * ns + 0.40 * nd AS score, 0.35 * ns + 0.40 * nd + CASE WHEN chunk_type IN ('table_chunk', 'figure_chunk') AND ({results}) THEN 0.04 ELSE 0.0 END AS chosen FROM (SELECT *, {_scaled('a', 'plan_id, paper_id, bucket_id, q')} AS ns, {_scaled('d', 'plan_id, paper_id, bucket_id, q')} AS nd FROM eg)),
pre_ AS (SELECT * FROM (SELECT *, {_rank('plan_id, paper_id, bucket_id', 'chosen', 'k')} AS r FROM es WHERE chosen > 0) WHERE r <= greatest(4 * target, 8)),
evid AS (SELECT * FROM (SELECT *, {_rank('plan_id, paper_id, bucket_id', 'score', 'k')} AS rank FROM pre_) WHERE rank <= target),
sec3 AS ({_best3('narrowed', 'plan_id, paper_id', 'score', 'section_id')}), top_ AS (SELECT plan_id, paper_id, bucket_id, max(score) AS score FROM evid GROUP BY ALL), str3 AS ({_best3('top_', 'plan_id, paper_id', 'score', 'bucket_id')}),
cov AS (SELECT plan_id, paper_id, count(*) AS n FROM top_ GROUP BY ALL), nbk AS (SELECT plan_id, count(DISTINCT bucket_id) AS n FROM buckets GROUP BY plan_id),
parts AS (SELECT p.plan_id, p.paper_id, p.coarse, coalesce(s.score, 0.0) AS sec, 0.7 * coalesce(t.score, 0.0) + 0.3 * coalesce(c.n, 0) / greatest(1, coalesce(k.n, 1)) AS ev FROM pool p LEFT JOIN sec3 s USING (plan_id, paper_id) LEFT JOIN str3 t USING (plan_id, paper_id) LEFT JOIN cov c USING (plan_id, paper_id) LEFT JOIN nbk k USING (plan_id)),
scaled_ AS (SELECT *, {_scaled('coarse', 'plan_id')} AS a, {_scaled('sec', 'plan_id')} AS b, {_scaled('ev', 'plan_id')} AS c FROM parts),
short_ AS (SELECT * FROM (SELECT *, {_rank('plan_id', 'pre', 'paper_id')} AS rank FROM ({pre})) WHERE rank <= {S.SHORTLIST}),
judged AS (SELECT plan_id, paper_id, {judged} FROM short_),
final_ AS (SELECT * FROM (SELECT *, {_rank('plan_id, verdict', 'final_score', 'paper_id')} AS verdict_rank FROM judged) WHERE verdict_rank <= {S.TOP_K}),
slots AS (SELECT plan_id, bucket_id, target AS need, sum(target) OVER (PARTITION BY plan_id ORDER BY bucket_id) - target AS after FROM buckets), need AS (SELECT plan_id, sum(target) AS total FROM buckets GROUP BY plan_id),
gg AS (SELECT p.plan_id, p.paper_id, ct.k, q.q, coalesce(a.s, 0.0) AS a, coalesce(d.s, 0.0) AS d FROM pool p JOIN ct USING (paper_id) JOIN queries q ON q.plan_id = p.plan_id AND q.kind = 'global' LEFT JOIN cts a ON a.q = q.q AND a.k = ct.k LEFT JOIN ctd d ON d.q = q.q AND d.k = ct.k),
gs AS (SELECT *, 0.35 * ns + 0.40 * nd AS score FROM (SELECT *, {_scaled('a', 'plan_id, paper_id')} AS ns, {_scaled('d', 'plan_id, paper_id')} AS nd FROM gg)),
gr AS (SELECT *, {_rank('plan_id, paper_id', 'score', 'k')} AS r FROM gs WHERE score > 0)
{result}"""


_RESULT = "SELECT plan_id, paper_id, verdict, round(final_score, 6) AS final_score, verdict_rank FROM final_"
ORACLE = {f"search_{p}": _search(p, _RESULT) for p in ("full", "no_planner", "no_content_refinement", "no_verifier")} | {
    "search_candidates": _search("full", "SELECT plan_id, paper_id, round(coarse, 6) AS coarse, rank FROM pool"),
    "search_sections": _search("full", "SELECT plan_id, paper_id, section_id, round(score, 6) AS score FROM narrowed"),
    "search_evidence": _search("full", "SELECT plan_id, paper_id, bucket_id, k AS chunk_id, q AS source_query, round(score, 6) AS score, rank FROM evid"),
    "search_unrefined_evidence": _search("full", "SELECT gr.plan_id, paper_id, bucket_id, k AS chunk_id, q AS source_query, round(score, 6) AS score, (r - after)::INT AS rank FROM gr JOIN need USING (plan_id) JOIN slots USING (plan_id) WHERE r <= total AND r > after AND r <= after + need"),
}
