"""SQL equivalents of the queries of this subpackage, where SQL can express and afford them.

They are brute force: all pairs of vectors of a bundle, all shared shingles, all runs of words.
"""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"

#: Papers' sets of three consecutive words, their sizes and the common ones of each pair.
_SHINGLES = f"""p AS (SELECT paper_id, arg_max({_WORDS.format("coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(text, '')")}, ingested_at) AS w FROM papers GROUP BY paper_id),
g AS (SELECT DISTINCT paper_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT paper_id, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
n AS (SELECT paper_id, count(*) AS n FROM g GROUP BY paper_id),
c AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.paper_id < b.paper_id GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "p1_found": """
WITH v AS (SELECT bundle, item_id, arg_max(vector::DOUBLE[], built_at) AS v FROM index_vectors
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 GROUP BY ALL),
s AS (SELECT a.bundle, a.item_id AS x, b.item_id AS y, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.bundle = b.bundle AND a.item_id <> b.item_id),
t AS (SELECT bundle, x, y FROM s WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY bundle, x ORDER BY c DESC, y) <= 10)
SELECT DISTINCT bundle, least(x, y) AS item_a, greatest(x, y) AS item_b FROM t""",
    "p4_found": r"""
SELECT DISTINCT section_id FROM sections
WHERE length(text) > 4000 OR len(list_filter(regexp_split_to_array(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) > 420""",
    "p6_found": f"""WITH {_SHINGLES}
SELECT paper_a, paper_b FROM c JOIN n x ON x.paper_id = paper_a JOIN n y ON y.paper_id = paper_b WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p6_groups": f"""WITH RECURSIVE {_SHINGLES},
one AS (SELECT paper_a AS a, paper_b AS b, c = x.n AND c = y.n AS same FROM c JOIN n x ON x.paper_id = paper_a JOIN n y ON y.paper_id = paper_b WHERE c >= 0.6 * (x.n + y.n - c)),
e AS (SELECT * FROM one UNION ALL SELECT b, a, same FROM one),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.paper_id, least(n.paper_id, (SELECT min(b) FROM e WHERE e.a = n.paper_id AND same)) AS class_id, least(n.paper_id, (SELECT min(b) FROM r WHERE r.a = n.paper_id)) AS group_id FROM n""",
    "p8_found": f"""
WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w, least(13, len({_WORDS.format("text")})) AS m FROM eval_items),
ig AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i WHERE m > 0)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
dg AS (SELECT doc_id, m, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM ig) WHERE len(w) >= m))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (m, g)""",
}
