"""SQL that gives the same rows as queries of this package, where SQL can express them."""

from __future__ import annotations


def _doi(c: str) -> str:
    tight = rf"replace(regexp_replace(lower({c}), '[\s\p{{Z}}\p{{Cf}}]+', '', 'g'), '%2f', '/')"
    found = rf"""regexp_replace(regexp_extract({tight}, '(10\.[0-9]{{4,9}}/[^?#<>\s]+)', 1), '[.,;:)\]}}"''>]+$', '')"""
    bare = rf"CASE WHEN starts_with({found}, '10.48550/arxiv.') THEN regexp_replace({found}, 'v[0-9]+$', '') ELSE {found} END"
    return rf"(CASE WHEN regexp_matches({bare}, '^10\.[0-9]{{4,9}}/.') THEN {bare} END)"


def _arxiv(c: str) -> str:
    tight = rf"regexp_replace(lower({c}), '[\s\p{{Z}}\p{{Cf}}]+', '', 'g')"
    return rf"nullif(regexp_extract({tight}, '^(?:arxiv:|(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/)?([0-9]{{4}}\.[0-9]{{4,5}}|[a-z][a-z-]*(?:\.[a-z]{{2}})?/[0-9]{{7}})(?:v[0-9]+)?(?:\.pdf)?(?:[?#].*)?$', 1), '')"


_TITLE = r"nullif(regexp_replace(lower(nfc_normalize(title)), '[^\p{L}\p{N}]+', '', 'g'), '')"
_KEYED = f"SELECT id, concat(coalesce({_doi('doi')}, ''), chr(10), {_TITLE}) AS k FROM papers WHERE {_TITLE} IS NOT NULL"

SQL = {
    "p1_found": f"WITH k AS ({_KEYED}), g AS (SELECT k, min(id) AS first_id FROM k GROUP BY 1) SELECT g.first_id, k.id AS copy_id FROM k JOIN g USING (k) WHERE k.id <> g.first_id",
    "p1_counts": f"SELECT min(id) AS first_id, count(*) AS n_copies FROM ({_KEYED}) GROUP BY k",
    "p6_found": f"""WITH RECURSIVE p AS (SELECT id, {_doi('doi')} AS d, {_arxiv('arxiv_id')} AS a FROM papers),
i AS (SELECT id, d AS k FROM p WHERE d IS NOT NULL AND NOT starts_with(d, '10.48550/arxiv.') UNION SELECT id, concat('a', {_arxiv("substr(d, 16)")}) FROM p WHERE starts_with(d, '10.48550/arxiv.') UNION SELECT id, concat('a', a) FROM p WHERE a IS NOT NULL),
s AS (SELECT k, min(id) AS m FROM i WHERE k IS NOT NULL GROUP BY 1),
e AS (SELECT i.id AS x, s.m AS y FROM i JOIN s USING (k) WHERE i.id <> s.m UNION SELECT left_id, right_id FROM match_pairs WHERE left_id <> right_id AND left_id IN (SELECT id FROM p) AND right_id IN (SELECT id FROM p)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS node, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON r.node = b.x WHERE b.y > r.root)
SELECT min(root) AS group_id, node AS id FROM r GROUP BY node""",
}
