"""SQL of the queries in this folder that SQL can express over whole tables."""

from __future__ import annotations

_REPO = "regexp_replace(regexp_replace(lower(trim({c}, ' ')), '^[a-z][a-z0-9+.-]*://[^/]*/', ''), '(\\.git|/|\\s)+$', '')"
_SPLIT = "CASE WHEN lower(trim({c}, ' ')) IN ('val', 'valid') THEN 'validation' ELSE nullif(lower(trim({c}, ' ')), '') END"
_EXT = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "cpp": "cpp", "cc": "cpp", "sh": "bash", "sql": "sql", "json": "json", "yaml": "yaml", "md": "markdown", "css": "css"}
_BY_EXT = "CASE lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) {} END".format(" ".join(f"WHEN '{e}' THEN '{g}'" for e, g in _EXT.items()))
_LANGUAGE = f"coalesce(CASE WHEN lower(trim(language, ' ')) IN ('', 'unknown') THEN NULL ELSE lower(trim(language, ' ')) END, {_BY_EXT})"

P1 = f"""
WITH RECURSIVE members AS (
  SELECT DISTINCT repository, split_part(repository, '/', 1) AS owner, split FROM (
    SELECT {_REPO.format(c="repository")} AS repository, {_SPLIT.format(c="split")} AS split FROM files
    UNION ALL SELECT {_REPO.format(c="repository")}, {_SPLIT.format(c="split")} FROM repos) WHERE repository <> ''),
 roots AS (SELECT DISTINCT split_part({_REPO.format(c="repo")}, '/', 1) AS owner, regexp_replace(trim(root, ' '), '/+$', '') AS root FROM staged_repos WHERE repo <> '' AND root <> ''),
 links AS (SELECT DISTINCT a.owner AS u, b.owner AS v FROM roots a JOIN roots b ON a.root = b.root WHERE a.owner <> b.owner),
 reach(u, v) AS (SELECT owner, owner FROM members UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
 groups AS (SELECT u AS owner, min(v) AS component FROM reach GROUP BY u),
 bad AS (SELECT component FROM members JOIN groups USING (owner) GROUP BY component HAVING count(DISTINCT split) > 1)
SELECT DISTINCT repository FROM members JOIN groups USING (owner) WHERE component IN (SELECT component FROM bad)
"""

P2 = f"""
WITH r AS (
  SELECT r.ord, {_SPLIT.format(c="f.split")} AS split, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w
  FROM (SELECT ord, text, {_LANGUAGE} AS language FROM records WHERE text IS NOT NULL) r JOIN files f ON r.ord = f.ord
  WHERE r.language IN ('python', 'javascript', 'typescript', 'go', 'rust', 'java', 'cpp', 'bash', 'sql')),
 k AS (SELECT ord, split = 'train' AS train, w FROM r WHERE split IN ('train', 'validation', 'test') AND len(w) >= 30),
 s AS (SELECT DISTINCT ord, train, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS h FROM (SELECT ord, train, w, unnest(range(1, len(w) - 3)) AS i FROM k)),
 n AS (SELECT ord, count(*) AS n FROM s GROUP BY ord),
 p AS (SELECT a.ord AS x, b.ord AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h WHERE a.train AND NOT b.train GROUP BY 1, 2)
SELECT least(x, y) AS ord_a, greatest(x, y) AS ord_b FROM p JOIN n a ON a.ord = x JOIN n b ON b.ord = y WHERE c >= 0.7 * (a.n + b.n - c)
"""

P9 = """
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
 v AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS v FROM eval_items WHERE text IS NOT NULL),
 ws AS (SELECT doc_id, i, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM w)),
 vs AS (SELECT item_id, j, array_to_string(v[j:j+5], ' ') AS g FROM (SELECT item_id, v, unnest(range(1, len(v) - 4)) AS j FROM v)),
 diagonal AS (SELECT DISTINCT doc_id, item_id, i - j AS d FROM ws JOIN vs ON ws.g = vs.g),
 same AS (SELECT doc_id, item_id, d, list_transform(range(greatest(1, 1 - d), least(len(v), len(w) - d) + 1), lambda j: CASE WHEN v[j] = w[j + d] THEN 1 ELSE 0 END) AS e FROM diagonal JOIN w USING (doc_id) JOIN v USING (item_id))
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, e, unnest(range(1, len(e) - 18)) AS i FROM same WHERE len(e) >= 20) WHERE list_sum(e[i:i+19]) >= 18
"""

ORACLES = {"p1_found": P1, "p2_found": P2, "p9_found": P9}
