"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

NEAR_DUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(2, len(w)) - 1), ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(2, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY 1) USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
dw AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
h AS (SELECT doc_id, s, m, item_id FROM dw JOIN iw USING (m, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_SPACE} AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + 50), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1)),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
x AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY doc_id, span)
SELECT doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM x JOIN d USING (doc_id) GROUP BY doc_id
"""


def centroids(clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Every centroid is tried on every vector, in each round."""
    away = "CAST(list_sum(list_transform(range(1, {dim} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT)".format(dim=dim)
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, v, best.k AS k, best.d AS d FROM (SELECT vec_id, any_value(v) AS v, min({{'d': {away}, 'k': c.k}}) AS best FROM x, c{k} c GROUP BY vec_id))")
        if k < rounds:
            mean = f"SELECT k, list(s ORDER BY i) AS m FROM (SELECT k, i, CAST(floor_div(sum(v[i]), count(*)) AS BIGINT) AS s FROM a{k}, range(1, {dim} + 1) t(i) GROUP BY k, i) GROUP BY k"
            mean = mean.replace("floor_div(sum(v[i]), count(*))", "(sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.k AS k, coalesce(n.m, c.m) AS m FROM c{k} c LEFT JOIN ({mean}) n ON n.k = c.k)")
    steps = ",\n".join(steps)
    return f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS m FROM x QUALIFY k < {clusters}),
{steps}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k
"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: Every group is met with every term of its lang, whether it occurs there or not.
DIVERGENCE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS terms FROM documents),
t AS MATERIALIZED (SELECT lang, source, id, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS MATERIALIZED (SELECT lang, source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, source) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(x), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source AS s, o.source AS o, ((s.p - o.p) * (s.p - o.p)) // o.p AS x FROM p s JOIN p o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source) y ON y.lang = a.lang AND y.s = a.source AND y.o = b.source
  GROUP BY 1, 2, 3)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
UNION ALL
SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) AS INTEGER) AS rank FROM p WHERE n > 0 AND p > q QUALIFY rank <= 200
"""


def _rule(of: dict[str, str]) -> str:
    out = "NULL"
    for rule in sorted(sorted(of, reverse=True), key=len):
        host, _, path = rule.partition("/")
        out = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}' ELSE {out} END"
    return out


def url_filter(rules: dict[str, str], levels: int = 16) -> str:
    """The same tree, one level after the other, with paths written out where the operator has digests; the tables' paths have four levels."""
    block = ", ".join(f"'{r}'" for r, v in rules.items() if v == "block")
    tree = ",\n".join(
        f"""c{k} AS MATERIALIZED (SELECT host, names, segs[{k + 1}] AS child, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM s{k} WHERE len(segs) > {k} GROUP BY 1, 2, 3),
t{k} AS (SELECT host, names, count(*) AS kinds, sum(n) AS an, sum(l) AS al, sum(b) AS ab FROM c{k} GROUP BY 1, 2 HAVING count(*) > 1),
w{k} AS (SELECT host, names, child FROM c{k} JOIN t{k} USING (host, names) WHERE child <> '' AND ((kinds > 20 AND an < 5.0 * kinds AND n < 5.0) OR (l > 0 AND al > 0 AND abs(b / l - ab / al) <= 2.0 * sqrt((ab / al) * (1 - ab / al) / l)))),
s{k + 1} AS MATERIALIZED (SELECT s.host, s.segs, s.n, s.l, s.b, CASE WHEN len(segs) > {k} THEN list_append(s.names, CASE WHEN w.child IS NULL THEN segs[{k + 1}] ELSE '*' END) ELSE s.names END AS names FROM s{k} s LEFT JOIN w{k} w ON w.host = s.host AND w.names = s.names AND w.child = s.segs[{k + 1}])"""
        for k in range(levels)
    )
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {_rule(rules)} AS rule FROM u),
p AS (SELECT *, list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-f]{{8,}}$') AND regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '^[0-9]+$') THEN '{{x}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS segs, rule IN ({block}) AS blocked FROM r),
s0 AS MATERIALIZED (SELECT host, segs, count(*) AS n, count(rule) AS l, count(*) FILTER (blocked) AS b, CAST([] AS VARCHAR[]) AS names FROM p GROUP BY 1, 2),
{tree},
te AS (SELECT host, segs, l, b, array_to_string(list_concat(names, segs[{levels + 1}:]), '/') AS template FROM s{levels}),
pu AS (SELECT host, template, (sum(b) + 1.0) / (sum(l) + 4.0) AS purity FROM te GROUP BY 1, 2)
SELECT page_id, p.host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN blocked THEN 'block' ELSE 'allow' END WHEN purity >= 0.6 THEN 'block' ELSE 'allow' END AS verdict, te.template, CAST(purity AS DOUBLE) AS purity
FROM p JOIN te ON te.host = p.host AND te.segs = p.segs JOIN pu ON pu.host = te.host AND pu.template = te.template
"""
