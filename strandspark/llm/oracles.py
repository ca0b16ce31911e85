"""DuckDB SQL for the training-data operators that SQL can express."""

from __future__ import annotations

from .quality_rules import DELTA, RISK, RULES

WORD = r"[^\x20\x09-\x0D]+"


def _quality_rules() -> str:
    """The ratios as in Spark, a long table of the tests, log-gamma for the binomial tail."""
    n_grid = sum(len(grid) for _, grid in RULES.values())
    ratio = ", ".join(f"coalesce(({a})::double / nullif({b}, 0), 0) AS r_{rule}" for rule, (of, _) in RULES.items() for a, b in [of.split(" / ")])
    grid = ", ".join(f"('{rule}', {float(cut)}::double)" for rule, (_, cuts) in RULES.items() for cut in cuts)
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN r_{rule}" for rule in RULES) + " END"
    p = RISK / len(RULES)
    log_pmf = f"lgamma(n_good + 1.0) - lgamma(j + 1.0) - lgamma(n_good - j + 1.0) + j * ln({p}) + (n_good - j) * ln(1 - {p})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
tri AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(lines)::bigint AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
    coalesce(n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
c AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {ratio} FROM f),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
l AS (SELECT c.*, quality FROM c JOIN q ON c.doc_id = q.doc_id WHERE NOT base_failed),
n AS (SELECT lang, sum(quality)::bigint AS n_good FROM l GROUP BY lang),
g(rule, cutoff) AS (VALUES {grid}),
t0 AS (SELECT lang, rule, cutoff, count(*) FILTER (quality = 1 AND {value} > cutoff) AS lost, count(*) FILTER (quality = 0 AND {value} > cutoff) AS caught FROM l, g GROUP BY ALL),
t1 AS (SELECT t0.*, n_good FROM t0 JOIN n ON t0.lang IS NOT DISTINCT FROM n.lang),
terms AS (SELECT *, unnest(range(0, lost + 1)) AS j FROM t1 WHERE caught > 0 AND lost < n_good * {p}),
ok AS (SELECT lang, rule, cutoff, caught FROM terms GROUP BY ALL HAVING sum(exp({log_pmf})) <= {DELTA} / (SELECT count(*) * {n_grid} FROM n)),
best AS (SELECT lang, rule, cutoff FROM ok QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.lang IS NOT DISTINCT FROM c.lang AND {value} > cutoff) AS kept
FROM c"""


#: The first of equal payloads is a minimum over the digest's group.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n::bigint AS payload_bytes, digest AS payload_digest,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""

#: Every window as its joined words; a word goes if a marked window starts at most 49 words before.
SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
marks AS (SELECT r, list(i) AS m FROM (SELECT r, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id) GROUP BY r),
words AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
covered AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(m) AS i FROM marks), LATERAL (SELECT unnest(range(i, i + 50)) AS j)),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.j) AS t, count(*) AS n FROM words w ANTI JOIN covered c ON w.r = c.r AND w.j = c.j GROUP BY w.r)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint AS score FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def _centroids(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """A CTE for each assignment and each move of the centroids; all sums are whole numbers below 2^53."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT r, id, e, number, away FROM (SELECT p.r, p.id, p.e, c.number,
    list_sum(list_transform(range(1, {width + 1}), lambda i: (p.e[i] - c.e[i]) * (p.e[i] - c.e[i]))) AS away FROM p, c{r} c)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY away, number) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (SELECT number, coalesce(m.e, c{r}.e) AS e FROM c{r} LEFT JOIN (SELECT number, list(v ORDER BY i) AS e FROM
    (SELECT number, i, floor(sum(e[i]) / count(*)) AS v FROM (SELECT number, e, unnest(range(1, {width + 1})) AS i FROM a{r}) GROUP BY number, i) GROUP BY number) m USING (number))""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (FROM v), c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || id) NULLS LAST) - 1 AS number, e FROM p QUALIFY number < {k}),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT id AS vec_id, number::int AS cluster, away::bigint AS distance, (sum(away) OVER (PARTITION BY number))::bigint AS cluster_inertia, (sum(away) OVER ())::bigint AS inertia,
    sha256(array_to_string(list_transform(c{rounds}.e, lambda x: (x::bigint)::varchar), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (number)"""


ORACLE_SQL: dict[str, str] = {
    "op2_cover_tree": TOP_K,
    "op9_substring_dedup": SUBSTRING,
    "op5_warc": WARC,
    "op6_quality_rules": _quality_rules(),
    "op11_centroids": _centroids(),
}
