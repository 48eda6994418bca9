"""DuckDB SQL that gives the rows of the queries which SQL can express, written from their definitions."""

from __future__ import annotations

from .chat import CONTROLS
from .licenses import HINTS, TEMPLATES, TOKEN
from .url_filters import DAMPING, DIGITS, RULES

_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_filters(rounds: int = 42) -> str:
    """Enough rounds for more digits than are compared: DAMPING ** rounds < 1e-12."""
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    steps = [
        "r AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)",
        f"p AS (SELECT page_id, html, {_LOWER_AZ.format("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)",
        f"q AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS rv FROM p)",
        "h AS (SELECT host, avg(CASE WHEN rv = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN rv = 'block' THEN 1.0 ELSE 0.0 END) AS d FROM q WHERE host <> '' GROUP BY 1)",
        f"l AS (SELECT src, {_LOWER_AZ.format('dst')} AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*[\"'']?(?:[a-z]+:)?//([^/?#\"''\\s<>]+)', 1)) AS dst FROM p WHERE host <> ''))",
        "a AS (SELECT string_split(host, '.') AS w FROM (SELECT host FROM h UNION SELECT dst FROM l))",
        "s AS (SELECT DISTINCT array_to_string(w[i:], '.') AS src, array_to_string(w[i + 1:], '.') AS dst FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) > 2))",
        "e AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT * FROM l UNION ALL SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s) WHERE src <> dst GROUP BY 1, 2)",
        "f AS MATERIALIZED (SELECT src AS host, dst AS nxt, 't' AS k, w / sum(w) OVER (PARTITION BY src) AS share FROM e UNION ALL SELECT dst, src, 'd', w / sum(w) OVER (PARTITION BY dst) FROM e)",
        "z AS MATERIALIZED (SELECT host, 't' AS k, t / (SELECT sum(t) FROM h) AS x FROM h WHERE t > 0 UNION ALL SELECT host, 'd', d / (SELECT sum(d) FROM h) FROM h WHERE d > 0)",
        "x0 AS (SELECT host, k, x FROM z)",
    ]
    for i in range(rounds):
        steps.append(f"x{i + 1} AS MATERIALIZED (SELECT host, k, sum(x) AS x FROM (SELECT f.nxt AS host, f.k, x * share * {DAMPING} AS x FROM x{i} JOIN f USING (host, k) UNION ALL SELECT host, k, x FROM z) GROUP BY 1, 2)")
    part = lambda k: f"round(coalesce(sum(CASE WHEN k = '{k}' THEN x END) / (SELECT sum(x) FROM x{rounds} WHERE k = '{k}'), 0), {DIGITS})"
    steps.append(f"v AS (SELECT host, {part('t')} AS t, {part('d')} AS d FROM x{rounds} GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT page_id, q.host, path, rule, coalesce(rv, CASE WHEN d > t THEN 'block' WHEN d IS NOT NULL THEN 'allow' END, 'allow') AS verdict, coalesce(t, 0) AS trust, coalesce(d, 0) AS distrust FROM q LEFT JOIN v ON v.host = q.host"


def licenses(header_least: float = 0.8, file_least: float = 0.6) -> str:
    hinted = lambda c: "(" + " OR ".join(f"contains({c}, {_quoted(h)})" for h in HINTS) + ")"
    templates = ", ".join(f"({_quoted(n)}, {_quoted(t.lower())})" for n, t in TEMPLATES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, 'none') || '/' || CAST(doc_id // 10000 AS VARCHAR) || '/' || CAST(doc_id // 1000 AS VARCHAR) || '/' AS dir, lower(coalesce(text, '')) AS text FROM documents),
    sp AS (SELECT * FROM d WHERE {hinted("text")}),
    pl AS (SELECT doc_id, dir, st, false AS whole FROM (SELECT doc_id, dir, unnest(string_split(text, chr(10))) AS st FROM sp) WHERE {hinted("st")}),
    pw AS (SELECT doc_id, dir, text AS st, true AS whole FROM sp),
    ln AS (SELECT st, count(*) AS n FROM pl GROUP BY 1),
    tp AS (SELECT * FROM (VALUES {templates}) t(licence, st)),
    tok AS (SELECT st, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT st, unnest(regexp_extract_all(st, '{TOKEN}')) AS term FROM (SELECT st FROM ln UNION SELECT st FROM pw)) GROUP BY 1, 2),
    tt AS (SELECT licence, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT licence, unnest(regexp_extract_all(st, '{TOKEN}')) AS term FROM tp) GROUP BY 1, 2),
    al AS (SELECT (SELECT coalesce(sum(n), 0) FROM ln) + {len(TEMPLATES)} AS n_all),
    df AS (SELECT term, sum(n) AS df FROM (SELECT term, n FROM tok JOIN ln USING (st) UNION ALL SELECT term, 1 FROM tt) GROUP BY 1),
    w AS (SELECT st, term, tf * ln(1 + CAST(n_all AS DOUBLE) / coalesce(df, 1)) AS w FROM tok LEFT JOIN df USING (term), al),
    v AS (SELECT licence, term, tf * ln(1 + CAST(n_all AS DOUBLE) / df) AS v FROM tt JOIN df USING (term), al),
    c AS (SELECT st, licence, round(sum(w * v) / any_value(nw) / any_value(nv), 6) AS cosine FROM w JOIN v USING (term) JOIN (SELECT st, sqrt(sum(w * w)) AS nw FROM w GROUP BY 1) USING (st) JOIN (SELECT licence, sqrt(sum(v * v)) AS nv FROM v GROUP BY 1) USING (licence) GROUP BY 1, 2),
    b AS (SELECT st, licence, cosine FROM c QUALIFY row_number() OVER (PARTITION BY st ORDER BY cosine DESC, licence) = 1),
    t AS (SELECT * FROM (SELECT * FROM pl UNION ALL SELECT * FROM pw) JOIN b USING (st)),
    cs AS (SELECT doc_id, max(cosine) AS cosine FROM t WHERE NOT whole GROUP BY 1),
    own AS (SELECT doc_id, licence FROM t WHERE NOT whole AND cosine >= {header_least} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
    fl AS (SELECT doc_id, dir, licence, cosine FROM t WHERE whole AND cosine >= {file_least}),
    cov AS (SELECT dir, licence FROM fl QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
    near AS (SELECT x.dir, cov.dir AS from_dir, cov.licence FROM (SELECT DISTINCT dir FROM d) x JOIN cov ON starts_with(x.dir, cov.dir) QUALIFY row_number() OVER (PARTITION BY x.dir ORDER BY length(cov.dir) DESC) = 1)
    SELECT d.doc_id, d.dir || CAST(d.doc_id AS VARCHAR) AS path, own.licence, cs.cosine, fl.doc_id IS NOT NULL AS is_file, CASE WHEN own.licence IS NULL THEN near.licence END AS inherited, CASE WHEN own.licence IS NULL THEN near.from_dir END AS from_dir
    FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN cs ON cs.doc_id = d.doc_id LEFT JOIN fl ON fl.doc_id = d.doc_id LEFT JOIN near ON near.dir = d.dir
    """


NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER_AZ.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i + 2], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 90 * (p.n + q.n - x)),
c(v, m) USING KEY (v) AS (
  SELECT doc_id AS v, doc_id AS m FROM documents
  UNION
  SELECT e.b, min(c.m) FROM c JOIN e ON e.a = c.v JOIN recurring.c r ON r.v = e.b WHERE c.m < r.m GROUP BY e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""

SUBSTRING_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, s, substr(h, s * 2 + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS s FROM b)),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g) WHERE k > 1),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM m)),
r AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM r),
a AS (SELECT k.doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(h, was * 2 + 1, (lo - was) * 2), '' ORDER BY lo) AS kept FROM k JOIN b USING (doc_id) GROUP BY 1)
SELECT b.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, coalesce(last, 0) * 2 + 1))) AS kept_sha256
FROM b LEFT JOIN a USING (doc_id)
"""


def chat() -> str:
    controls = "|".join("".join(f"\\{c}" if c in "|[]<>/" else c for c in s) for s in CONTROLS).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")
    size = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{controls}'))"
    said = _quoted("</s>[INST] ok [/INST]")
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said}))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
      CAST(sum({len("<|im_start|>") + 1 + len("<|im_end|>") + 1} + {size("role")} + length(role) - length(replace(role, chr(10), '')) + {size("text")}) AS BIGINT) AS formatted_chars
    FROM c GROUP BY 1
    """
