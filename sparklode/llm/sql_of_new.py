"""SQL for DuckDB that says what the prefix trie, the URL filters and the vector codes return."""

from __future__ import annotations

from sparklode.llm import url_rules, vector_codes

#: CRC-32 of a decimal, a bit at a time; 3988292384 is its polynomial.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(c::VARCHAR)::BIGINT), lambda b: CASE WHEN b % 8 = 0 THEN ascii(substr(c::VARCHAR, b // 8 + 1, 1)) ELSE 0 END::BIGINT)),
 lambda s, x: CASE WHEN xor(s, x) % 2 = 1 THEN xor(xor(s, x) // 2, 3988292384) ELSE xor(s, x) // 2 END)"""

TRIE = f"""
WITH said AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, s, xor({_CRC}, 4294967295::BIGINT) % 9 AS h FROM said),
built AS (SELECT h.c, list_concat(list_slice(coalesce(b.s, []), 1, h.h), list_slice(h.s, h.h + 1, len(h.s))) AS s FROM h LEFT JOIN said b ON b.c = h.c - h.c % 5),
occ AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM built),
named AS (SELECT c, n, d, md5(list_slice(s, 1, d)::VARCHAR) AS k, md5(list_slice(s, 1, d - 1)::VARCHAR) AS up, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS b FROM occ),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS m, any_value(b) AS b, any_value(CASE WHEN d > 0 THEN up END) AS up,
                string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM named GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS children, p.conv_id AS parent_conv_id FROM node LEFT JOIN kids ON kids.up = node.k AND kids.d = node.d LEFT JOIN node p ON p.k = node.up AND p.d = node.d - 1),
below AS (SELECT DISTINCT a.k, a.d, z.k AS zk, z.d AS zd FROM named a JOIN named z ON a.c = z.c AND z.d >= a.d),
sums AS (SELECT below.k, below.d, count(*) FILTER (z.children = 0) AS leaves, sum((z.m - 1) * z.b) AS saved FROM below JOIN full_node z ON z.k = below.zk AND z.d = below.zd GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, m AS n_convs, children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_node JOIN sums USING (k, d)"""


def _fits(r: url_rules.Rule) -> str:
    return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"


def _case(value: str) -> str:
    ordered = sorted(url_rules.RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    return "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{getattr(r, value)}'" for r in ordered) + " END"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

URLS = rf"""
WITH cut AS (SELECT page_id, url, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
bag AS (
  SELECT DISTINCT url, list_sort(list_distinct(list_concat(
    CASE WHEN host = '' THEN [] ELSE ['tld:' || string_split(host, '.')[-1]] END,
    list_transform(list_filter(list_slice(string_split(host, '.'), 1, len(string_split(host, '.')) - 1), lambda x: x <> ''), lambda x: 'host:' || x),
    list_transform(list_filter(regexp_split_to_array(translate(path, {_AZ}), '[/._\-]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'path:#' ELSE 'path:' || x END),
    list_transform(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> ''), lambda x: 'query:' || string_split(x, '=')[1])))) AS t
  FROM split WHERE url IS NOT NULL),
marks AS (SELECT p.url, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 'block' ELSE 'allow' END AS label FROM pages p JOIN labels l ON l.doc_id = p.page_id),
usual AS (SELECT CASE WHEN 2 * count(*) FILTER (label = 'block') > count(*) THEN 'block' ELSE 'allow' END AS verdict FROM marks),
known AS (SELECT row_number() OVER () AS i, coalesce(t, []) AS t, label FROM marks LEFT JOIN bag USING (url) WHERE len(coalesce(t, [])) <= {url_rules.MOST_TOKENS}),
total AS (SELECT count(*) AS n FROM known),
sets AS (SELECT label, t, unnest(range(1, (1 << len(t))::BIGINT)) AS mask FROM known),
item AS (SELECT label, list_filter(t, lambda x, k: (mask >> (k - 1)) & 1 = 1) AS s FROM sets),
freq AS (SELECT s, label, count(*) AS n FROM item GROUP BY ALL),
every AS (SELECT s, label, n, sum(n) OVER (PARTITION BY s) AS m FROM freq),
rules AS (SELECT s, label, n::DOUBLE / m AS confidence, n::DOUBLE / (SELECT n FROM total) AS support FROM every
          WHERE n >= ceil({url_rules.MIN_SUPPORT}::DOUBLE * (SELECT n FROM total)) AND n >= {url_rules.MIN_ROWS} AND n::DOUBLE / m >= {url_rules.MIN_CONFIDENCE}),
part AS (SELECT s, label, confidence, unnest(list_transform(range(1, len(s) + 1), lambda k: list_concat(list_slice(s, 1, k - 1), list_slice(s, k + 1, len(s))))) AS p FROM rules),
weak AS (SELECT DISTINCT part.s, part.label FROM part JOIN rules r ON r.s = part.p AND r.label = part.label AND r.confidence >= part.confidence),
strong AS (SELECT * FROM rules ANTI JOIN weak USING (s, label)),
best AS (SELECT url, arg_max(label, struct_pack(a := confidence, b := support, c := len(s), d := label)) AS verdict FROM bag JOIN strong ON list_has_all(t, s) GROUP BY url)
SELECT page_id, host, path, {_case("text")} AS rule, coalesce({_case("verdict")}, best.verdict, usual.verdict) AS verdict, coalesce(best.verdict, usual.verdict) AS by_tokens
FROM split LEFT JOIN best USING (url) CROSS JOIN usual"""


def _codes() -> str:
    n, e, r = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    steps = [
        f"""kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(embedding)) // {n} AS w FROM kept),
comp AS (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS j, floor({vector_codes.SCALE} * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, embedding, w, unnest(range(1, n + 1)) AS i FROM (SELECT *, len(embedding) AS n FROM kept, w))),
b0 AS (SELECT part, entry, j, x FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {e})) USING (vec_id))"""
    ]
    for k in range(r + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, q) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, d, d * {e} + entry AS q FROM (SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN b{k} b ON b.part = c.part AND b.j = c.j GROUP BY ALL)) GROUP BY ALL)")
        if k < r:
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.j, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT a.part, a.entry, c.j, ((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{k} a JOIN comp c USING (vec_id, part) GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry AND m.j = b.j)")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{r} GROUP BY vec_id)")
    steps.append(f"mark AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b{r})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id) CROSS JOIN mark"


SQL = {"op11_prefix_trie": TRIE.strip(), "op12_url_rules": URLS.strip(), "op13_annular_codes": _codes()}
