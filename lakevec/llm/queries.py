"""Queries of the numbered operators over the whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from lakevec.llm.bpe import op4_bpe
from lakevec.llm.decontam import op1_decontam
from lakevec.llm.divergence import op11_divergence
from lakevec.llm.langid import op7_langid
from lakevec.llm.merkle import op13_merkle
from lakevec.llm.mpeg import op3_mpeg
from lakevec.llm.packing import op12_packing
from lakevec.llm.pages import op8_html
from lakevec.llm.planes import op5_planes
from lakevec.llm.quality import op6_quality
from lakevec.llm.simhash import op2_simhash
from lakevec.llm.substring import op9_substring_dedup
from lakevec.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_decontam": op1_decontam,
    "op2_simhash": op2_simhash,
    "op3_mpeg": op3_mpeg,
    "op4_bpe": op4_bpe,
    "op5_planes": op5_planes,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_html": op8_html,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_packing": op12_packing,
    "op13_merkle": op13_merkle,
}

#: Windows of 35 words that start anywhere else too, and the words they cover, by plain grouping.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(list_transform(range(1, len(ws) - 33), lambda p: md5(array_to_string(ws[p:p+34], ' ')))) AS h, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM w SEMI JOIN again USING (h)),
words AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

#: What is left of the body without its menu, advert, footer and comments, by regular expressions, for pages whose other
#: markup is h1, p, b, br and one container, and whose only references are &amp; and &quot;, as in the test tables.
OP8_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<body>(.*)', 1, 's'), '<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*|<!--.*?-->', '', 'gs') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>'),
  lambda t: trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda t: t <> ''), ' ') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

#: Counts by plain grouping; shares of every kept term in every group, and their differences by a self-join.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * v) AS p
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.f), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def _op13_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels leaves: each level by grouping, siblings by windows, proofs and folding along the joined levels."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(({0})::VARCHAR) || ':' || ({0}) END".format
    first = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bits}), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"d AS (SELECT doc_id, source, sha256({first} || {field('text')}) AS leaf, sha256({first} || {field(f'CASE WHEN {crc} % 5 = 0 THEN {low} ELSE text END')}) AS altered FROM documents)"]

    def tree(name: str, leaves: str) -> str:
        parts.append(f"{name}0 AS ({leaves})")
        for k in range(levels):
            run = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN {} AND {})".format
            before, after = run("UNBOUNDED PRECEDING", "1 PRECEDING"), run("1 FOLLOWING", "UNBOUNDED FOLLOWING")
            parts.append(f"{name}s{k} AS (SELECT tree, i, size, coalesce(string_agg(h, '') {before}, '') AS b{k}, coalesce(string_agg(h, '') {after}, '') AS a{k} FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (any_value(size) + 15) // 16 AS size, CASE WHEN any_value(size) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY tree, i // 16)")
        return " ".join(f"JOIN (SELECT tree AS t{name}{k}, i AS i{name}{k}, size AS size{name}{k}, b{k} AS b{name}{k}, a{k} AS a{name}{k} FROM {name}s{k}) ON t{name}{k} IS NOT DISTINCT FROM {name}0.tree AND i{name}{k} = {name}0.i // {16**k}" for k in range(levels))

    documents = tree("n", "SELECT source AS tree, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS size, leaf AS h, doc_id, altered FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)")
    sources = tree("m", f"SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, count(*) OVER () AS size, h, tree AS source FROM n{levels}")
    steps = [f"{n}{k}" for n in "nm" for k in range(levels)]
    parts.append(f"p AS (SELECT n0.doc_id, n0.h AS leaf, m0.h AS subroot, m{levels}.h AS root, altered AS f, {', '.join(f'b{s}, a{s}, size{s}' for s in steps)} FROM n0 {documents} JOIN m0 ON m0.source IS NOT DISTINCT FROM n0.tree {sources}, m{levels})")
    for number, s in enumerate(steps):
        parts.append(f"f{number} AS (SELECT * REPLACE (CASE WHEN size{s} = 1 THEN f ELSE sha256(b{s} || f || a{s}) END AS f) FROM {f'f{number - 1}' if number else 'p'})")
    siblings = " || ".join(f"b{s} || a{s}" for s in steps)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps) - 1}"


ORACLE_SQL: dict[str, str] = {"op8_html": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_divergence": OP11_SQL, "op13_merkle": _op13_sql()}
