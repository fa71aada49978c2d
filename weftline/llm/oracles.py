"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from weftline.llm.quality import SYMBOLS, Rules
from weftline.llm.queries import URL_RULES
from weftline.llm.urls import DAMPING, LINK, LOWER, MASS, ROUNDS, UPPER

_RULES = Rules()
_SPACES = r"[\x20\x09-\x0D]"

_BASE = rf"""
docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(v) AS word, unnest(range(1, len(v) + 1)) AS k
      FROM (SELECT r, list_filter(regexp_split_to_array(text, '{_SPACES}+'), lambda x: x <> '') AS v FROM docs)),
tri AS (SELECT r, k, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS t FROM w WINDOW o AS (PARTITION BY r ORDER BY k)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, t) AS n FROM tri WHERE t IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY r),
nw AS (SELECT r, count(*) AS n, sum(length(word)) AS c FROM w GROUP BY r),
li AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS d
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT docs.r, doc_id, lang, source, coalesce(nw.n, 0)::BIGINT AS n_words, coalesce(nw.c, 0)::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             coalesce(li.d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(li.n, 0)::BIGINT AS n_lines
      FROM docs LEFT JOIN nw USING (r) LEFT JOIN li USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.most_repeated_percent} * n_words AS base_failed,
             100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbol_rate,
             1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate FROM m)
"""

_SLACK = " ".join(f"WHEN '{name}' THEN {slack}" for name, slack, _ in _RULES.slack)
_SIDES = " OR ".join(f"(measure = '{n}' AND (v > high{' OR v < low' if both else ''}))" for n, _, both in _RULES.slack)

OP1 = rf"""
WITH {_BASE},
each AS (SELECT r, lang, source, base_failed, measure, v, 64 * greatest(length(bin(v)) - 7, 0) + (v >> greatest(length(bin(v)) - 7, 0)) AS bin
         FROM (SELECT r, lang, source, base_failed, unnest(['word_length', 'symbol_rate', 'dup_line_rate', 'repeat_rate']) AS measure,
                      unnest([word_length, symbol_rate, dup_line_rate, repeat_rate])::BIGINT AS v FROM b)),
sk AS (SELECT l AS level, CASE WHEN l < 2 THEN lang END AS lang, CASE WHEN l = 0 THEN source END AS source, measure, bin, count(*) AS n
       FROM each, (VALUES (0), (1), (2)) AS s(l) WHERE NOT base_failed GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sk),
q AS (SELECT level, lang, source, measure, max(total) AS n, min(CASE WHEN 100 * upto >= 20 * total THEN bin END) AS b20, min(CASE WHEN 100 * upto >= 50 * total THEN bin END) AS b50, min(CASE WHEN 100 * upto >= 80 * total THEN bin END) AS b80
      FROM run GROUP BY ALL),
qv AS (SELECT level, lang, source, measure, n, (b20 - 64 * greatest(b20 // 64 - 1, 0)) << greatest(b20 // 64 - 1, 0)::INT AS lower_, (b50 - 64 * greatest(b50 // 64 - 1, 0)) << greatest(b50 // 64 - 1, 0)::INT AS median, (b80 - 64 * greatest(b80 // 64 - 1, 0)) << greatest(b80 // 64 - 1, 0)::INT AS upper_ FROM q),
bo AS (SELECT level, lang, source, measure, n, median - reach AS low, median + reach AS high
       FROM (SELECT *, greatest({_RULES.spread} * (upper_ - lower_), CASE measure {_SLACK} END) AS reach FROM qv)),
pick AS (SELECT each.*, CASE WHEN g.n >= {_RULES.least_group} THEN 0 WHEN l.n >= {_RULES.least_group} THEN 1 ELSE 2 END AS lvl,
                g.low AS g_low, g.high AS g_high, l.low AS l_low, l.high AS l_high, e.low AS e_low, e.high AS e_high
         FROM each LEFT JOIN bo g ON g.level = 0 AND g.measure = each.measure AND g.lang IS NOT DISTINCT FROM each.lang AND g.source IS NOT DISTINCT FROM each.source
                   LEFT JOIN bo l ON l.level = 1 AND l.measure = each.measure AND l.lang IS NOT DISTINCT FROM each.lang
                   LEFT JOIN bo e ON e.level = 2 AND e.measure = each.measure WHERE NOT base_failed),
far AS (SELECT r FROM (SELECT r, measure, v, CASE lvl WHEN 0 THEN g_low WHEN 1 THEN l_low ELSE e_low END AS low, CASE lvl WHEN 0 THEN g_high WHEN 1 THEN l_high ELSE e_high END AS high FROM pick)
        WHERE {_SIDES})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM far) AS kept FROM b
"""

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>')"

OP9 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m AS (
  SELECT *, coalesce(lag(role) OVER w, '') AS state, lead(role) OVER w IS NULL AS is_last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
u AS (
  SELECT *, CASE WHEN CASE state WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE state IN ('system', 'assistant') AND role = 'user' END THEN 0 ELSE 1 END
    + CASE WHEN is_last AND role <> 'assistant' THEN 1 ELSE 0 END AS wrong FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       sum(wrong) = 0 AS valid, sum(wrong)::BIGINT AS violations
FROM u GROUP BY conv_id
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t)::BIGINT AS n, sha256(t) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON f.d = q.d
"""


def _op8() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    rounds, now = "", "seed"
    for k in range(ROUNDS):
        rounds += f"""
r{k} AS (SELECT kind, host, sum(base)::BIGINT + (sum(part)::BIGINT * {DAMPING}) // 100 AS score FROM (
      SELECT w.kind, w.dst AS host, 0::BIGINT AS base, r.score // w.n AS part FROM ways w JOIN {now} r ON r.kind = w.kind AND r.host = w.src
      UNION ALL SELECT kind, host, score * {100 - DAMPING} // 100, 0 FROM seed) GROUP BY 1, 2 HAVING score > 0),"""
        now = f"r{k}"
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT row_number() OVER () AS k, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(v, h, p) AS (VALUES {rules}),
ruled AS (SELECT named.*, r.h || r.p AS rule, r.v FROM named LEFT JOIN LATERAL (
      SELECT * FROM rules WHERE (named.host = h OR ends_with(named.host, '.' || h)) AND starts_with(named.path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) r ON true),
lean AS (SELECT CASE WHEN s > 0 THEN 'trust' ELSE 'distrust' END AS kind, host FROM (
      SELECT host, sum(CASE v WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END) AS s FROM ruled GROUP BY host) WHERE s <> 0 AND host <> ''),
seed AS (SELECT kind, host, {MASS} // count(*) OVER (PARTITION BY kind) AS score FROM lean),
hosts AS (SELECT DISTINCT host FROM named),
far AS (SELECT DISTINCT host AS src, translate(regexp_extract(substr(l, instr(l, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS dst
      FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)) AS l FROM named)),
up AS (SELECT a.host AS lo, b.host AS hi, row_number() OVER (PARTITION BY a.host ORDER BY length(b.host) DESC) AS k FROM hosts a JOIN hosts b ON ends_with(a.host, '.' || b.host) AND b.host <> ''),
edge AS (SELECT DISTINCT * FROM (SELECT src, dst FROM far SEMI JOIN hosts ON hosts.host = far.dst UNION ALL SELECT lo, hi FROM up WHERE k = 1 UNION ALL SELECT hi, lo FROM up WHERE k = 1) WHERE src <> dst),
ways AS (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS n FROM (SELECT 'trust' AS kind, src, dst FROM edge UNION ALL SELECT 'distrust', dst, src FROM edge)),{rounds}
bad AS (SELECT host FROM {now} GROUP BY host HAVING sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) > sum(CASE kind WHEN 'trust' THEN score ELSE 0 END))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


OP12 = rf"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
g AS (SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase
      FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS z(s))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS first_, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c),
s AS (SELECT k.lang, k.size, k.phrase, a, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score, k
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = first_ JOIN f y ON y.lang = k.lang AND y.phrase = rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM c, (VALUES (2), (3)) AS z(s) WHERE s < size)),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = low.lang AND o.phrase = low.phrase AND 100::HUGEINT * o.a >= 80::HUGEINT * low.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN total USING (lang) WHERE rank <= 2000
"""


ORACLES: dict[str, str] = {"op1_quality": OP1, "op6_warc": OP6, "op8_urls": _op8(), "op9_chat": OP9, "op12_phrases": OP12}
