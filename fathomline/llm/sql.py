"""SQL (DuckDB) with the results of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 80 * (len(sa.s) + len(sb.s) - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""

_SHARE = "{0}[i] / list_sum({0})::DOUBLE"


def _distance(p: str, q: str) -> str:
    a, b = _SHARE.format(p), _SHARE.format(q)
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
    return f"round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(a)} + {part(b)}) / 2)))), 6)"


QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, lang, t, {_WORDS.format("t")} AS w FROM d),
n AS MATERIALIZED (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM w) GROUP BY ALL),
top AS MATERIALIZED (SELECT lang, list(word ORDER BY rank) AS common, list(n ORDER BY rank) AS ns FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 24 GROUP BY lang),
total AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS MATERIALIZED (SELECT w.doc_id, w.lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) AS n_all, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper_, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit, length(regexp_replace(t, '[^.,;:!?''"()\[\]{{}}/\\_\-]+', '', 'g')) AS mark,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, list_transform(top.common, lambda c: len(list_filter(w, lambda x: x = c))) AS hits, list_append(top.ns, total.total - list_sum(top.ns)) AS common_ref
    FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN top ON top.lang IS NOT DISTINCT FROM w.lang LEFT JOIN total ON total.lang IS NOT DISTINCT FROM w.lang),
h AS MATERIALIZED (SELECT *, [n_all - word_chars, n_symbols, upper_, digit, mark, word_chars - n_symbols - upper_ - digit - mark] AS classes, list_append(hits, n_words - list_sum(hits)) AS common FROM m),
r AS (SELECT lang, sum(n_words) AS ref_words, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6])] AS class_ref FROM h GROUP BY lang),
j AS (SELECT h.*, r.ref_words, CASE WHEN list_sum(classes) > 0 THEN {_distance("classes", "class_ref")} END AS class_distance, CASE WHEN list_sum(common) > 0 THEN {_distance("common", "common_ref")} END AS word_distance,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h LEFT JOIN r ON r.lang IS NOT DISTINCT FROM h.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed,
    NOT base_failed AND (ref_words < 2000 OR NOT coalesce(class_distance > 0.25 OR word_distance > 0.45, false)) AS kept FROM j
"""

REPEATS = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM w, unnest(range(1, len(w) - 33)) u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + o AS j FROM rep CROSS JOIN range(35) v(o)),
x AS (SELECT w.doc_id, u.i, w.w[u.i] AS word FROM w, unnest(range(1, len(w) + 1)) u(i)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.j = x.i WHERE gone.j IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

#: The 256 remainders of a byte, and the checksum of the text s by them.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t"
_CRC = "xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"



def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _beside(own: str) -> str:
    """Digests of the nodes k of a run before and after the one that covers this rank."""
    part = "coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (k.idx {0} {1} // k.width), '')"
    return part.format("<", own) + " AS before, " + part.format(">", own) + " AS after"


_UP = "idx // 3, (n + 2) // 3, width * 3, sha256(string_agg(digest, '' ORDER BY idx))"

MANIFEST = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
doc AS (SELECT doc_id, source, lang, n_chars, text, doc_id::VARCHAR AS s, t FROM documents, tab),
tampered AS (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM doc),
made AS (SELECT doc_id, coalesce('=' || source, '-') AS part, {_leaf("text")} AS leaf, {_leaf("other")} AS claim FROM tampered),
leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM made),
node AS (SELECT part, idx, n, 1::BIGINT AS width, leaf AS digest FROM leaf UNION ALL SELECT part, {_UP} FROM node WHERE n > 1 GROUP BY part, idx // 3, n, width),
kept AS MATERIALIZED (SELECT * FROM node),
sub AS MATERIALIZED (SELECT part, digest, row_number() OVER (ORDER BY part) - 1 AS idx, count(*) OVER () AS n FROM kept WHERE n = 1),
over_ AS (SELECT idx, n, 1::BIGINT AS width, digest FROM sub UNION ALL SELECT {_UP} FROM over_ WHERE n > 1 GROUP BY idx // 3, n, width),
top AS MATERIALIZED (SELECT * FROM over_),
above AS MATERIALIZED (SELECT o.part, k.width, {_beside("o.idx")} FROM sub o JOIN top k ON k.n > 1 AND k.idx // 3 = o.idx // (k.width * 3) GROUP BY o.part, o.idx, k.width),
beside AS (SELECT l.part, l.idx, k.width, {_beside("l.idx")} FROM leaf l JOIN kept k ON k.part = l.part AND k.n > 1 AND k.idx // 3 = l.idx // (k.width * 3) GROUP BY l.part, l.idx, k.width),
step AS (SELECT part, idx, 0 AS tree, width, before, after FROM beside UNION ALL SELECT part, l.idx, 1, a.width, a.before, a.after FROM leaf l JOIN above a USING (part)),
way AS (SELECT part, idx, list(before || '|' || after ORDER BY tree, width) AS steps, string_agg(before || after, '' ORDER BY tree, width) AS proof FROM step GROUP BY part, idx),
done AS (SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([claim] || coalesce(steps, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
    FROM leaf JOIN sub USING (part) LEFT JOIN way ON way.part = leaf.part AND way.idx = leaf.idx)
SELECT *, folded_root = root AS verified FROM done
"""

_MUST_GO = "fault IN ('b', 'd')"


def _before(state: int, kept: str) -> str:
    """Least cost before a turn in this state, without insertions: delete, keep (initials with their next states), change."""
    to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    keeps = "".join(f", CASE WHEN NOT {_MUST_GO} AND initial = '{c}' THEN extra + v[{n + 1}] END" for c, n in zip(kept[::2], map(int, kept[1::2])))
    return f"least(4 + v[{state + 1}], CASE WHEN NOT {_MUST_GO} THEN 3 + extra + v[{to + 1}] END{keeps})"


REPAIR = rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s, t FROM conversations, tab),
kind AS MATERIALIZED (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM given),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kind, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_replace(text, '[ 	-
]+', '', 'g') AS bare FROM damaged),
faulty AS (SELECT *, role[1] AS initial, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
r AS MATERIALIZED (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS extra FROM faulty),
size AS MATERIALIZED (SELECT c.conv_id, count(r.i) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
cost AS (SELECT conv_id, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM size
    UNION ALL SELECT conv_id, i, [least(u[1], 3 + u[3], 6 + u[4]), least(u[2], 3 + u[3], 6 + u[4]), least(u[3], 3 + u[4]), least(u[4], 3 + u[3])]
    FROM (SELECT c.conv_id, r.i, [{_before(0, "s1u2")}, {_before(1, "u2")}, {_before(2, "a3")}, {_before(3, "u2")}]::BIGINT[] AS u FROM cost c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i - 1)),
costs AS MATERIALIZED (SELECT * FROM cost),
walk AS (SELECT conv_id, 1::BIGINT AS i, 0 AS state, '' AS audit, []::VARCHAR[] AS said FROM size
    UNION ALL SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN state WHEN 'K' THEN keep ELSE to_ END, audit || edit,
        CASE edit WHEN 'D' THEN said WHEN 'K' THEN said || [role || ':' || text] ELSE said || [CASE to_ WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END] END
    FROM (SELECT *, CASE WHEN 4 + after[state + 1] = here[state + 1] THEN 'D' WHEN 3 + here[to_ + 1] = here[state + 1] THEN 'I' WHEN NOT {_MUST_GO} AND extra + after[keep + 1] = here[state + 1] THEN 'K' ELSE 'R' END AS edit
        FROM (SELECT w.*, a.v AS here, b.v AS after, r.role, r.text, r.extra, r.fault, CASE w.state WHEN 2 THEN 3 ELSE 2 END AS to_,
            CASE w.state::VARCHAR || r.initial WHEN '0s' THEN 1 WHEN '0u' THEN 2 WHEN '1u' THEN 2 WHEN '2a' THEN 3 WHEN '3u' THEN 2 END AS keep
            FROM walk w JOIN costs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
            WHERE b.conv_id IS NOT NULL OR b.i IS NOT NULL OR w.state IN (1, 2)))),
done AS (SELECT w.conv_id, audit, said FROM walk w JOIN size z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = z.n + 1 AND w.state IN (0, 3))
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, v[1] AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM size z JOIN done d ON d.conv_id IS NOT DISTINCT FROM z.conv_id JOIN costs c ON c.conv_id IS NOT DISTINCT FROM z.conv_id AND c.i = 1
"""
