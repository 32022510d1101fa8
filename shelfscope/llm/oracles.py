"""SQL for DuckDB that gives the rows of the queries SQL can express."""

from __future__ import annotations

from shelfscope.llm import conversations, decontaminate, hard_negatives, license_scan, mixing, pii, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def license_sql() -> str:
    longest = max(len(t.split()) for t, _ in license_scan.TEMPLATES)
    phrases = ", ".join(f"({_list(p.split())}, {_text(label)})" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({_list(sorted(set(t.split())))}, {_text(label)})" for t, label in license_scan.TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{license_scan.SEPARATORS}'), lambda w: w <> '') AS ws
  FROM documents),
phrase(p, label) AS (VALUES {phrases}),
template(t, label) AS (VALUES {templates}),
place AS (SELECT r, label, unnest(list_filter(range(0, greatest(len(ws) - len(p) + 1, 0)), lambda i: ws[i + 1 : i + len(p)] = p)) AS pos FROM d, phrase),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM place GROUP BY r),
block AS (SELECT r, b, list_distinct(ws[b * {longest} + 1 : b * {longest} + 2 * {longest}]) AS own
  FROM (SELECT r, ws, unnest(range(0, greatest((len(ws) - 1) // {longest} - 1, 0) + 1)) AS b FROM d)),
met AS (SELECT r, b, label, len(list_intersect(own, t)) AS n, len(t) AS size FROM block, template),
more AS (SELECT r, max(n / size) AS share, list(DISTINCT label) AS labels, count(DISTINCT b) AS n_blocks
  FROM met WHERE n >= ceil({license_scan.CONTAINMENT} * size - 1e-9) GROUP BY r)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


def _matches(name: str, source: str, kind: str, pattern: str, group: int) -> str:
    """(r, kind, start, stop, whole, value) of all matches, places from running lengths of the pieces between them."""
    return rf"""{name} AS (SELECT r, '{kind}' AS kind, start + g AS start, start + g + length(whole) AS stop, whole, value FROM (
  SELECT r, whole, value, length(gap) AS g, coalesce(sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT r, unnest(range(0, len(wholes))) AS i, unnest(wholes) AS whole, unnest(vals) AS value, unnest(gaps[1 : len(wholes)]) AS gap
    FROM (SELECT r, regexp_extract_all(text, {_text(pattern)}) AS wholes, regexp_extract_all(text, {_text(pattern)}, {group}) AS vals,
      regexp_split_to_array(text, {_text(pattern)}) AS gaps FROM {source}))))"""


def secrets_sql() -> str:
    kinds = secret_scan.BASE | secret_scan.FORMS | {"opaque": secret_scan.OPAQUE}
    found = ",\n".join(_matches(f"m_{k}", "d", k, pattern, group) for k, (pattern, group, _) in kinds.items())
    mixed = "regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 10"
    accepted = " UNION ALL ".join(f"SELECT * FROM m_{k} WHERE length(value) >= {least}" + (f" AND {mixed}" if k == "opaque" else "") for k, (_, _, least) in kinds.items())
    place = f"list_position({_list(secret_scan.ORDER)}, kind)"
    listed = f"string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, {place})"
    base = f"kind IN ({', '.join(map(_text, secret_scan.BASE))})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
{found},
accepted AS ({accepted}),
apart AS (SELECT * FROM accepted o WHERE kind <> 'opaque' OR NOT EXISTS (
  SELECT 1 FROM accepted b WHERE b.r = o.r AND b.kind <> 'opaque' AND b.start < o.stop AND o.start < b.stop)),
owned AS (SELECT value, count(DISTINCT (doc_id, source)) AS repos, count(DISTINCT coalesce(source, chr(1))) AS owners FROM apart JOIN d USING (r) GROUP BY value),
judged AS (SELECT apart.*, owners < {secret_scan.EXAMPLE_OWNERS} AS live, owners FROM apart JOIN owned USING (value)),
spans AS (SELECT * FROM judged WHERE kind <> 'opaque' OR (live AND owners = 1)),
per AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)},
  {listed} FILTER ({base}) AS base, {listed} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (r)"""


def pii_sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": "[A-Z]{2}[0-9]{2}[A-Za-z0-9_]*",
    }
    found = ",\n".join(_matches(f"m_{k}", "d", k, p, 0) for k, p in patterns.items())
    digits = "regexp_replace(whole, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + 10 * ((i - 1) % 2) + cast(substr({digits}, -i, 1) AS INTEGER)])) % 10 = 0"
    bare = "replace(whole, ' ', '')"
    moved = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    number = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE cast(ascii(c) - 55 AS VARCHAR) END), '')"
    mod = f"list_reduce(list_transform(string_split({number}, ''), lambda c: cast(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1"
    tests = {
        "email": "true",
        "ip": "len(list_filter(string_split(whole, '.'), lambda p: length(ltrim(p, '0')) > 3 OR cast('0' || substr(ltrim(p, '0'), 1, 4) AS INTEGER) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    good = " UNION ALL ".join(f"SELECT r, kind, start, stop FROM m_{k} WHERE {test}" for k, test in tests.items())
    lengths = " ".join(f"WHEN '{country}' THEN {n}" for country, n in pii.IBAN_LENGTHS.items())
    proposal = pii.IBAN.pattern.removeprefix(r"\b")
    spaces = "list_filter(range(1, length(p) + 1), lambda i: i = length(p) OR substr(p, i + 1, 1) = ' ')"
    own = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pii.SCORES.items())
    words = " ".join(f"WHEN '{k}' THEN {_list(sorted(v))}" for k, v in pii.WORDS.items())
    near = f"list_distinct(regexp_extract_all(lower(substr(text, greatest(start - {pii.NEARBY}, 0) + 1, start - greatest(start - {pii.NEARBY}, 0)) || ' ' || substr(text, stop + 1, {pii.NEARBY})), '[a-z]+'))"
    place = f"list_position({_list(pii.KINDS)}, kind)"
    listed = f"string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY {place}, start)"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{found},
-- An account number: at each start of a word that could begin one, each prefix of the proposal that ends with a word; the country's length first, then the longest.
proposed AS (SELECT r, start, p, unnest({spaces}) AS n FROM (
  SELECT r, start, regexp_extract(substr(text, start + 1, 80), '^{proposal}') AS p FROM m_iban JOIN d USING (r) WHERE start = 0 OR NOT regexp_matches(substr(text, start, 1), '[A-Za-z0-9_]'))),
numbers AS (SELECT r, start, start + arg_min(n, (CASE WHEN length({bare}) = (CASE substr(whole, 1, 2) {lengths} ELSE 0 END) THEN 0 ELSE 1 END) * 1000 - n) AS stop
  FROM (SELECT r, start, n, substr(p, 1, n) AS whole FROM proposed) WHERE length({bare}) BETWEEN 15 AND 34 AND {mod} GROUP BY r, start),
followed AS (SELECT a.r, a.start, a.stop, min(b.start) AS next FROM numbers a LEFT JOIN numbers b ON b.r = a.r AND b.start >= a.stop GROUP BY a.r, a.start, a.stop),
taken AS (SELECT * FROM followed WHERE (r, start) IN (SELECT (r, min(start)) FROM followed GROUP BY r)
  UNION ALL SELECT f.* FROM taken t JOIN followed f ON f.r = t.r AND f.start = t.next),
good AS ({good} UNION ALL SELECT r, 'iban', start, stop FROM taken),
scored AS (SELECT r, kind, start, stop, round(least(1.0, greatest(0.0, CASE kind {own} END + {pii.STEP} * len(list_intersect({near}, CASE kind {words} END))
  - {pii.STEP} * len(list_intersect({near}, {_list(sorted(pii.DOUBTS))})))), 6)::DOUBLE AS score FROM good JOIN d USING (r)),
per AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)}, {listed} FILTER (kind <> 'iban') AS base, {listed} AS spans, max(score) AS score
  FROM scored GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per USING (r)"""


def decontamination_sql() -> str:
    """Every window that a common shingle lays, compared exactly; no fingerprints."""
    k = decontaminate.SHINGLE
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    grams = f"CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i : i + {k - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END"
    return rf"""
WITH d AS (SELECT doc_id, ws, {grams} AS g FROM (SELECT doc_id, {words} AS ws FROM documents)),
b AS (SELECT item_id, len(ws) AS size, {grams} AS g FROM (SELECT item_id, {words} AS ws FROM benchmark)),
dg AS (SELECT doc_id, unnest(g) AS s, unnest(range(0, len(g))) AS pos FROM d),
bg AS (SELECT item_id, size, unnest(g) AS s, unnest(range(0, len(g))) AS place FROM b),
laid AS (SELECT DISTINCT doc_id, item_id, size, greatest(pos - place, 0) AS start FROM dg JOIN bg USING (s)),
win AS (SELECT doc_id, item_id, size, start, {grams} AS g FROM (SELECT laid.*, d.ws[start + 1 : start + size] AS ws FROM laid JOIN d USING (doc_id))),
wc AS (SELECT doc_id, item_id, size, start, s, count(*) AS n FROM (SELECT doc_id, item_id, size, start, unnest(g) AS s FROM win) GROUP BY ALL),
bc AS (SELECT item_id, s, count(*) AS n FROM bg GROUP BY ALL),
shared AS (SELECT doc_id, item_id, size, start, sum(least(wc.n, bc.n)) AS common FROM wc JOIN bc USING (item_id, s) GROUP BY ALL),
judged AS (SELECT shared.doc_id, shared.item_id, shared.size, shared.start, common / (len(win.g) + len(b.g) - common) AS similarity
  FROM shared JOIN win USING (doc_id, item_id, size, start) JOIN b USING (item_id))
SELECT doc_id, item_id, start, cast(size AS INTEGER) AS size, similarity::DOUBLE AS similarity FROM judged WHERE similarity >= {decontaminate.SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


def conversations_sql() -> str:
    """Least edits as a recursion over rows: per grammar state the cost in nine digits and the audit, so that text order is (cost, audit)."""
    space = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

    def add(state: str, cost: str, edit: str) -> str:
        return f"(lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edit}')"

    ins = lambda s: add(s, str(conversations.INSERT), "I")
    gone = lambda s: add(s, str(conversations.DELETE), "D")
    extra = f"CASE WHEN fault = 't' THEN {conversations.TRUNCATED} ELSE 0 END"
    keep = lambda s, role: f"CASE WHEN i = '{role}' AND fault NOT IN ('b', 'd') THEN {add(s, extra, 'K')} END"
    rerole = lambda s: f"CASE WHEN fault NOT IN ('b', 'd') THEN {add(s, f'{conversations.REROLE} + {extra}', 'R')} END"
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1)))), lambda x, b: " \
        "list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))"
    return f"""
WITH RECURSIVE src AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS who, *, coalesce(role, ' ') AS said_by, coalesce(text, ' ') AS said,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
coded AS (SELECT *, xor({crc}, 4294967295) % {conversations.DAMAGES} AS code FROM src),
damaged AS (SELECT who, turn, CASE WHEN code = 4 THEN 'user' ELSE said_by END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE code <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY turn NULLS FIRST, role, md5(text)) AS n, trim(text, {space}) AS body FROM damaged),
m AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY who, role, text ORDER BY n) > 1 THEN 'd'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM numbered),
pairs AS (SELECT who, i, lag(i) OVER (PARTITION BY who ORDER BY n) AS before FROM m),
rec AS (
  SELECT who, CAST(0 AS BIGINT) AS n, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM (SELECT DISTINCT who FROM src)
  UNION ALL
  SELECT who, n, {gone("e")}, least({gone("s")}, {keep("e", "s")}),
   least({gone("u1")}, {", ".join(f"{keep(x, 'u')}, {rerole(x)}" for x in ("e", "s", "a1"))}), least({gone("a1")}, {keep("u1", "a")}, {rerole("u1")})
  FROM (SELECT *, least(a, {ins("u1")}) AS a1 FROM (
   SELECT rec.who, m.n, e, s, u, a, i, fault, least(u, {ins("e")}, {ins("s")}, {ins("a")}) AS u1 FROM rec JOIN m ON m.who = rec.who AND m.n = rec.n + 1))),
final AS (SELECT who, least(e, a, {ins(f'least(u, {ins("e")}, {ins("s")}, {ins("a")})')}) AS best FROM rec QUALIFY row_number() OVER (PARTITION BY who ORDER BY n DESC) = 1),
edits AS (SELECT who, p, substr(best, p, 1) AS edit FROM (SELECT who, best, unnest(range(10, length(best) + 1)) AS p FROM final)),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY who ORDER BY p) AS n FROM edits),
kept AS (SELECT placed.who, p, edit, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY placed.who ORDER BY p) AS j
  FROM placed LEFT JOIN m ON m.who = placed.who AND m.n = placed.n AND edit <> 'I' WHERE edit <> 'D'),
led AS (SELECT *, first_value(CASE WHEN edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY j) AS lead FROM kept),
said AS (SELECT who, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole FROM led GROUP BY who),
counts AS (SELECT who, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM m GROUP BY who),
wrong AS (SELECT who, count(*) AS illegal FROM pairs WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au') GROUP BY who),
every AS (SELECT DISTINCT who, conv_id FROM src)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every JOIN final USING (who) LEFT JOIN counts USING (who) LEFT JOIN wrong USING (who) LEFT JOIN said USING (who)"""


def hard_negatives_sql() -> str:
    low, high = hard_negatives.WINDOW
    return f"""
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM r a JOIN r b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % {hard_negatives.ANCHOR_EVERY} = 0),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY s DESC, vec_id NULLS LAST, br) AS k
  FROM s WHERE alike QUALIFY k <= {hard_negatives.POSITIVES})
SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.s AS negative_score,
 row_number() OVER (PARTITION BY p.ar, k ORDER BY s.s DESC, s.vec_id NULLS LAST, br) AS rank
FROM p JOIN s ON p.ar = s.ar AND NOT alike AND {low} * positive_score <= 100 * s.s AND 100 * s.s <= {high} * positive_score QUALIFY rank <= {hard_negatives.NEGATIVES}"""


def mixing_sql() -> str:
    times, weights = mixing.REPEATS, mixing.WEIGHTS
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), ' ')) AS shuffle,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS BIGINT) AS size FROM documents),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, {list(weights)}[(place - 1) % {len(weights)} + 1] AS w, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM named),
-- Sources by size for their weight: one is full if its share of what those before it leave is above its most.
f AS (SELECT *, CAST(budget - coalesce(sum({times} * source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * w
  / sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > {times} * source_size AS "full" FROM w),
t AS (SELECT *, CASE WHEN "full" THEN CAST({times} * source_size AS DOUBLE)
  ELSE CAST(budget - coalesce(sum(CASE WHEN "full" THEN {times} * source_size END) OVER (), 0) AS DOUBLE) * w / CAST(sum(CASE WHEN "full" THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM f),
q AS (SELECT r, doc_id, size, place, source_size, target, budget, sum(size) OVER (PARTITION BY place ORDER BY shuffle, size, r ROWS UNBOUNDED PRECEDING) AS given
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(again * source_size + given AS DOUBLE) / target AS finish FROM q, (SELECT unnest(range({times})) AS again)
  WHERE size > 0 AND target > 0 AND again * source_size + given - size <= target),
e AS (SELECT r, count(*) AS n FROM (SELECT r, budget, sum(size) OVER (ORDER BY finish, place, given, again ROWS UNBOUNDED PRECEDING) AS spent FROM c) WHERE spent <= budget GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(size * n, 0) AS taken FROM q LEFT JOIN e USING (r)"""


ORACLES = {
    "op1_license_scan": license_sql(),
    "op2_secret_scan": secrets_sql(),
    "op3_pii": pii_sql(),
    "op5_decontamination": decontamination_sql(),
    "op11_conversation_repair": conversations_sql(),
    "op12_hard_negatives": hard_negatives_sql(),
    "op13_mixing": mixing_sql(),
}
