"""DuckDB twins of the registered queries, written from the semantics, not from the Spark plans."""

from __future__ import annotations

from sealwright.queries import HR_TEXTS, NFKC_TEXTS, SEALED_AT, SIZE

# Fixed values, written anew so that a wrong one in the engine shows: first links, the root of no leaves, the format's name.
AUDIT_GENESIS = "b93b4ade8c758fa0086b464ac445fe6109681da57a99760eeb7f7bce3623562d"
SEGMENT_GENESIS = "68856029989354a47760a65ea30238356db77c609f595c6192dcdc6c7c5a4097"
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SEGMENT_SCHEMA = "segment.v1"
# Code points that can't be seen, and look-alikes with what they pass for.
HIDDEN = "".join(map(chr, [0xAD, 0x180E, *range(0x200B, 0x2010), *range(0x2028, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFEFF]))
_CYRILLIC = {"а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s"}
_GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "χ": "x",
}
_ALIKE = _CYRILLIC | {k.upper(): v for k, v in _CYRILLIC.items()} | _GREEK
_B, _E = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"  # Unicode word edges for RE2


def _shadow(x: str) -> str:
    return f"lower(translate(translate({x}, '{HIDDEN}', ''), '{''.join(_ALIKE)}', '{''.join(_ALIKE.values())}'))"


def _word(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){_B}(?:{pattern}){_E}')"


def _luhn(m: str) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({d}, length({d}) - i, 1) AS INTEGER)"
    return f"(length({d}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


_CARD = rf"(?i){_B}((?:\d[ -]*?){{13,19}}){_E}"
_IBAN_BODY = "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"


def _iban(m: str) -> str:
    turned = f"(substr(upper({m}), 5) || substr(upper({m}), 1, 4))"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END"
    step = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {value})), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
    return f"(length({m}) BETWEEN 15 AND 34 AND {step} = 1)"


_FINANCE = f"""
d AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'Finance Bot' ELSE 'Help Bot' END AS context, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, context, {_shadow("context || ' ' || t || ' '")} AS s FROM d),
m AS (SELECT *, regexp_extract(s, '{_CARD}', 1) AS card, regexp_extract(s, '(?i)PL[0-9]{{26}}', 0) AS pl, regexp_extract(s, '(?i){_B}({_IBAN_BODY}){_E}', 1) AS ib,
  {_word("s", "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?")} AND context LIKE '%Finance%' AS swift FROM s),
f AS (SELECT doc_id, list_filter([
  CASE WHEN card <> '' AND {_luhn("card")} THEN 'credit-card' END,
  CASE WHEN pl <> '' AND {_iban("pl")} THEN 'iban-pl' END,
  CASE WHEN ib <> '' AND {_iban("ib")} THEN 'iban-generic' END,
  CASE WHEN swift THEN 'swift-code' END], lambda x: x IS NOT NULL) AS rules FROM m),
g AS (SELECT doc_id, rules, 'finance-v1' AS policy_set, CASE WHEN list_contains(rules, 'credit-card') OR list_contains(rules, 'iban-pl') THEN 'DENY' WHEN len(rules) > 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision FROM f)
"""


def _ten(key: str) -> str:
    return f"lpad(CAST({key} * 104729 % 10000000000 AS VARCHAR), 10, '0')"


def _check(ten: str) -> str:
    weighted = " + ".join(f"CAST(substr({ten}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate([1, 3, 7, 9, 1, 3, 7, 9, 1, 3]))
    return f"((10 - ({weighted}) % 10) % 10)"


def _pesel_text(key: str) -> str:
    c = _check(_ten(key))
    return f"({_ten(key)} || CAST(CASE WHEN {key} % 2 = 0 THEN {c} ELSE ({c} + 3) % 10 END AS VARCHAR))"


def _pesel(t: str) -> str:
    month, day = f"CAST(substr({t}, 3, 2) AS INTEGER)", f"CAST(substr({t}, 5, 2) AS INTEGER)"
    return f"({month} % 20 BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 AND {_check(t)} = CAST(substr({t}, 11, 1) AS INTEGER))"


def _link(prev: str, e: str = "e") -> str:
    return f"sha256(concat_ws('|', {prev}, {e}.decision, {e}.policy_set, {e}.policy_hash, {e}.context, {e}.input_hash, {e}.shadow_hash, CAST({e}.seq AS VARCHAR), {e}.timestamp))"


_ENTRIES = """
e AS MATERIALIZED (SELECT CAST(coalesce(user_id % 16, 0) AS VARCHAR) AS log_id, event_id,
  CASE WHEN event_id % 7 = 0 THEN 'DENY' WHEN event_id % 5 = 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, 'finance-v1' AS policy_set,
  CASE WHEN event_id % 1000 < 990 THEN sha256('pack') ELSE sha256('old pack') END AS policy_hash, coalesce(event_type, '') AS context,
  sha256(coalesce(props, '')) AS input_hash, sha256(lower(coalesce(props, ''))) AS shadow_hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  row_number() OVER (PARTITION BY coalesce(user_id % 16, 0) ORDER BY event_id) - 1 AS seq FROM events)
"""
_CHAIN = f"""{_ENTRIES},
c(log_id, seq, prev_hash, chain_hash) AS (
  SELECT log_id, seq, '{AUDIT_GENESIS}', {_link(f"'{AUDIT_GENESIS}'")} FROM e WHERE seq = 0
  UNION ALL
  SELECT e.log_id, e.seq, c.chain_hash, {_link("c.chain_hash")} FROM c JOIN e ON e.log_id = c.log_id AND e.seq = c.seq + 1)
"""


# the patterns of e8_dialect as RE2 reads them
_RE2 = [
    "(?i)[bcdfghj-np-tv-z]{4}", "(?i)[g-z]{3}[0-9]", r"(?:^|[^\p{L}\p{M}\p{N}_])\p{Lu}{2}", r"(?i)\bthe\b", "(?m)^[A-Z]", r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ ", r"[^\x00-\x7F]", "(?i)e{2}|t{2}h",
    "[0-9]{3}-[0-9]{4}", "(?i)[ad]n[df]", r"[^\p{L}\p{M}\p{N}_\s]+\z", "(?i)a+ n",
]


def _levels(segment: str) -> str:
    """Tree levels (log_id, segment, lvl, idx, h, n) over the chain."""
    return f"""
lv(log_id, segment, lvl, idx, h, n) AS (
  SELECT log_id, {segment}, 0, row_number() OVER w - 1, unhex(sha256('\\x00'::BLOB || unhex(chain_hash))), count(*) OVER (PARTITION BY log_id, {segment}) FROM c WINDOW w AS (PARTITION BY log_id, {segment} ORDER BY seq)
  UNION ALL
  SELECT log_id, segment, lvl + 1, idx // 2, CASE WHEN r IS NULL THEN h ELSE unhex(sha256('\\x01'::BLOB || h || r)) END, (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY log_id, segment ORDER BY idx) AS r FROM lv WHERE n > 1) WHERE idx % 2 = 0)
"""


_SEG = f"(seq // {SIZE} + 1)"
_MANIFESTS = f"""{_CHAIN}, {_levels(_SEG)},
k AS (SELECT log_id, {_SEG} AS segment_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS entry_count, arg_max(chain_hash, seq) AS head_chain_hash_at_close FROM c GROUP BY 1, 2),
r AS (SELECT k.*, lower(hex(h)) AS merkle_root FROM k JOIN lv ON lv.log_id = k.log_id AND lv.segment = k.segment_id AND lv.n = 1),
p AS MATERIALIZED (SELECT *, coalesce(lag(merkle_root) OVER (PARTITION BY log_id ORDER BY segment_id), '{EMPTY_ROOT}') AS prev_merkle_root FROM r),
m AS (
  SELECT p.*, '{SEGMENT_GENESIS}' AS prev_segment_chain_hash, sha256(concat_ws('|', '{SEGMENT_GENESIS}', merkle_root, first_seq, last_seq, '{SEALED_AT}')) AS segment_chain_hash FROM p WHERE segment_id = 1
  UNION ALL
  SELECT p.*, m.segment_chain_hash, sha256(concat_ws('|', m.segment_chain_hash, p.merkle_root, p.first_seq, p.last_seq, '{SEALED_AT}')) FROM m JOIN p ON p.log_id = m.log_id AND p.segment_id = m.segment_id + 1)
"""
_TAMPERED = f"""{_CHAIN},
t AS (SELECT log_id, seq, CASE WHEN seq % 97 = 11 THEN 'ALLOW!' ELSE decision END AS decision, policy_set, policy_hash, context, input_hash, shadow_hash, timestamp,
  CASE WHEN seq % 101 = 50 THEN repeat('0', 64) ELSE prev_hash END AS prev_hash, chain_hash AS old FROM c JOIN e USING (log_id, seq)),
u AS (SELECT *, CASE WHEN seq % 101 = 50 THEN {_link("prev_hash", "t")} ELSE old END AS chain_hash FROM t),
v AS (SELECT log_id, seq AS pos, CASE WHEN prev_hash <> coalesce(lag(chain_hash) OVER (PARTITION BY log_id ORDER BY seq), '{AUDIT_GENESIS}') THEN 'PREV_BREAK' WHEN {_link("prev_hash", "u")} <> chain_hash THEN 'HASH_BREAK' ELSE 'OK' END AS status FROM u)
"""
_R = "WITH RECURSIVE "
_HR = "[" + ", ".join(f"'{t}'" for t in HR_TEXTS) + "]"
_STAMPS = f"""{_MANIFESTS}, st AS (SELECT log_id, segment_id, CASE WHEN segment_id % 4 = 0 THEN 'missing' WHEN segment_id % 6 = 5 THEN 'fail' ELSE 'ok' END AS status FROM m)"""


def oracle_sql() -> dict[str, str]:
    med = f"""
d AS (SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'MedTech desk' ELSE 'Desk' END AS context, {_pesel_text("p_partkey")} AS pt,
  'Patient ' || {_pesel_text("p_partkey")} || ' gets ' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN ' mg' ELSE ' cups' END || CASE WHEN p_partkey % 5 = 0 THEN '; Diagnosis open' ELSE '; kardiologiczna' END AS t FROM part),
f AS (SELECT p_partkey, list_filter([CASE WHEN {_pesel("pt")} THEN 'pesel' END, CASE WHEN {_word("t", "diagnosis|rozpoznanie|icd-?10|onkolog|kardiolog|neurolog")} THEN 'diagnosis-keyword' END,
  CASE WHEN {_word("t", "[0-9]+[ ]?(?:mg|ml|ug)")} AND context LIKE '%MedTech%' THEN 'medication-dosage' END], lambda x: x IS NOT NULL) AS rules FROM d)
SELECT p_partkey, 'medtech-v1' AS policy_set, CASE WHEN list_contains(rules, 'pesel') THEN 'DENY' WHEN len(rules) > 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, array_to_string(rules, ',') AS rules FROM f"""
    hr = f"""
d AS (SELECT c_custkey, list_extract({_HR}, c_custkey % 6 + 1) AS t FROM customer),
f AS (SELECT c_custkey, list_filter([CASE WHEN {_word("t", r"too\s+old|too\s+young|over\s+50|under\s+25")} THEN 'age-discrimination' END, CASE WHEN {_word("t", "matka|ojciec|pregnant|maternity|paternity")} THEN 'gender-family-bias' END,
  CASE WHEN {_word("t", "disabled|niepelnosprawn|niepełnosprawn|invalid|kalek")} THEN 'disability-bias' END], lambda x: x IS NOT NULL) AS rules FROM d)
SELECT c_custkey, 'hr-bias-v1' AS policy_set, CASE WHEN list_contains(rules, 'age-discrimination') THEN 'DENY' WHEN len(rules) > 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, array_to_string(rules, ',') AS rules FROM f"""
    facts = "[{'rule': 'credit-card', 'action': 'deny', 'c': 1.0, 'v': 'luhn'}, {'rule': 'iban-pl', 'action': 'deny', 'c': 1.0, 'v': 'iban'}, {'rule': 'iban-generic', 'action': 'review', 'c': 0.7, 'v': 'iban'}, {'rule': 'swift-code', 'action': 'review', 'c': 0.6, 'v': NULL}]"
    hidden = "P​L­61 АBC Ρx ё "
    chat = "'chat ' || text || ' ' || coalesce(answer, '')"
    body = "lpad(CAST(c_custkey AS VARCHAR), 24, '7')"
    iban_text = f"'pl' || CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(98 - CAST({body} || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') ELSE '11' END || {body}"
    manifest_vs_log = f"""{_MANIFESTS},
x AS (SELECT * REPLACE (CASE WHEN segment_id % 5 = 0 THEN entry_count + 1 ELSE entry_count END AS entry_count), CASE WHEN segment_id % 7 = 0 THEN 'no' ELSE 'yes' END AS head_kept FROM m),
l AS (SELECT log_id, {_SEG} AS segment_id, count(*) AS n, bool_or(seq % 160 = 155) AS broken FROM c WHERE seq < 180 OR log_id <> '3' GROUP BY 1, 2),
z AS (SELECT log_id, max(seq) + 1 AS size FROM c WHERE seq < 180 OR log_id <> '3' GROUP BY 1)
SELECT x.log_id, x.segment_id, CASE WHEN last_seq >= coalesce(size, 0) THEN 'OUT_OF_RANGE' WHEN n <> entry_count THEN 'COUNT_MISMATCH' WHEN broken THEN 'ROOT_MISMATCH' WHEN head_kept = 'no' THEN 'HEAD_MISMATCH' ELSE 'OK' END AS status
FROM x LEFT JOIN l USING (log_id, segment_id) LEFT JOIN z ON z.log_id = x.log_id"""
    segment_verify = f"""{_MANIFESTS},
x AS (SELECT *, CASE WHEN segment_id % 13 = 3 THEN 'other' ELSE '{SEGMENT_SCHEMA}' END AS schema, CASE WHEN segment_id % 9 = 4 THEN 'never' ELSE '{SEALED_AT}' END AS sealed_at FROM m WHERE segment_id % 11 <> 7),
y AS (SELECT *, lag(segment_id, 1, 0) OVER w AS bi, lag(segment_chain_hash, 1, '{SEGMENT_GENESIS}') OVER w AS bc, lag(merkle_root, 1, '{EMPTY_ROOT}') OVER w AS br FROM x WINDOW w AS (PARTITION BY log_id ORDER BY segment_id))
SELECT log_id, segment_id, CASE WHEN schema <> '{SEGMENT_SCHEMA}' THEN 'BAD_SCHEMA' WHEN segment_id <> bi + 1 THEN 'ID_GAP' WHEN prev_segment_chain_hash <> bc THEN 'PREV_CHAIN_BREAK' WHEN prev_merkle_root <> br THEN 'PREV_ROOT_BREAK'
  WHEN sha256(concat_ws('|', prev_segment_chain_hash, merkle_root, first_seq, last_seq, sealed_at)) <> segment_chain_hash THEN 'SELF_HASH_MISMATCH' ELSE 'OK' END AS status FROM y"""
    proofs = f"""{_MANIFESTS},
q AS (SELECT log_id, seq AS entry_seq, {_SEG} AS segment_id, seq % {SIZE} AS leaf_index FROM c),
w AS (SELECT q.log_id, q.entry_seq, string_agg(lower(hex(lv.h)), ',' ORDER BY lv.lvl) AS audit_path FROM q JOIN lv ON lv.log_id = q.log_id AND lv.segment = q.segment_id AND lv.n > 1
  AND lv.idx = CASE WHEN (leaf_index >> lv.lvl) % 2 = 0 THEN (leaf_index >> lv.lvl) + 1 ELSE (leaf_index >> lv.lvl) - 1 END GROUP BY 1, 2)
SELECT q.log_id, q.entry_seq, q.segment_id, q.leaf_index, m.entry_count AS tree_size, m.merkle_root, coalesce(w.audit_path, '') AS audit_path, true AS verified
FROM q JOIN m USING (log_id, segment_id) LEFT JOIN w ON w.log_id = q.log_id AND w.entry_seq = q.entry_seq"""
    deep = f"""{_CHAIN}, {_levels('0')},
w AS (SELECT c.log_id, c.seq, string_agg(lower(hex(lv.h)), ',' ORDER BY lv.lvl) AS audit_path FROM c JOIN lv ON lv.log_id = c.log_id AND lv.n > 1
  AND lv.idx = CASE WHEN (seq >> lv.lvl) % 2 = 0 THEN (seq >> lv.lvl) + 1 ELSE (seq >> lv.lvl) - 1 END GROUP BY 1, 2)
SELECT c.log_id, c.seq AS leaf_index, a.n AS tree_size, lower(hex(b.h)) AS merkle_root, coalesce(w.audit_path, '') AS audit_path, true AS verified
FROM c JOIN lv a ON a.log_id = c.log_id AND a.lvl = 0 AND a.idx = 0 JOIN lv b ON b.log_id = c.log_id AND b.n = 1 LEFT JOIN w ON w.log_id = c.log_id AND w.seq = c.seq"""
    leaf = lambda x: f"unhex(sha256('\\x00'::BLOB || unhex(sha256({x}))))"
    right = "lpad(CAST(98 - CAST(body || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0')"
    spaced = "replace(text, ' ', '')"
    checks = f"""
p AS (SELECT o_orderkey, o_custkey, o_orderpriority, lpad(CAST(o_orderkey * 104729 % 10000000000 AS VARCHAR), 10, '0') AS ten FROM orders),
c AS (SELECT o_orderkey, ten || CAST(({_check("ten")} + o_orderkey % 3) % 10 AS VARCHAR) AS text FROM p),
b AS (SELECT c_custkey, lpad(CAST(2100 + c_custkey AS VARCHAR), 12, '0') AS body FROM customer),
a AS (SELECT c_custkey, 'PL' || CASE WHEN c_custkey % 3 = 0 THEN {right} ELSE lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END || ' ' || body AS text FROM b),
n AS (SELECT o_orderkey, ten || '-' || o_custkey AS text FROM p),
t AS (SELECT o_orderkey, sha256('\x01'::BLOB || unhex(sha256('\x01'::BLOB || {leaf("CAST(o_orderkey AS VARCHAR)")} || {leaf("CAST(o_custkey AS VARCHAR)")})) || {leaf("o_orderpriority")}) AS root FROM p)
SELECT 'pesel' AS kind, o_orderkey AS id, text, {_pesel("text")} AS ok FROM c
UNION ALL SELECT 'iban', c_custkey, text, {_iban(spaced)} FROM a
UNION ALL SELECT 'luhn', o_orderkey, text, {_luhn("text")} FROM n
UNION ALL SELECT 'path', o_orderkey, root, CASE o_orderkey % 3 WHEN 2 THEN o_orderkey % 7 <> 0 WHEN 1 THEN o_orderkey % 5 <> 0 ELSE true END FROM t"""
    return {
        "a14_requests": f"""WITH {_FINANCE},
r AS (SELECT doc_id, decision, CASE WHEN doc_id % 13 = 2 THEN 'not JSON' WHEN doc_id % 101 = 5 AND doc_id % 17 <> 4 THEN 'too large'
  WHEN doc_id % 19 = 6 AND doc_id % 17 = 4 THEN 'not text: context, prompt' WHEN doc_id % 19 = 6 THEN 'not text: context' WHEN doc_id % 17 = 4 THEN 'not text: prompt' END AS problem FROM g)
SELECT CAST(CASE WHEN problem IS NOT NULL THEN 400 WHEN doc_id % 29 = 3 THEN 404 ELSE 200 END AS INTEGER) AS status, problem,
  CASE WHEN problem IS NULL THEN CASE WHEN doc_id % 29 = 3 THEN 'none' ELSE 'finance-v1' END END AS policy_set,
  CASE WHEN problem IS NULL AND doc_id % 29 <> 3 THEN decision END AS decision, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""",
        "a7_committed_logs": f"""{_R}{_CHAIN}, h AS (SELECT log_id, max(seq) + 1 AS next_seq, arg_max(chain_hash, seq) AS head FROM c GROUP BY log_id)
SELECT log_id, seq, 'id-' || event_id AS audit_id, decision, context, timestamp, prev_hash, chain_hash, next_seq, head FROM c JOIN e USING (log_id, seq) JOIN h USING (log_id)""",
        "j8_stamp_stream": f"""{_R}{_MANIFESTS}, a AS (SELECT log_id, segment_id, segment_id % 2 = 0 OR segment_id % 3 <> 1 AS asked, CAST('0x' || substr(segment_chain_hash, 2, 1) AS INTEGER) % 4 AS d FROM m)
SELECT log_id, segment_id, CASE WHEN asked AND d > 1 THEN 'ok' ELSE 'missing' END AS status, CASE WHEN asked THEN CAST(d > 1 AS BIGINT) END AS stored,
  CASE WHEN asked AND d = 0 THEN 'ConnectionError: no answer' WHEN asked AND d = 1 THEN 'ValueError: the answer is for another digest' END AS error FROM a""",
        "l6_observed_counters": f"""{_R}{_MANIFESTS},
a AS (SELECT log_id, segment_id, CAST(segment_id % 2 = 0 AS INTEGER) + CAST(segment_id % 3 <> 1 AS INTEGER) AS asked, CAST('0x' || substr(segment_chain_hash, 2, 1) AS INTEGER) % 4 AS d FROM m),
x AS (SELECT unnest(['allow', 'review', 'deny']) AS metric)
SELECT * FROM (WITH {_FINANCE}
  SELECT 'decisions' AS counter, 'requests' AS metric, count(*) AS n FROM g
  UNION ALL SELECT 'decisions', 'rejected', 0
  UNION ALL SELECT 'decisions', metric, (SELECT count(*) FROM g WHERE lower(decision) = metric) FROM x)
UNION ALL SELECT 'seals', 'entries', count(*) FROM c
UNION ALL SELECT 'seals', 'segments_sealed', count(*) FROM m WHERE entry_count = {SIZE}
UNION ALL SELECT 'seals', 'entries_sealed', CAST(coalesce(sum(entry_count), 0) AS BIGINT) FROM m WHERE entry_count = {SIZE}
UNION ALL SELECT 'stamps', 'stored', count(*) FROM a WHERE asked > 0 AND d > 1
UNION ALL SELECT 'stamps', 'failed', CAST(coalesce(sum(asked), 0) AS BIGINT) FROM a WHERE d < 2""",
        "g9_many_rules": f"""WITH s AS (SELECT doc_id, {_shadow("'Desk ' || coalesce(text, '') || ' ok'")} AS s FROM documents),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(s, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS rule FROM s)
SELECT rule, count(*) AS n FROM w WHERE regexp_full_match(rule, '(?:th|er|on|an|re|in|ed|nd|ha|at|en|es|tion){{3}}') GROUP BY rule""",
        "e8_dialect": "WITH d AS (SELECT coalesce(text, '') AS t FROM documents), p(pattern, re) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_RE2)) + ") SELECT CAST(pattern AS INTEGER) AS pattern, (SELECT count(*) FROM d WHERE regexp_matches(t, re)) AS n FROM p",
        "i6_deep_proofs": _R + deep,
        "g5_covering": f"""{_R}{_CHAIN},
k AS (SELECT log_id, {_SEG} AS segment_id, min(seq) AS a, max(seq) AS z FROM c GROUP BY 1, 2 HAVING segment_id % 6 <> 5),
f AS (SELECT log_id, segment_id, CASE WHEN segment_id % 3 = 0 THEN a - 70 ELSE a END AS a, CASE WHEN segment_id % 4 = 3 THEN 1125899906842624 WHEN segment_id % 5 = 2 THEN z + 20 ELSE z END AS z FROM k)
SELECT c.log_id, c.seq, c.chain_hash, min(segment_id) AS segment_id FROM c JOIN f ON c.log_id = f.log_id AND seq BETWEEN a AND z GROUP BY ALL""",
        "g8_overlapping_ranges": f"""{_R}{_CHAIN},
k AS (SELECT log_id, {_SEG} AS segment_id, max(seq) AS z FROM c GROUP BY 1, 2), n AS (SELECT log_id, count(*) AS n FROM c GROUP BY 1)
SELECT log_id, segment_id, 'OK' AS status FROM k
UNION ALL SELECT log_id, segment_id + 100000, CASE WHEN z + 7 < n THEN 'ROOT_MISMATCH' ELSE 'OUT_OF_RANGE' END FROM k JOIN n USING (log_id)
UNION ALL SELECT log_id, segment_id + 200000, CASE WHEN segment_id = 1 THEN 'OK' ELSE 'COUNT_MISMATCH' END FROM k WHERE z > 60""",
        "k_audit_path": _R + proofs,
        "k_sql_checks": f"WITH {checks}",
        "b6_shadow_normalize": f"WITH x AS (SELECT doc_id, {_shadow(f"'{hidden}' || coalesce(text, '')")} AS s FROM documents) SELECT doc_id, substr(s, 1, 20) AS head, sha256(s) AS shadow_hash FROM x",
        "c4_interaction_hashes": f"WITH x AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) SELECT conv_id, turn, sha256({chat}) AS input_hash, sha256({_shadow(chat)}) AS shadow_hash FROM x WHERE role = 'user'",
        "d2_pesel_check": f"WITH x AS (SELECT o_orderkey, {_pesel_text('o_orderkey')} AS t FROM orders) SELECT o_orderkey, t, {_pesel('t')} AS ok FROM x",
        "d3_iban_check": f"WITH x AS (SELECT c_custkey, {iban_text} AS t FROM customer) SELECT c_custkey, t, {_iban('t')} AS ok FROM x",
        "e2_first_match": f"WITH s AS (SELECT doc_id, {_shadow("coalesce(text, '')")} AS s FROM documents), m AS (SELECT doc_id, regexp_extract(s, '{_CARD}', 1) AS m FROM s) SELECT doc_id, m, {_luhn('m')} AS passes FROM m WHERE m <> ''",
        "e5_violations_finance": f"WITH {_FINANCE}, x AS (SELECT doc_id, rules, unnest(range(0, len(rules))) AS ord FROM g), y AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, list_filter({facts}, lambda r: r.rule = rules[ord + 1])[1] AS r FROM x) SELECT doc_id, ord, r.rule AS rule, r.action AS action, CAST(r.c AS DOUBLE) AS confidence, r.v AS validator FROM y",
        "e7_decide_finance": f"WITH {_FINANCE} SELECT doc_id, policy_set, decision, array_to_string(rules, ',') AS rules FROM g",
        "e7_decide_medtech": f"WITH {med}",
        "e7_decide_hr": f"WITH {hr}",
        "e11_unknown_packs": "SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR c_mktsegment IN ('BUILDING', 'MACHINERY', 'finance-v1', 'medtech-v1', 'hr-bias-v1') THEN 'audit' ELSE 'reject' END AS path FROM customer",
        "f5_decision_counts": f"WITH {_FINANCE} SELECT decision, policy_set, count(*) AS n FROM g GROUP BY ALL",
        "f9_rule_hits": f"WITH {_FINANCE}, x AS (SELECT policy_set, unnest(rules) AS rule FROM g) SELECT policy_set, rule, CASE WHEN rule IN ('credit-card', 'iban-pl') THEN 'deny' ELSE 'review' END AS action, count(*) AS n FROM x GROUP BY ALL",
        "f3_chain_build": f"{_R}{_CHAIN} SELECT * FROM c",
        "i1_chain_verify": f"{_R}{_TAMPERED} SELECT * FROM v",
        "h4_first_breaks": f"{_R}{_TAMPERED} SELECT log_id, min(pos) AS pos, arg_min(status, pos) AS status FROM v WHERE status <> 'OK' GROUP BY log_id",
        "a2_heads": f"{_R}{_CHAIN} SELECT log_id, max(seq) + 1 AS next_seq, arg_max(chain_hash, seq) AS chain_hash FROM c GROUP BY log_id",
        "f4_segment_summary": f"{_R}{_CHAIN} SELECT log_id, {_SEG} AS segment_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS entry_count, arg_max(chain_hash, seq) AS head_chain_hash_at_close FROM c GROUP BY 1, 2",
        "f1_merkle_roots": f"{_R}{_CHAIN}, {_levels(f'(seq // {SIZE})')} SELECT a.log_id, a.segment, a.n, lower(hex(b.h)) AS merkle_root FROM lv a JOIN lv b ON a.log_id = b.log_id AND a.segment = b.segment AND b.n = 1 WHERE a.lvl = 0 AND a.idx = 0",
        "f1_deep_merkle_roots": f"{_R}{_CHAIN}, {_levels('0')} SELECT a.log_id, a.n, lower(hex(b.h)) AS merkle_root FROM lv a JOIN lv b ON a.log_id = b.log_id AND b.n = 1 WHERE a.lvl = 0 AND a.idx = 0",
        "c18_segment_chain": f"{_R}{_MANIFESTS} SELECT log_id, segment_id, first_seq, last_seq, entry_count, merkle_root, prev_merkle_root, prev_segment_chain_hash, segment_chain_hash FROM m",
        "j7_sealing_resumed": f"{_R}{_MANIFESTS} SELECT log_id, segment_id, first_seq, last_seq, entry_count, merkle_root, prev_merkle_root, prev_segment_chain_hash, segment_chain_hash FROM m",
        "j_state_resume": f"{_R}{_MANIFESTS} SELECT log_id, segment_id, first_seq, last_seq, entry_count, merkle_root, prev_merkle_root, prev_segment_chain_hash, segment_chain_hash FROM m",
        "b2_nfkc_documents": f"SELECT doc_id, regexp_matches(coalesce(text, ''), 'é|ü|ö|ñ|ç|fi|[.][.][.]|[257kD]') AS changed, sha256({_shadow("coalesce(text, '')")}) AS shadow_hash FROM documents",
        "b2_nfkc_shadow": "SELECT n_nationkey, i, s FROM nation CROSS JOIN (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(NFKC_TEXTS)) + ") AS v(i, s)",
        "a1_log_round_trip": f"{_R}{_CHAIN} SELECT seq, 'id-' || seq AS audit_id, decision, context, timestamp, chain_hash FROM c JOIN e USING (log_id, seq) WHERE log_id = '3'",
        "i3_segment_verify": _R + segment_verify,
        "i4_manifest_vs_log": _R + manifest_vs_log,
        "i6_inclusion_proofs": _R + proofs,
        "e14_unsealed_tail": f"WITH {_ENTRIES}, z AS (SELECT log_id, max(seq) + 1 AS n FROM e GROUP BY 1) SELECT log_id, seq FROM e JOIN z USING (log_id) WHERE seq >= n // {SIZE} * {SIZE}",
        "f6_seal_counts": f"WITH {_ENTRIES}, z AS (SELECT log_id, count(*) AS n FROM e GROUP BY 1) SELECT log_id, n // {SIZE} AS segments_sealed, n // {SIZE} * {SIZE} AS entries_sealed, n % {SIZE} AS open_entries FROM z",
        "i2_lineage": f"WITH {_ENTRIES} SELECT log_id, policy_set, policy_hash, sha256('pack') AS disk_hash, min(seq) AS first_seq, count(*) AS n, 'MISMATCH' AS status FROM e WHERE policy_hash <> sha256('pack') GROUP BY 1, 2, 3",
        "i9_verify_stamps": f"{_R}{_STAMPS} SELECT * FROM st",
        "f8_stamp_summary": f"{_R}{_STAMPS} SELECT status, count(*) AS n FROM st GROUP BY status",
        "c21_stamp_requests": f"{_R}{_MANIFESTS} SELECT log_id, segment_id, '30390201013031300d060960864801650304020105000420' || segment_chain_hash || '0101ff' AS request FROM m",
        "j5_stream_seal": f"{_R}{_MANIFESTS} SELECT log_id, segment_id, first_seq, last_seq, entry_count, merkle_root, segment_chain_hash FROM m WHERE entry_count = {SIZE}",
    }
