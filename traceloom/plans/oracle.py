"""SQL for the queries of ``traceloom.plans.queries``."""

from __future__ import annotations

TWO64 = 1 << 64


class C:
    """Fixed values, stated apart from those of the engine so that a wrong one there shows."""

    FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
    EFFECT_TAGS = {"write": 1, "new_region": 2, "call": 3, "syscall": 4, "branch": 5, "ret": 6, "capped": 7, "read": 8}
    CALL_NAMED, CALL_ANONYMOUS = 1, 2
    REGION_TAGS = {"arg": 10, "stack": 11, "heapish": 12, "global": 13}
    VALUE_TAGS = {"input": 20, "input_deriv": 21, "zero": 22, "small_const": 23, "big_const": 24, "unknown": 25}
    UNIGRAM, TRIGRAM, SLOTS, BANDS = 1, 3, 128, 32
    PERM_A = (
        0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
    )
    PERM_B = (
        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x2545F4914F6CDD1D,
    )
    PERM_A_ADD, PERM_B_STEP, PERM_SHIFT = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D, 29
    CHANGES_SHOWN = 40
    ARG_BASE, ARG_STRIDE, ARG_SIZE = 0x10_0000_0000, 0x1_0000_0000, 0x8000
    STACK_START = 0x20_0000_0000 + 0x2_0000



# ---- building blocks -------------------------------------------------------------------------------------------------


def _u(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN {x}::HUGEINT + {TWO64} ELSE {x}::HUGEINT END)::UHUGEINT"


def _i(x: str) -> str:
    return f"(CASE WHEN {x} >= {TWO64 // 2} THEN {x}::HUGEINT - {TWO64} ELSE {x}::HUGEINT END)::BIGINT"


def _bytes(x: str) -> str:
    return "[" + ", ".join(f"({_u(x)} // {256**k}) % 256" for k in range(8)) + "]"


def _fnv(list_: str) -> str:
    start = f"list_prepend({C.FNV_OFFSET}::UHUGEINT, ({list_})::UHUGEINT[])"
    return f"list_reduce({start}, lambda h, b: (xor(h, b) * {C.FNV_PRIME}) % {TWO64})"


def _case(col: str, table: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


_REGION = f"list_concat([{_case('region', C.REGION_TAGS)}], CASE WHEN region = 'arg' THEN {_bytes('region_k')} ELSE [] END)"
_VALUE = f"list_concat([{_case('val', C.VALUE_TAGS)}], CASE WHEN val IN ('input', 'input_deriv', 'small_const') THEN {_bytes('val_k')} ELSE [] END)"
_SYM = "list_transform(range(0, octet_length(encode(sym))), lambda k: ('0x' || substr(hex(encode(sym)), 2 * k + 1, 2))::INTEGER)"
_T = C.EFFECT_TAGS
TOKEN_BYTES = f"""CASE kind
  WHEN 'write' THEN list_concat([{_T['write']}], {_REGION}, {_bytes('off')}, {_VALUE})
  WHEN 'read' THEN list_concat([{_T['read']}], {_REGION}, {_bytes('off')})
  WHEN 'new_region' THEN list_concat([{_T['new_region']}], {_REGION})
  WHEN 'call' THEN CASE WHEN sym IS NULL THEN [{_T['call']}, {C.CALL_ANONYMOUS}] ELSE list_concat([{_T['call']}, {C.CALL_NAMED}], {_SYM}) END
  WHEN 'syscall' THEN list_concat([{_T['syscall']}], {_bytes('nr')})
  WHEN 'branch' THEN [{_T['branch']}]
  WHEN 'ret' THEN list_concat([{_T['ret']}], {_VALUE})
  WHEN 'capped' THEN [{_T['capped']}] END"""

FIELDS = "kind, region, region_k, off, val, val_k, sym, nr"
EFFECTS = f"""
e0 AS (SELECT trace_id, func_id, unnest(effects) AS x FROM traces),
e1 AS (SELECT trace_id, func_id, x.seq AS seq, any_value(x) AS x FROM e0 WHERE x.seq IS NOT NULL GROUP BY ALL),
e AS (SELECT trace_id, func_id, seq, {', '.join(f'x.{c} AS {c}' for c in FIELDS.split(', '))} FROM e1)
"""
DISTINCT = f"(SELECT DISTINCT {FIELDS} FROM (SELECT unnest(effects, max_depth := 2) FROM traces))"
WEIGHT = "CASE WHEN kind IN ('call', 'syscall') THEN 3 WHEN kind IN ('write', 'new_region') THEN 2 WHEN kind = 'read' THEN 1 WHEN kind = 'ret' AND val IN ('input', 'input_deriv') THEN 1 ELSE 0 END"

EFFECT_TOKENS = f"SELECT {FIELDS}, {_i('h')} AS token FROM (SELECT {FIELDS}, {_fnv(TOKEN_BYTES)} AS h FROM {DISTINCT})"

COMPLEXITY = f"""
WITH {EFFECTS}, s AS (SELECT trace_id, sum({WEIGHT})::BIGINT AS c, count(*)::INTEGER AS n FROM e GROUP BY trace_id)
SELECT t.trace_id, t.func_id, coalesce(c, 0)::BIGINT AS complexity, coalesce(n, 0)::INTEGER AS n_effects FROM traces t LEFT JOIN s USING (trace_id)
"""

_KEY = f"struct_pack({', '.join(f'{c} := {c}' for c in FIELDS.split(', '))})"
SHINGLE_COUNTS = f"""
WITH {EFFECTS},
k AS (SELECT trace_id, list({_KEY}::VARCHAR ORDER BY seq) AS l FROM e GROUP BY trace_id),
s AS (SELECT trace_id, len(list_distinct(l)) + len(list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i:i+2]))) AS n FROM k)
SELECT t.trace_id, coalesce(n, 0)::INTEGER AS n_shingles FROM traces t LEFT JOIN s USING (trace_id)
"""

_PERM = ", ".join(
    f"({i}, {((C.PERM_A[i % 8] * (i | 1) + C.PERM_A_ADD) % TWO64) | 1}::UHUGEINT, {(C.PERM_B[i % 8] + i * C.PERM_B_STEP) % TWO64}::UHUGEINT)" for i in range(C.SLOTS)
)
def fingerprints(source: str = "traces", key: str = "func_id") -> str:
    """Fingerprint of every key of a relation with ``trace_id``, a key, ``effects`` and ``capped``."""
    return f"""
WITH src AS (SELECT trace_id, {key} AS func_id, effects, capped FROM {source}), {EFFECTS.replace("FROM traces", "FROM src")},
d AS MATERIALIZED (SELECT {_KEY}::VARCHAR AS k, {_fnv(TOKEN_BYTES)} AS h FROM {DISTINCT.replace("FROM traces", "FROM src")}),
tok AS (SELECT trace_id, func_id, list(h ORDER BY seq) AS l FROM (SELECT trace_id, func_id, seq, {_KEY}::VARCHAR AS k FROM e) JOIN d USING (k) GROUP BY ALL),
w AS (
  SELECT func_id, unnest(list_transform(l, lambda t: [{C.UNIGRAM}::UHUGEINT, t])) AS g FROM tok
  UNION SELECT func_id, unnest(list_transform(range(1, len(l) - 1), lambda i: list_prepend({C.TRIGRAM}::UHUGEINT, l[i:i+2]))) FROM tok
),
g AS MATERIALIZED (
  SELECT g, {_fnv(f"flatten(list_transform(g, lambda v: [{', '.join(f'(v // {256**k}) % 256' for k in range(8))}]))")} AS x FROM (SELECT DISTINCT g FROM w)
),
p(slot, a, b) AS (VALUES {_PERM}),
v AS MATERIALIZED (SELECT g, slot, xor(m, m // {1 << C.PERM_SHIFT}) AS v FROM (SELECT g, slot, (x * a + b) % {TWO64} AS m FROM g, p)),
m AS (SELECT func_id, slot, min(v) AS v FROM w JOIN v USING (g) GROUP BY ALL),
s AS (SELECT func_id, md5(string_agg({_i('v')}::VARCHAR, ',' ORDER BY slot)) AS sig_md5 FROM m GROUP BY func_id),
n AS (SELECT func_id, count(DISTINCT g) AS n FROM w GROUP BY func_id),
c AS (SELECT func_id, max(c) AS c FROM (SELECT trace_id, func_id, sum({WEIGHT})::BIGINT AS c FROM e GROUP BY ALL) GROUP BY func_id),
f AS (SELECT func_id, bool_or(coalesce(capped, false)) AS capped FROM src GROUP BY func_id)
SELECT func_id, coalesce(c, 0)::BIGINT AS complexity, coalesce(n, 0)::BIGINT AS shingles, capped,
  coalesce(sig_md5, md5(array_to_string(list_transform(range({C.SLOTS}), lambda i: '0'), ','))) AS sig_md5
FROM f LEFT JOIN s USING (func_id) LEFT JOIN n USING (func_id) LEFT JOIN c USING (func_id)
"""

BANDS = f"""
SELECT id AS func_id, b::INTEGER AS band, {_i('h')} AS key FROM (
  SELECT id, b, {_fnv(f"flatten(list_transform(sig[4 * b + 1:4 * b + 4], lambda s: {_bytes('s')}))")} AS h
  FROM funcs, range({C.BANDS}) r(b) WHERE len(sig) = {C.SLOTS}
)"""

# ---- matching --------------------------------------------------------------------------------------------------------

AGREE = "len(list_filter(list_zip({a}, {b}), lambda z: z[1] = z[2]))"
_UNKNOWN, _KNOWN = "name IS NULL", "name IS NOT NULL"


def _any_label(*labels: str) -> str:
    return "(" + " OR ".join(f"contains(\"binary\", '{x}')" for x in labels) + ")"


def best(target: str, corpus: str) -> str:
    """Best match of each gated target: id, similarity, guess, from_binary, func_id."""
    runs = "SELECT id, b, sig[4 * b + 1:4 * b + 4] AS k FROM {}, range(32) r(b)"
    return f"""(
WITH t AS (SELECT * FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles <> 0 AND {target}),
al AS (SELECT * FROM funcs WHERE len(sig) = 128 AND {corpus}),
c AS (SELECT * FROM al WHERE complexity >= 4 AND name IS NOT NULL),
cand AS (SELECT DISTINCT x.id AS t, y.id AS c FROM ({runs.format('t')}) x JOIN ({runs.format('al')}) y USING (b, k)),
pool AS (SELECT t, c FROM cand UNION ALL SELECT t.id, c.id FROM t, c WHERE t.id NOT IN (SELECT t FROM cand)),
s AS (SELECT t.id, c.id AS cid, c.name, c."binary" AS bin, {AGREE.format(a='t.sig', b='c.sig')} AS n FROM pool JOIN t ON t.id = pool.t JOIN c ON c.id = pool.c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, cid) AS k FROM s)
SELECT id, n / 128.0 AS similarity, name AS guess, bin AS from_binary, cid AS func_id FROM r WHERE k = 1)"""


TRIAGE = f"""
SELECT t.id, t.entry, coalesce(v.similarity, 0.0) AS vuln_similarity, coalesce(v.guess, '') AS vuln_name,
  coalesce(p.similarity, 0.0) AS patched_similarity, coalesce(p.guess, '') AS patched_name,
  coalesce(v.similarity, 0.0) - coalesce(p.similarity, 0.0) AS lead,
  CASE WHEN greatest(coalesce(v.similarity, 0), coalesce(p.similarity, 0)) < 0.6 THEN 'inconclusive'
    WHEN (coalesce(v.similarity, 0) - coalesce(p.similarity, 0)) * 128 >= 10.24 THEN 'vulnerable'
    WHEN (coalesce(p.similarity, 0) - coalesce(v.similarity, 0)) * 128 >= 10.24 THEN 'patched' ELSE 'inconclusive' END AS verdict
FROM funcs t
LEFT JOIN {best(_UNKNOWN, f"{_KNOWN} AND {_any_label('-o0', '-o1')}")} v ON v.id = t.id
LEFT JOIN {best(_UNKNOWN, f"{_KNOWN} AND {_any_label('-o2', '-o3')}")} p ON p.id = t.id
WHERE len(t.sig) = 128 AND t.complexity >= 4 AND t.shingles <> 0 AND t.name IS NULL
"""


def _last(side: str) -> str:
    return f"""(SELECT name, arg_max(complexity, id) AS complexity, arg_max(sig, id) AS sig
      FROM funcs WHERE len(sig) = 128 AND name IS NOT NULL AND {side} GROUP BY name)"""


MATCH = f"""
SELECT coalesce(a.name, b.name) AS name,
  CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' WHEN a.complexity < 4 OR b.complexity < 4 THEN 'low_signal'
    WHEN {AGREE.format(a='a.sig', b='b.sig')} >= 113 THEN 'same' ELSE 'changed' END AS status,
  CASE WHEN a.complexity >= 4 AND b.complexity >= 4 THEN {AGREE.format(a='a.sig', b='b.sig')} / 128.0 END AS similarity
FROM {_last(_any_label('-gx-'))} a FULL OUTER JOIN {_last(_any_label('-tc-', '-lv-'))} b ON a.name = b.name
"""

_GATED = "len(sig) = 128 AND complexity >= 4 AND shingles > 0 AND name IS NOT NULL"
RANKS = f"""
WITH b AS (SELECT id, name, sig FROM funcs WHERE {_GATED} AND {_any_label('-o3')}),
a AS (SELECT id, name, sig FROM funcs WHERE {_GATED} AND {_any_label('-o2')} AND name IN (SELECT name FROM b)),
s AS (SELECT a.id, a.name, b.name AS other, {AGREE.format(a='a.sig', b='b.sig')} AS n, b.id AS bid FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, bid) AS k FROM s)
SELECT id, name, min(CASE WHEN other = name THEN k END)::BIGINT AS "rank", arg_min(other, k) AS top_name, max(n) / 128.0 AS top_similarity
FROM r GROUP BY id, name
"""

EVAL = f"""
WITH r AS ({RANKS}), x AS (SELECT *, top_similarity >= 0.88 AS same, top_name = name AS ok FROM r),
s AS (SELECT count(*) AS scored, count_if(ok) AS rank1, count_if(same AND ok) AS tp, count_if(same AND NOT ok) AS fp,
  count_if(NOT same AND ok) AS fn, count_if(NOT same) AS abstained, sum(1.0 / "rank") AS rr, count_if("rank" <= 3) AS a3, count_if("rank" <= 5) AS a5 FROM x)
SELECT scored, rank1::BIGINT AS rank1, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, abstained::BIGINT AS abstained,
  round(coalesce(rank1 / nullif(scored, 0), 0), 6) AS rank1_accuracy, round(coalesce(rr / nullif(scored, 0), 0), 6) AS mrr,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(a3 / nullif(scored, 0), 0), 6) AS recall_at_3, round(coalesce(a5 / nullif(scored, 0), 0), 6) AS recall_at_5,
  round(coalesce(abstained / nullif(scored, 0), 0), 6) AS abstain_rate FROM s
"""

# ---- access log ------------------------------------------------------------------------------------------------------

LOG = f"""
l0 AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN user_id % 25 ELSE 99 END AS run, event_id AS step, event_id AS k,
    CASE WHEN event_type = 'click' THEN 'read' WHEN event_type IN ('view', 'signup') THEN 'write' ELSE 'insn' END AS event FROM events WHERE event_id IS NOT NULL
), l1 AS (
  SELECT *, CASE WHEN event = 'insn' THEN {0x400000} + k % 64 WHEN k % 5 < 2 THEN {C.ARG_BASE} + (k % 6) * {C.ARG_STRIDE} + (k * 40) % 4096
    WHEN k % 5 = 2 THEN {C.STACK_START} + k % 128 - 64 WHEN k % 5 = 3 THEN {0x400000} + k % 512 ELSE {0x7000_0000} + (k * 4093) % 4000000 END AS addr,
    CASE WHEN event <> 'insn' THEN CASE WHEN k % 5 < 2 THEN 'arg' WHEN k % 5 = 2 THEN 'stack' WHEN k % 5 = 3 THEN 'global' ELSE 'heapish' END END AS region,
    CASE WHEN event <> 'insn' AND k % 5 < 2 THEN (k % 6)::INTEGER END AS region_k,
    CASE WHEN k % 5 < 2 THEN (k * 40) % 4096 WHEN k % 5 = 3 THEN 0 ELSE ({0x7000_0000} + (k * 4093) % 4000000) % 4096 END AS o
  FROM l0
), l2 AS (
  SELECT *, least(2048, (o // 8) * 8)::INTEGER AS off, CASE region WHEN 'arg' THEN 'a' || region_k WHEN 'global' THEN 'g' WHEN 'heapish' THEN 'p' || (addr // 4096) END AS touch FROM l1
), l3 AS (
  SELECT *, touch IS NOT NULL AND row_number() OVER (PARTITION BY run, touch ORDER BY step) = 1 AS fresh,
    event = 'read' AND region <> 'stack' AND row_number() OVER (PARTITION BY run, event = 'read', region, region_k, off ORDER BY step) = 1 AS field FROM l2
), l AS (
  SELECT *, fresh AND (region <> 'heapish' OR count_if(fresh AND region = 'heapish') OVER w <= @HEAP) AS touched,
    field AND count_if(field) OVER w <= @READS AS field_read,
    count_if(event = 'insn') OVER w AS instret, count_if(event = 'insn') OVER (PARTITION BY run, event, addr ORDER BY step) AS visits,
    count_if(fresh AND region = 'heapish') OVER w AS pages
  FROM l3 WINDOW w AS (PARTITION BY run ORDER BY step)
)
"""
_WRITTEN = f"""CASE WHEN v = 0 THEN 'zero' WHEN v = {C.ARG_BASE} THEN 'input' WHEN v > {C.ARG_BASE} AND v < {C.ARG_BASE + C.ARG_SIZE} THEN 'input_deriv'
  WHEN v BETWEEN -4096 AND 4096 THEN 'small_const' ELSE 'big_const' END"""
LOG_EFFECTS = f"""
WITH {LOG}, m AS (
  SELECT *, CASE WHEN event = 'insn' OR k % 11 > 2 THEN w ELSE w & (CASE k % 11 WHEN 0 THEN 255 WHEN 1 THEN 65535 ELSE 4294967295 END) END AS v,
    event = 'write' AND region <> 'stack' AS written, event = 'insn' AND k % 7 < 4 AS acts FROM (
      SELECT *, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN k % 9000 - 4500 WHEN k % 4 = 2 THEN {C.ARG_BASE} + k % 3 ELSE k * 1000003 END AS w FROM l)
), b AS (
  SELECT *, coalesce(sum(touched::INT + field_read::INT + written::INT + acts::INT) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
    (SELECT * REPLACE (coalesce(touched, false) AS touched, coalesce(field_read, false) AS field_read, coalesce(written, false) AS written) FROM m)
), c AS (
  SELECT *, min(CASE WHEN (event = 'insn' AND (visits > @VISITS OR instret > @INSNS OR before >= @EFFECTS)) OR (event = 'write' AND before >= @EFFECTS)
    OR (fresh AND region = 'heapish' AND pages > @PAGES) THEN step END) OVER (PARTITION BY run) AS stop, max(instret) OVER (PARTITION BY run) >= @INSNS AS spent FROM b
), kept AS (SELECT * FROM c WHERE stop IS NULL OR step < stop),
x AS (
  SELECT run, step, 0 AS i, instret AS ic, 'new_region' AS kind, region, region_k, NULL::INTEGER AS off, NULL::VARCHAR AS val, NULL::BIGINT AS val_k, NULL::VARCHAR AS sym, NULL::BIGINT AS nr FROM kept WHERE touched
  UNION ALL SELECT run, step, 1, instret, 'read', region, region_k, off, NULL, NULL, NULL, NULL FROM kept WHERE field_read
  UNION ALL SELECT run, step, 2, instret, 'write', region, region_k, off, {_WRITTEN},
    CASE {_WRITTEN} WHEN 'small_const' THEN v WHEN 'input' THEN 0 WHEN 'input_deriv' THEN 0 END, NULL, NULL FROM kept WHERE written
  UNION ALL SELECT run, step, 3, instret, CASE k % 7 WHEN 0 THEN 'call' WHEN 1 THEN 'branch' WHEN 2 THEN 'syscall' ELSE 'ret' END, NULL, NULL, NULL,
    CASE WHEN k % 7 = 3 THEN {_WRITTEN} END, CASE WHEN k % 7 = 3 THEN CASE {_WRITTEN} WHEN 'small_const' THEN v WHEN 'input' THEN 0 WHEN 'input_deriv' THEN 0 END END,
    CASE WHEN k % 7 = 0 AND k % 2 = 0 THEN 'f' || (k % 11) END, CASE WHEN k % 7 = 2 THEN k % 330 END FROM kept WHERE acts
)
SELECT run, (row_number() OVER (PARTITION BY run ORDER BY step, i) - 1)::INTEGER AS seq, ic::BIGINT AS ic, kind, region, region_k, off, val, val_k, sym, nr FROM x
UNION ALL
SELECT q.run, coalesce((SELECT count(*) FROM x WHERE x.run = q.run), 0)::INTEGER, coalesce((SELECT max(instret) FROM kept WHERE kept.run = q.run), 0)::BIGINT, 'capped', NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT DISTINCT run FROM c WHERE stop IS NOT NULL OR spent) q
"""



def capped(sql: str, instructions: int = 20_000, visits: int = 64, effects: int = 96, reads: int = 64, heap_pages: int = 24, run_pages: int = 256) -> str:
    """A log query with its caps; the numbers are stated here once more, not taken from the engine."""
    for tag, n in (("@INSNS", instructions), ("@VISITS", visits), ("@EFFECTS", effects), ("@READS", reads), ("@HEAP", heap_pages), ("@PAGES", run_pages)):
        sql = sql.replace(tag, str(n))
    return sql


P6_PROFILE = """
WITH v AS (
  SELECT 'complexity' AS field, complexity::VARCHAR AS k, id, "binary" AS b, name, indexed_at FROM funcs WHERE complexity IS NOT NULL
  UNION ALL SELECT 'shingles', shingles::VARCHAR, id, "binary", name, indexed_at FROM funcs WHERE shingles IS NOT NULL
  UNION ALL SELECT 'sig', sig::VARCHAR, id, "binary", name, indexed_at FROM funcs WHERE len(sig) = 128
)
SELECT field, CASE WHEN field = 'sig' THEN min(id)::VARCHAR ELSE k END AS key_text, count(*) AS n_rows,
  count(DISTINCT b) AS n_binaries, count(DISTINCT name) AS n_names, min(indexed_at) AS first_indexed, max(indexed_at) AS last_indexed
FROM v GROUP BY field, k
"""
_ESCAPED = (
    "CASE WHEN regexp_matches(name, '[^\\x20-\\x7e]') THEN array_to_string(list_transform(range(0, octet_length(encode(name))), lambda k: "
    "CASE WHEN substr(hex(encode(name)), 2 * k + 1, 2) BETWEEN '20' AND '7E' THEN chr(('0x' || substr(hex(encode(name)), 2 * k + 1, 2))::INTEGER) "
    "ELSE '\\x' || lower(substr(hex(encode(name)), 2 * k + 1, 2)) END), '') ELSE name END"
)


def oracle_sql() -> dict[str, str]:
    pairs = f"""SELECT DISTINCT x.id AS t, y.id AS c FROM
      (SELECT id, b, sig[4 * b + 1:4 * b + 4] AS k FROM funcs, range(32) r(b) WHERE len(sig) = 128 AND complexity >= 4 AND shingles <> 0 AND name IS NULL) x
      JOIN (SELECT id, b, sig[4 * b + 1:4 * b + 4] AS k FROM funcs, range(32) r(b) WHERE len(sig) = 128 AND name IS NOT NULL {{gate}}) y USING (b, k)"""
    return {
        "effect_tokens": EFFECT_TOKENS,
        "trace_complexity": COMPLEXITY,
        "trace_shingles": SHINGLE_COUNTS,
        "fingerprints": fingerprints(),
        "fingerprint_drift": f"""
            SELECT f.id, CASE WHEN len(f.sig) = 128 THEN {AGREE.format(a="f.sig", b="n.sig")} ELSE 0 END::INTEGER AS equal_slots
            FROM funcs f JOIN ({fingerprints().replace("md5(string_agg", "(string_agg").replace(") AS sig_md5 FROM m", ") AS sig_md5 FROM m")}) x ON x.func_id = f.id,
            LATERAL (SELECT string_split(CASE WHEN x.shingles = 0 THEN array_to_string(list_transform(range(128), lambda i: '0'), ',') ELSE x.sig_md5 END, ',')::BIGINT[] AS sig) n
            WHERE f.sig IS DISTINCT FROM n.sig OR f.complexity <> x.complexity OR f.shingles <> x.shingles""",
        "band_keys": BANDS,
        "bands_stale": f"SELECT DISTINCT func_id, band, key FROM bands EXCEPT SELECT func_id, band, key FROM ({BANDS})",
        "bands_missing": f"SELECT func_id, band, key FROM ({BANDS}) EXCEPT SELECT func_id, band, key FROM bands",
        "well_formed": 'SELECT id, "binary", name, entry, source, complexity, shingles, capped FROM funcs WHERE len(sig) = 128 AND length("binary") <= 1048576 AND (name IS NULL OR length(name) <= 1048576) AND length(source) <= 1048576',
        "index_summary": 'SELECT "binary", count(*) AS functions, count(name) AS named, count(CASE WHEN complexity >= 4 THEN 1 END) AS usable FROM funcs GROUP BY "binary"',
        "escaped_names": f"SELECT id, {_ESCAPED} AS name, '0x' || CASE WHEN length(h) < 8 THEN lpad(h, 8, '0') ELSE h END AS entry FROM (SELECT *, lower(to_hex({_u('entry')}::UBIGINT)) AS h FROM funcs)",
        "signature_bytes": "SELECT id, md5(unhex(array_to_string(list_transform(sig, lambda x: list_reduce(list_transform(range(8), lambda k: substr(lpad(to_hex(x), 16, '0'), 15 - 2 * k, 2)), lambda p, q: p || q)), ''))) AS bytes_md5, true AS same FROM funcs WHERE len(sig) = 128",
        "lsh_candidates": f"SELECT t AS target_id, count(*) AS candidates FROM ({pairs.format(gate='AND complexity >= 4')}) GROUP BY t",
        "fallback_targets": f"SELECT id FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles <> 0 AND name IS NULL AND id NOT IN (SELECT t FROM ({pairs.format(gate='')}))",
        "best_matches": f"SELECT * FROM {best(_UNKNOWN, _KNOWN)}",
        "query_named": f"SELECT b.id, f.entry, guess, from_binary, similarity FROM {best(_UNKNOWN, _KNOWN)} b JOIN funcs f ON f.id = b.id WHERE similarity >= 0.7",
        "triage_hits": TRIAGE,
        "triage_counts": f"SELECT count(*) AS triaged, count(CASE WHEN verdict = 'vulnerable' THEN 1 END) AS vulnerable, count(CASE WHEN verdict = 'patched' THEN 1 END) AS patched, count(CASE WHEN verdict = 'inconclusive' THEN 1 END) AS inconclusive FROM ({TRIAGE})",
        "triage_queue": f"SELECT id, vuln_similarity, lead FROM ({TRIAGE}) WHERE verdict = 'vulnerable'",
        "match_detail": MATCH,
        "match_summary": "SELECT count(CASE WHEN status IN ('same', 'changed', 'low_signal') THEN 1 END) AS compared, "
        + ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in ("same", "changed", "low_signal", "only_a", "only_b"))
        + f" FROM ({MATCH})",
        "match_changed": f"SELECT name, similarity FROM ({MATCH}) WHERE status = 'changed' ORDER BY similarity, name LIMIT {C.CHANGES_SHOWN}",
        "match_only_a": f"SELECT name FROM ({MATCH}) WHERE status = 'only_a'",
        "match_only_b": f"SELECT name FROM ({MATCH}) WHERE status = 'only_b'",
        "eval_ranks": RANKS,
        "eval_summary": EVAL,
        "log_effects": capped(LOG_EFFECTS),
        "log_first_touches": capped(f"WITH {LOG} SELECT run, step, region, region_k FROM l WHERE touched"),
        "log_read_footprint": capped(f"WITH {LOG} SELECT run, step, region, region_k, off FROM l WHERE field_read"),
        "value_classes": f"SELECT {_WRITTEN} AS val, CASE {_WRITTEN} WHEN 'small_const' THEN v END AS val_k, count(*) AS n FROM (SELECT round(l_extendedprice * 100)::BIGINT - 3000000 AS v FROM lineitem) GROUP BY ALL",
        "offset_buckets": "SELECT greatest(-2048, least(2048, trunc(v / 8.0)::BIGINT * 8))::INTEGER AS bucket, count(*) AS n FROM (SELECT l_partkey * 3 - l_suppkey * 50 AS v FROM lineitem) GROUP BY ALL",
        "p6_found": f"SELECT field, key_text FROM ({P6_PROFILE}) WHERE n_rows >= 0.025 * (SELECT count(*) FROM funcs)",
        "p6_profile": P6_PROFILE,
        "p6_guess_join": "SELECT target, count(*) AS n_rows, sum(complexity)::BIGINT AS complexity FROM named n JOIN funcs f ON n.guess = f.name GROUP BY target",
    }
