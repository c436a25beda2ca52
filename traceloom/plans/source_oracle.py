"""SQL for the queries of ``traceloom.plans.source_queries``. Numbers are stated here once more, not taken from the engine."""

from __future__ import annotations

from traceloom.plans.oracle import _ESCAPED, _WRITTEN, AGREE, BANDS, LOG, LOG_EFFECTS, MATCH, TRIAGE, _i, _u, best, capped, fingerprints

_ALL = "name, entry, source, complexity, shingles, capped"
_MD5 = "md5(array_to_string(sig, ',')) AS sig_md5"
_OK = "len(sig) = 128"
_MOD = 1 << 64

# functions as the files built from ``funcs`` hold them
FOUND = """
f0 AS (SELECT *, bool_and(name IS NULL) OVER (PARTITION BY "binary") AS stripped FROM funcs),
f1 AS (
  SELECT "binary", nullif(name, '') AS name, entry, complexity AS size, id,
    CASE WHEN stripped THEN 'eh_frame' WHEN source = 'dynsym' THEN 'dynsym' ELSE 'symtab' END AS source
  FROM f0 WHERE complexity > 0 AND (stripped OR entry <> 0)
),
f AS (
  SELECT "binary", name, entry, size, source FROM (
    SELECT *, row_number() OVER (PARTITION BY "binary", entry ORDER BY name IS NULL, CASE source WHEN 'symtab' THEN 0 WHEN 'dynsym' THEN 1 ELSE 2 END, id) AS r FROM f1
  ) WHERE r = 1
)"""
# segments of those files
LOADS = """
b AS (SELECT DISTINCT "binary" FROM funcs),
s AS (
  SELECT "binary", 0 AS segment, 4194304::BIGINT AS vaddr, 32768::BIGINT AS mem_size FROM b
  UNION ALL SELECT "binary", 1, 0, 32768 FROM b WHERE length("binary") % 2 = 0
)"""
_INSIDE = "{x} >= s.vaddr AND {x} < s.vaddr + s.mem_size"


def _wrap(x: str) -> str:
    return f"((({x})::HUGEINT % {_MOD} + {_MOD}) % {_MOD})::UHUGEINT"


def _fill(seed: int) -> str:
    x = _wrap(f"base::HUGEINT + 8 * word + {seed * 0x9E3779B97F4A7C15 % _MOD}")
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        # the product of two numbers of 64 bits fits 128
        x = f"list_transform([{x}], lambda v: (xor(v, v // {1 << shift}) * {factor}::UHUGEINT) % {_MOD})[1]"
    last = f"list_transform([{x}], lambda v: xor(v, v // {1 << 31}))[1]"
    return f"list_transform([{last}], lambda v: {_i('v')})[1]"


_JUMPS = """
SELECT k, a, r, CASE WHEN r >= 2147483648 THEN r - 4294967296 ELSE r END AS wide, CASE WHEN r % 256 >= 128 THEN r % 256 - 256 ELSE r % 256 END AS short
FROM (SELECT o_orderkey::BIGINT AS k, o_orderkey::BIGINT * 4096 - 40960 AS a, (o_orderkey::BIGINT * 2654435761) % 4294967296 AS r FROM orders)
"""
_BRANCHES = f"""
{LOG}, i AS (
  SELECT run, step, k, CASE WHEN k % 3 <> 0 THEN 4194304 + (k * 5) % 64 END AS target, lead(addr) OVER (PARTITION BY run ORDER BY step) AS next FROM l WHERE event = 'insn'
), o AS (SELECT run, step, next = target AS taken FROM i WHERE k % 7 = 1 AND target IS NOT NULL AND next IS NOT NULL)
"""
_PLANS = f"""
WITH {_BRANCHES}, d AS (SELECT run, list(taken ORDER BY step)[1:2] AS dirs FROM o GROUP BY run),
r AS (SELECT run, coalesce(dirs, []) AS dirs FROM (SELECT DISTINCT run FROM l) LEFT JOIN d USING (run))
SELECT run, seed_ix::INTEGER AS seed_ix, path::INTEGER AS path,
  CASE path WHEN 0 THEN '' WHEN 1 THEN (NOT dirs[1])::VARCHAR ELSE dirs[1]::VARCHAR || ',' || (NOT dirs[2])::VARCHAR END AS plan
FROM r, range(4) s(seed_ix), range(3) p(path) WHERE path <= len(dirs)
"""
_REGION = "CASE x.region WHEN 'arg' THEN 'Arg(' || x.region_k || ')' WHEN 'stack' THEN 'Stack' WHEN 'global' THEN 'Global' ELSE 'Heapish' END"
_VALUE = (
    "CASE x.val WHEN 'input' THEN 'Input(' || x.val_k || ')' WHEN 'input_deriv' THEN 'InputDeriv(' || x.val_k || ')' WHEN 'small_const' THEN 'SmallConst(' || x.val_k || ')' "
    "WHEN 'zero' THEN 'Zero' WHEN 'big_const' THEN 'BigConst' ELSE 'Unknown' END"
)
_SYM = "'Sym(\"' || replace(replace(x.sym, '\\', '\\\\'), '\"', '\\\"') || '\")'"
DUMP = f"""
WITH top AS (SELECT name FROM funcs WHERE name <> '' GROUP BY name ORDER BY count(*) DESC, name LIMIT 1),
one AS (SELECT id FROM funcs JOIN top USING (name) ORDER BY {_u('entry')}, id LIMIT 1),
t AS (SELECT *, row_number() OVER (ORDER BY seed_ix, trace_id) - 1 AS path FROM traces WHERE func_id IN (SELECT id FROM one)),
e AS (SELECT path, x.seq AS seq, any_value(x) AS x FROM (SELECT path, unnest(effects) AS x FROM t) WHERE x.seq IS NOT NULL GROUP BY ALL),
n AS (SELECT path, count(*) AS n FROM e GROUP BY path),
lines AS (
  SELECT path, 0 AS line_no, '-- path ' || path || ' (' || coalesce(n, 0) || ' effects, instret ' || instret || ', capped ' || capped || ') --' AS name FROM t LEFT JOIN n USING (path)
  UNION ALL SELECT path, row_number() OVER (PARTITION BY path ORDER BY seq), '   ' || CASE x.kind
    WHEN 'write' THEN 'Write {{ region: ' || {_REGION} || ', off: ' || x.off || ', val: ' || {_VALUE} || ' }}' WHEN 'read' THEN 'Read {{ region: ' || {_REGION} || ', off: ' || x.off || ' }}'
    WHEN 'new_region' THEN 'NewRegion(' || {_REGION} || ')' WHEN 'call' THEN 'Call(' || coalesce({_SYM}, 'Anon') || ')' WHEN 'syscall' THEN 'Syscall(' || x.nr || ')'
    WHEN 'branch' THEN 'Branch' WHEN 'ret' THEN 'Ret(' || {_VALUE} || ')' ELSE 'Capped' END FROM e
)
SELECT path::INTEGER AS path, line_no::INTEGER AS line_no, {_ESCAPED} AS line FROM lines
"""
_MASKED = "SELECT k, CASE k % 5 WHEN 0 THEN w & 255 WHEN 1 THEN w & 65535 WHEN 2 THEN w & 4294967295 ELSE w END AS v FROM (SELECT o_orderkey::BIGINT AS k, o_orderkey::BIGINT * 37 - 5000 AS w FROM orders)"
_ADDRESSES = f"""
SELECT k, CASE k % 3 WHEN 0 THEN {0x10_0000_0000} + (k % 7) * {0x1_0000_0000} + (k * 13) % 40000 - 3000 WHEN 1 THEN {0x20_0000_0000} + (k * 97) % 300000 - 10000 ELSE k * 4099 - 8000 END AS a
FROM (SELECT o_orderkey::BIGINT AS k FROM orders)
"""
_LOST = """(
SELECT id AS trace_id, id AS func_id, true AS capped, [{'seq': 0, 'kind': 'capped', 'region': NULL::VARCHAR, 'region_k': NULL::INTEGER, 'off': NULL::INTEGER,
  'val': NULL::VARCHAR, 'val_k': NULL::BIGINT, 'sym': NULL::VARCHAR, 'nr': NULL::BIGINT}] AS effects FROM funcs WHERE id NOT IN (SELECT func_id FROM traces))"""
_STORED = f"""(
WITH {FOUND}, {LOADS}, i AS (SELECT DISTINCT f."binary", f.entry FROM f JOIN s ON s."binary" = f."binary" AND {_INSIDE.format(x='f.entry')})
SELECT t.trace_id, t.effects, t.capped, g."binary" || chr(0) || g.entry AS k FROM traces t JOIN funcs g ON g.id = t.func_id JOIN i ON i."binary" = g."binary" AND i.entry = g.entry)"""
_PAIRS = f"""SELECT DISTINCT t.id AS target_id, b.func_id FROM funcs t JOIN ({BANDS}) own ON own.func_id = t.id JOIN {{bands}} b ON b.band = own.band AND b.key = own.key
  WHERE len(t.sig) = 128 AND t.complexity >= 4 AND t.shingles <> 0 AND t.name IS NULL"""
_ENTRY_ORDER = _u("entry")


def oracle_sql() -> dict[str, str]:
    far = dict.fromkeys(("instructions", "visits", "effects", "reads", "heap_pages", "run_pages"), 1 << 30)
    tight = {
        "instructions": {"instructions": 30}, "visits": {"visits": 2}, "effects": {"effects": 40}, "told": {"reads": 10, "heap_pages": 3}, "run_pages": {"run_pages": 9},
    }
    mnemonics = "['call', 'callq', 'ret', 'retq', 'syscall', 'sysenter', 'int', 'int3', 'jmp', 'jmpq', 'je', 'jne', 'js', 'mov', 'nop', 'lea']"
    return {
        "elf_functions": f"WITH {FOUND} SELECT * FROM f",
        "elf_order": f'WITH {FOUND} SELECT "binary", entry, row_number() OVER (PARTITION BY "binary" ORDER BY {_ENTRY_ORDER}) - 1 AS place FROM f',
        "elf_segments": f'WITH {LOADS} SELECT "binary", segment, vaddr, 64 AS n_bytes, mem_size, true AS exec, false AS "write" FROM s',
        "elf_memory": f"""
            WITH {LOADS} SELECT "binary", segment, 32768 AS n_bytes, md5(unhex(repeat('90', 64) || repeat('00', 32704))) AS bytes_md5 FROM s""",
        "mapped_pages": f"""
            WITH p AS (SELECT DISTINCT "binary", unnest(range(a // 4096, (a + complexity * 300 - 1) // 4096 + 1)) AS p FROM
              (SELECT "binary", complexity, ({_u("entry")} % {1 << 62})::BIGINT AS a FROM funcs WHERE complexity > 0)),
            g AS (SELECT *, p - row_number() OVER (PARTITION BY "binary" ORDER BY p) AS g FROM p)
            SELECT "binary", min(p) * 4096 + CASE WHEN min(p) >= {1 << 49} THEN -{1 << 62} ELSE 0 END AS first, count(*) AS n_pages FROM g GROUP BY "binary", g""",
        "elf_indexable": f'WITH {FOUND}, {LOADS} SELECT "binary", entry FROM f WHERE EXISTS (SELECT 1 FROM s WHERE s."binary" = f."binary" AND {_INSIDE.format(x="f.entry")})',
        "elf_refused": """
            SELECT "binary", CASE length("binary") % 6 WHEN 0 THEN 'no segment is loaded' WHEN 1 THEN 'a segment of 1073741825 bytes is over the limit'
              WHEN 2 THEN 'a segment runs past the address space' WHEN 3 THEN 'the segments together are over the limit' ELSE 'machine 40 isn''t x86-64' END AS error
            FROM (SELECT DISTINCT "binary" FROM funcs) WHERE length("binary") % 6 < 5""",
        "deduplicated_functions": """
            SELECT "binary", entry, name FROM (SELECT "binary", entry, nullif(name, '') AS name, row_number() OVER (PARTITION BY "binary", entry
              ORDER BY nullif(name, '') IS NULL, CASE source WHEN 'symtab' THEN 1 WHEN 'dynsym' THEN 2 WHEN 'eh_frame' THEN 3 ELSE 99 END, nullif(name, '') NULLS FIRST, complexity DESC) AS r FROM funcs) WHERE r = 1""",
        "named_calls": """
            SELECT c.b AS "binary", c.target, min(f.name) AS sym FROM (SELECT DISTINCT from_binary AS b, entry AS target FROM named WHERE entry IS NOT NULL) c
            LEFT JOIN funcs f ON f."binary" = c.b AND f.entry = c.target GROUP BY c.b, c.target""",
        "address_segments": f"""
            WITH {LOADS}, a AS (SELECT id, "binary", xor(entry, 16384) AS addr FROM funcs)
            SELECT id, min(s.segment)::INTEGER AS segment, count(s.segment) > 0 AS in_segment FROM a LEFT JOIN s ON s."binary" = a."binary" AND {_INSIDE.format(x="a.addr")} GROUP BY id""",
        "image_rows": f"""SELECT "binary", {_ALL.replace("source", "'symtab' AS source")}, {_MD5} FROM funcs WHERE {_OK}""",
        "corpus_rows": f'SELECT "binary", {_ALL}, {_MD5} FROM funcs WHERE {_OK}',
        "corpus_bands": f"SELECT band, count(*) AS n_rows, count(DISTINCT key) AS n_keys, (SELECT count(*) FROM funcs WHERE {_OK})::INTEGER AS functions FROM ({BANDS}) GROUP BY band",
        "stored_candidates": f"SELECT p.target_id, p.func_id FROM ({_PAIRS.format(bands='bands')}) p JOIN funcs f ON f.id = p.func_id WHERE len(f.sig) = 128",
        "ungated_candidates": f"SELECT target_id, count(*) AS candidates FROM ({_PAIRS.format(bands=f'({BANDS})')}) GROUP BY target_id",
        "checked_rows": f"SELECT id, {_MD5} FROM funcs WHERE {_OK}",
        "index_totals": "SELECT count(*) AS functions, count(name) AS named, count(CASE WHEN complexity >= 4 THEN 1 END) AS usable FROM funcs",
        "known_sources": "SELECT source, source IN ('symtab', 'dynsym', 'eh_frame') AS known, count(*) AS n FROM funcs GROUP BY source",
        "trace_fingerprints": f"SELECT func_id AS trace_id, complexity, shingles, capped, sig_md5 FROM ({fingerprints('traces', 'trace_id')})",
        "trace_shingle_sets": f"""
            {fingerprints("traces", "trace_id").split("p(slot, a, b)")[0].rstrip().rstrip(",")}
            SELECT func_id AS trace_id, count(*)::INTEGER AS n, md5(string_agg(v::VARCHAR, ',' ORDER BY v)) AS shingles_md5 FROM (SELECT func_id, {_i("x")} AS v FROM w JOIN g USING (g)) GROUP BY func_id""",
        "failed_fingerprints": fingerprints(_LOST),
        "streamed_fingerprints": f"SELECT func_id, complexity, capped, sig_md5 FROM ({fingerprints('(SELECT * FROM traces WHERE len(list_filter(effects, lambda x: x.seq IS NOT NULL)) > 0)')})",
        "index_from_traces": f"""
            SELECT f.id, f."binary", f.name, f.entry, f.source, n.complexity, n.shingles, n.capped, n.sig_md5 FROM funcs f JOIN ({fingerprints()}) n ON n.func_id = f.id""",
        "index_from_files": f"""
            SELECT f."binary", f.name, f.entry, f.source, n.complexity, n.shingles, n.capped, n.sig_md5
            FROM (WITH {FOUND} SELECT * FROM f) f JOIN ({fingerprints(_STORED, "k")}) n ON n.func_id = f."binary" || chr(0) || f.entry""",
        "similarities": f"""
            WITH first AS (SELECT "binary", arg_min(sig, id) AS first FROM funcs WHERE len(sig) > 0 GROUP BY "binary")
            SELECT id, coalesce(CASE WHEN len(sig) = len(first) AND len(sig) > 0 THEN {AGREE.format(a="sig", b="first")} / len(sig) END, 0.0)::DOUBLE AS similarity FROM funcs LEFT JOIN first USING ("binary")""",
        "dump_lines": DUMP,
        "log_effects_tight": " UNION ALL ".join(f"SELECT *, '{name}' AS \"limit\" FROM ({capped(LOG_EFFECTS, **(far | caps))})" for name, caps in tight.items()),
        "log_effects_uncapped": capped(LOG_EFFECTS, **far),
        "branch_outcomes": capped(f"WITH {_BRANCHES} SELECT * FROM o"),
        "exploration_plans": capped(_PLANS),
        "instruction_kinds": f"""
            SELECT m AS mnemonic, CASE WHEN m IN ('call', 'callq') THEN 'call' WHEN m IN ('ret', 'retq') THEN 'ret' WHEN m IN ('syscall', 'sysenter', 'int') THEN 'syscall'
              WHEN m IN ('je', 'jne', 'js', 'jmpq') THEN 'branch' ELSE 'plain' END AS kind, count(*) AS n FROM (SELECT ({mnemonics})[event_id % 17 + 1] AS m FROM events) GROUP BY ALL""",
        "jump_targets": f"""
            SELECT k, CASE WHEN k % 4 = 0 THEN {_i(_wrap("a + 5 + wide"))} END AS call_target,
              CASE k % 4 WHEN 1 THEN {_i(_wrap("a + 2 + short"))} WHEN 2 THEN {_i(_wrap("a + 6 + wide"))} END AS branch_target FROM ({_JUMPS})""",
        "register_results": f"""
            SELECT c AS counter, {_i("p")} AS call_result, xor(c, {0x6666 << 48}) AS syscall_result
            FROM (SELECT event_id::BIGINT AS c, xor((event_id::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {_MOD}, {0x5555 << 48}::UHUGEINT) AS p FROM events)""",
        "page_fill": f"""
            SELECT base, word, {", ".join(f"{_fill(s)} AS seed_{n}" for n, s in enumerate((0, 0x9E3779B9, 0x12345678, 0xDEADBEEF)))}
            FROM (SELECT o_orderkey::BIGINT * 4096 AS base, (o_custkey % 512)::INTEGER AS word FROM orders)""",
        "masked_values": f"SELECT k, {_WRITTEN} AS val, CASE {_WRITTEN} WHEN 'small_const' THEN v END AS val_k FROM ({_MASKED})",
        "address_classes": f"""
            SELECT k, CASE WHEN g BETWEEN 0 AND 5 AND o < 32768 THEN 'arg' WHEN s BETWEEN 0 AND 262143 THEN 'stack' WHEN k % 5 = 0 THEN 'global' ELSE 'heapish' END AS region,
              CASE WHEN g BETWEEN 0 AND 5 AND o < 32768 THEN g END::INTEGER AS region_k,
              CASE WHEN g BETWEEN 0 AND 5 AND o < 32768 THEN o WHEN s BETWEEN 0 AND 262143 THEN s - 131072 WHEN k % 5 = 0 THEN 0 ELSE a & 4095 END AS off
            FROM (SELECT k, a, floor((a - {0x10_0000_0000}) / {0x1_0000_0000})::BIGINT AS g, (a - {0x10_0000_0000}) & {0xFFFF_FFFF} AS o, a - {0x20_0000_0000} AS s FROM ({_ADDRESSES}))""",
        "query_order": f"""
            SELECT row_number() OVER (ORDER BY similarity DESC, {_u("f.entry")}, f.id) AS place, f.id
            FROM {best("name IS NULL", "name IS NOT NULL")} b JOIN funcs f ON f.id = b.id WHERE similarity >= 0.7""",
        "triage_order": f"""
            SELECT row_number() OVER (ORDER BY CASE verdict WHEN 'vulnerable' THEN 0 WHEN 'inconclusive' THEN 1 ELSE 2 END, vuln_similarity DESC, {_ENTRY_ORDER}, id) AS place, id, verdict FROM ({TRIAGE})""",
        "match_order": f"""
            SELECT 'changed' AS list, row_number() OVER (ORDER BY similarity, name) AS place, name FROM ({MATCH}) WHERE status = 'changed'
            UNION ALL SELECT status, row_number() OVER (PARTITION BY status ORDER BY name), name FROM ({MATCH}) WHERE status IN ('only_a', 'only_b')""",
    }
