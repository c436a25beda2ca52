"""SQL for the queries that SQL can express over whole tables."""

P1_PAIRS = """
WITH e AS (
  SELECT id, "binary" AS b, sig, hash(sig) AS h FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles > 0
), p AS (
  SELECT x.id AS x, y.id AS y, x.b AS xb, y.b AS yb,
    len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) AS agree
  FROM e x JOIN e y ON x.id < y.id
)
SELECT * FROM p WHERE agree >= 113
"""

P3_FOUND = """
WITH e AS (
  SELECT id, sig FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles > 0
), p AS (
  SELECT x.id AS x, y.id AS y, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) AS agree FROM e x JOIN e y ON x.id <> y.id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY agree DESC, y) AS k FROM p WHERE agree >= 90
)
SELECT x AS id, y AS neighbour_id FROM r WHERE k <= 5
"""

P1_GROUPS = f"""
WITH RECURSIVE n AS (SELECT id, min(id) OVER (PARTITION BY sig) AS class_id FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles > 0),
p AS MATERIALIZED ({P1_PAIRS}),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT n.id, n.class_id, g.group_id FROM n JOIN (SELECT a, min(b) AS group_id FROM r GROUP BY a) g ON g.a = n.id
"""

P2_RANKED = """
WITH valid AS (
  SELECT target, entry, guess, from_binary, similarity + 0.0 AS similarity, min(named_id) AS named_id
  FROM named
  WHERE entry IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0 AND 1
  GROUP BY target, entry, guess, from_binary, similarity + 0.0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target, entry
    ORDER BY similarity DESC, guess ASC NULLS LAST, from_binary ASC NULLS LAST, named_id ASC) AS "rank"
  FROM valid
)
SELECT target, entry, named_id, similarity, guess, from_binary, "rank"::INTEGER AS "rank" FROM ranked WHERE "rank" <= 3
"""

_FREQUENT = "(SELECT p FROM l{k} JOIN traces USING (trace_id) GROUP BY p HAVING count(DISTINCT func_id) >= (SELECT least FROM bound))"
_LONGER = """
l{n} AS MATERIALIZED (
  SELECT l.trace_id, l.p || ' > ' || s.step AS p, min(s.seq) AS e FROM l{k} l JOIN s ON s.trace_id = l.trace_id AND s.seq > l.e
  WHERE l.p IN {frequent} GROUP BY ALL
)"""
P4_SUPPORTS = f"""
WITH bound AS (SELECT greatest(10, ceil(0.025 * count(DISTINCT func_id) - 1e-9)) AS least FROM traces),
e0 AS (SELECT trace_id, unnest(effects) AS x FROM traces),
e1 AS (SELECT trace_id, x.seq AS seq, any_value(x) AS x FROM e0 WHERE x.seq IS NOT NULL GROUP BY ALL),
s0 AS (
  SELECT trace_id, seq, CASE WHEN x.kind = 'call' THEN x.sym ELSE 'sys:' || x.nr END AS step FROM e1
  WHERE (x.kind = 'call' AND x.sym IS NOT NULL) OR (x.kind = 'syscall' AND x.nr IS NOT NULL)
),
l1 AS MATERIALIZED (SELECT trace_id, step AS p, min(seq) AS e FROM s0 GROUP BY ALL),
s AS MATERIALIZED (SELECT * FROM s0 WHERE step IN {_FREQUENT.format(k=1)}),
{",".join(_LONGER.format(n=n, k=n - 1, frequent=_FREQUENT.format(k=n - 1)) for n in (2, 3, 4))}
SELECT p AS pattern, count(DISTINCT func_id) AS support FROM (SELECT * FROM l3 UNION ALL SELECT * FROM l4) JOIN traces USING (trace_id)
GROUP BY p HAVING count(DISTINCT func_id) >= (SELECT least FROM bound)
"""

P5_RUNS = """
WITH e AS (
  SELECT trace_id, unnest(effects) AS x FROM traces
), o AS (
  SELECT trace_id, x.seq AS seq, any_value(x) AS x FROM e WHERE x.seq IS NOT NULL GROUP BY trace_id, x.seq
), l AS (
  SELECT trace_id, seq, x.ic AS ic, struct_pack(a := x.kind, b := x.region, c := x.region_k, d := x.val, e := x.sym, f := x.nr) AS k,
    lag(struct_pack(a := x.kind, b := x.region, c := x.region_k, d := x.val, e := x.sym, f := x.nr)) OVER w AS before,
    row_number() OVER w AS n
  FROM o WINDOW w AS (PARTITION BY trace_id ORDER BY seq)
), g AS (
  SELECT *, sum(CASE WHEN n > 1 AND k.a IS NOT DISTINCT FROM before.a AND k.b IS NOT DISTINCT FROM before.b
      AND k.c IS NOT DISTINCT FROM before.c AND k.d IS NOT DISTINCT FROM before.d AND k.e IS NOT DISTINCT FROM before.e
      AND k.f IS NOT DISTINCT FROM before.f THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY seq) AS run
  FROM l
)
SELECT trace_id, min(seq)::INTEGER AS first_seq, max(seq)::INTEGER AS last_seq, count(*)::BIGINT AS n_effects,
  (arg_max(ic, seq) - arg_min(ic, seq))::BIGINT AS duration,
  arg_min(k, seq).a AS kind, arg_min(k, seq).b AS region, arg_min(k, seq).c AS region_k, arg_min(k, seq).d AS val,
  arg_min(k, seq).e AS sym, arg_min(k, seq).f AS nr
FROM g GROUP BY trace_id, run
"""

P9_FOUND = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents
), u AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS u FROM w WHERE len(w) >= 20
)
SELECT doc_id FROM u WHERE 1 - len(list_distinct(u))::DOUBLE / len(u) >= 0.4
"""

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}"
_EDGE = "chr(32) || chr(9) || chr(10) || chr(13)"
_STOP = {
    "en": "the be to of and that have with a in is for it on this not from when", "de": "der die das und zu in nicht ist den mit von für auf ein eine wenn im bei",
    "fr": "le la les de des et un une du en pour dans que est pas sur avec au", "es": "el la los de y que en un una por con para no es se del al las",
    "ru": "и в не на с что по для из к при если от это как или без до", "zh": "的 了 是 在 和 不 有 中 时 为 当 与 以 对 从 到 个 这", "ja": "の を に は が と で た し て な も る す い か ら れ",
}


def _units_of(cut: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(t, '{cut}'), lambda x: trim(x, {_EDGE})), lambda x: x <> '')"


def _lengths(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda x: length(x)))::DOUBLE"


def _windowed(x: str, n: str) -> str:
    return f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n} - 1], ' '))"


def _once(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct({x}))::DOUBLE / len({x}) END"


P9_MEASURES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w,
    regexp_extract_all(t, '[{_UNSPACED}]|[^ \\t\\n\\r{_UNSPACED}]+') AS u, length(regexp_replace(t, '[^{_UNSPACED}]+', '', 'g')) AS c,
    {_units_of("\\r\\n|\\n|\\r")} AS l, {_units_of("(?:\\r\\n|\\n|\\r)[ \\t]*(?:\\r\\n|\\n|\\r)")} AS g, {_units_of("[.!?。！？]+|\\n")} AS s FROM d
),
v AS (SELECT *, CASE WHEN c * 2 >= len(u) THEN 10 ELSE 5 END AS n, list_distinct(list_transform(u, lambda x: lower(x))) AS k FROM p),
m AS (
  SELECT doc_id, len(u)::INTEGER AS n_units, CASE WHEN len(u) = 0 THEN 0.0::DOUBLE ELSE {_lengths("u")} / len(u) END AS mean_unit_chars,
    CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(t, '[\\p{{L}}\\p{{N}} \\t\\n\\r]', '', 'g'))::DOUBLE / length(t) END AS symbol_ratio,
    greatest({", ".join(f"len(list_intersect(k, string_split('{x}', ' ')))" for x in _STOP.values())})::INTEGER AS stop_words,
    {", ".join(f"CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE 1 - {_lengths(f'list_distinct({x})')} / {_lengths(x)} END AS {name}_chars" for x, name in (("l", "line"), ("g", "paragraph"), ("s", "sentence")))},
    CASE WHEN len(w) < 5 THEN 0.0::DOUBLE ELSE {_once(_windowed("w", "5"))} END AS window_share, CASE WHEN len(u) < n THEN 0.0::DOUBLE ELSE {_once(_windowed("u", "n"))} END AS unit_share FROM v
),
r AS (SELECT *, greatest(line_chars, paragraph_chars, sentence_chars, unit_share) AS repeated_share FROM m)
SELECT *, array_to_string(list_filter([
  CASE WHEN n_units < 20 OR n_units > 100000 THEN 'length' END, CASE WHEN mean_unit_chars < 1 OR mean_unit_chars > 12 THEN 'unit_length' END,
  CASE WHEN symbol_ratio > 0.35 THEN 'symbols' END, CASE WHEN stop_words < 1 THEN 'stop_words' END, CASE WHEN line_chars > 0.3 THEN 'repeated_lines' END,
  CASE WHEN paragraph_chars > 0.3 THEN 'repeated_paragraphs' END, CASE WHEN sentence_chars > 0.3 THEN 'repeated_sentences' END, CASE WHEN window_share >= 0.4 THEN 'repeated_words' END,
  CASE WHEN unit_share >= 0.4 THEN 'repeated_units' END, CASE WHEN repeated_share >= 0.4 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') AS broken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT x AS id_a, y AS id_b FROM ({P1_PAIRS}) WHERE xb <> yb",
        "p1_links": f"""
            WITH p AS ({P1_PAIRS}), e AS (SELECT id, sig FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles > 0),
            l AS (SELECT i, count(*) AS n FROM (SELECT x AS i FROM p UNION ALL SELECT y FROM p) GROUP BY i)
            SELECT id, min(id) OVER (PARTITION BY sig) AS class_id, coalesce(n, 0)::BIGINT AS links FROM e LEFT JOIN l ON l.i = e.id""",
        "p1_class_pairs": f"""
            WITH e AS (SELECT id, sig, min(id) OVER (PARTITION BY sig) AS rep FROM funcs WHERE len(sig) = 128 AND complexity >= 4 AND shingles > 0)
            SELECT x AS rep_a, y AS rep_b, agree::INTEGER AS agree FROM ({P1_PAIRS}) WHERE agree < 128
            AND x IN (SELECT rep FROM e) AND y IN (SELECT rep FROM e)""",
        "p1_groups": P1_GROUPS,
        "p3_found": P3_FOUND,
        "p3_recall": f"SELECT count(DISTINCT id) AS queries, count(*) AS wanted, true AS enough FROM ({P3_FOUND}) WHERE id % 100 = 0",
        "p4_found": f"SELECT pattern FROM ({P4_SUPPORTS})",
        "p4_supports": P4_SUPPORTS,
        "p2_found": f"SELECT named_id FROM ({P2_RANKED})",
        "p2_ranked": P2_RANKED,
        "p5_found": f"SELECT trace_id, first_seq, last_seq FROM ({P5_RUNS}) WHERE n_effects >= 3",
        "p5_collapsed": P5_RUNS,
        "p5_event_rows": P5_RUNS,
        "p7_offsets": "SELECT doc_id, 0 AS first_char, length(coalesce(text, ''))::BIGINT AS last_char, 0 AS gaps FROM documents",
        "p7_round_trip": "SELECT doc_id FROM documents WHERE false",
        "p8_rules": """
            SELECT batches, rule, CASE WHEN rule = 'documents' THEN (SELECT count(*) FROM documents) ELSE 0 END AS n
            FROM (VALUES ('top_up'), ('in_bucket')) b(batches), (VALUES ('documents'), ('missing'), ('cut_small'), ('torn'), ('overfull')) r(rule)""",
        "p9_found": P9_FOUND,
        "p9_measures": P9_MEASURES,
    }
