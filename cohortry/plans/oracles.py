"""The registered queries in SQL for another engine, which checks them."""

from __future__ import annotations

import itertools

from ..operators.rules import PROTOTYPES, SEVERITY_SCALE, SYMPTOMS
from .encounter import PHRASES


def _unit(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '|{salt}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def _mod(key: str, salt: str, n: int) -> str:
    tail = f" || '|{salt}'" if salt else ""
    return f"(('0x' || substr(md5({key}::VARCHAR{tail}), 1, 6))::BIGINT % {n})"


_WS = r"'[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, {_WS}, ' ', 'g'))"


_NUMERIC = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 6) AS min, "
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS p{n}" for n, q in (("01", 0.01), ("05", 0.05), ("50", 0.5), ("95", 0.95), ("99", 0.99)))
    + f", round(max({c}), 6) AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)

_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM j"
    for i, c in enumerate(("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))
)

_CATEGORY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM part) AS n_unique, (SELECT count(*) - count({c}) FROM part) AS missing_count, 0.0::DOUBLE AS missing_pct,
  (SELECT string_agg(v || ': ' || n, ' | ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_values"""
    for c in ("p_brand", "p_type")
)


def _overlap(a: str, ka: str, b: str, kb: str) -> str:
    return f"""SELECT '{a}' AS left_table, '{b}' AS right_table, l AS left_unique, r AS right_unique, i AS intersection,
  round(100.0 * i / l, 6) AS left_coverage_pct, round(100.0 * i / r, 6) AS right_coverage_pct
FROM (SELECT (SELECT count(DISTINCT {ka}) FROM {a}) AS l, (SELECT count(DISTINCT {kb}) FROM {b}) AS r,
  (SELECT count(*) FROM (SELECT {ka} FROM {a} INTERSECT SELECT {kb} FROM {b})) AS i)"""


_PATTERNS = {"mentions_license": r"\blicense\b", "mentions_token": "token", "mentions_digits": "[0-9]{4}", "mentions_shout": "!!"}
_SCAN = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{n}' AS pattern, count(*) FILTER (regexp_matches(lower({c}), '{p}')) AS count FROM documents" for c in ("text", "source") for n, p in _PATTERNS.items())


def _hits(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{t}')::INT::DOUBLE" for t in terms) + ")"


_NOTES = "notes AS (SELECT c_custkey, concat_ws(' ', " + ", ".join(f"CASE WHEN c_custkey % {d} = 0 THEN '{p}' END" for d, p in PHRASES) + ") AS note FROM customer)"
_SEV = r"CASE WHEN regexp_matches(note, '\bmild\b') THEN 'mild' WHEN regexp_matches(note, '\bmoderate\b') THEN 'moderate' WHEN regexp_matches(note, '\bsevere\b|\bextreme\b|\bmarked\b') THEN 'severe' ELSE 'unknown' END"
_ONSET = r"CASE WHEN regexp_matches(note, '\bsudden\b|\bacute\b') THEN 'sudden' WHEN regexp_matches(note, '\b\d+\s*hours?\b|\bthis evening\b|\btoday\b') THEN 'hours' WHEN regexp_matches(note, '\b\d+\s*days?\b|\bfor days\b') THEN 'days' ELSE 'unknown' END"
_SYM = {n: "|".join(f"(?:{p})" for p in ps) for n, ps, _ in SYMPTOMS}
_TRIPLES = f"WITH {_NOTES}, s AS (SELECT *, {_SEV} AS severity, {_ONSET} AS onset_timing FROM notes) " + " UNION ALL ".join(f"SELECT c_custkey, '{n}' AS symptom, severity, onset_timing FROM s WHERE regexp_matches(note, '{p}')" for n, p in _SYM.items())
_SCALE = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_SCALE.items()) + " END"


def _prototypes() -> str:
    v = ", ".join(f"CASE WHEN regexp_matches(note, '{_SYM[n]}') THEN {w} * {_SCALE} ELSE 0.0 END AS x{i}" for i, (n, _, w) in enumerate(SYMPTOMS))
    norm = "sqrt(" + " + ".join(f"x{i} * x{i}" for i in range(10)) + ")"
    sims = []
    for k, spec in enumerate(PROTOTYPES.values()):
        pn = sum(x * x for x in spec.values()) ** 0.5
        dots = " + ".join(f"x{i} * {spec[n]}" for i, (n, *_) in enumerate(SYMPTOMS) if n in spec)
        sims.append(f"CASE WHEN {norm} > 0 THEN ({dots}) / ({norm} * {pn!r}) ELSE 0.0 END AS s{k}")
    evidence = " + ".join(f"(x{i} > 0)::BIGINT" for i in range(10))
    names = list(PROTOTYPES)
    return f"""WITH {_NOTES}, s AS (SELECT *, {_SEV} AS severity FROM notes), v AS (SELECT c_custkey, {v} FROM s),
m AS (SELECT c_custkey, {evidence} AS evidence, {', '.join(sims)} FROM v),
g AS (SELECT *, greatest(s0, s1, s2) AS mx, 0.7 * greatest(s0, s1, s2) + 0.3 * least(evidence / 5.0, 1.0) AS conf FROM m)
SELECT c_custkey, evidence::BIGINT AS evidence, round(mx, 6) AS max_similarity, round(conf, 6) AS confidence,
  CASE WHEN mx < 0.35 OR evidence < 2 THEN 'No_Party_Drug' WHEN s0 = mx THEN '{names[0]}' WHEN s1 = mx THEN '{names[1]}' ELSE '{names[2]}' END AS label,
  NOT (mx < 0.35 OR evidence < 2) AND conf < 0.55 AS residual FROM g"""


_CELLS = """items AS (
  SELECT user_id, ts, event_id, (hour(ts) * 60 + minute(ts))::DOUBLE AS m, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value::DECIMAL(18,4)::DOUBLE END AS v, event_type AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"""


def _nested(full: bool) -> str:
    cols = {
        "n_events": "count(*)::DOUBLE", "minute_min": "min(m)", "minute_max": "max(m)", "minute_span": "max(m) - min(m)",
        "value_mean": "avg(v)", "value_min": "min(v)", "value_max": "max(v)", "value_last": "last(v ORDER BY r) FILTER (v IS NOT NULL)",
        "value_delta": "(last(v ORDER BY r) FILTER (v IS NOT NULL)) - (first(v ORDER BY r) FILTER (v IS NOT NULL))",
        "event_type_nunique": "count(DISTINCT t)::DOUBLE", "event_type_count_click": "(count(*) FILTER (t = 'click'))::DOUBLE", "event_type_count_purchase": "(count(*) FILTER (t = 'purchase'))::DOUBLE",
    }
    if full:
        cols |= {"minute_mean": "avg(m)", "minute_std": "stddev_pop(m)", "value_std": "stddev_pop(v)", "value_first": "first(v ORDER BY r) FILTER (v IS NOT NULL)", "event_type_non_null": "count(t)::DOUBLE"}
    return f"WITH {_CELLS} SELECT user_id, " + ", ".join(f"round({e}, 6) AS ev__{n}" for n, e in cols.items()) + " FROM items GROUP BY user_id"


_K = "(props->>'k')::INT"
_EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _knn(where: str, k: int) -> str:
    return f"""WITH {_EMB}, d AS (SELECT q.vec_id, list_distance(q.v, f.v) AS d FROM e q CROSS JOIN e f {where}),
r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d)
SELECT vec_id, round(avg(d), 6) AS knn_distance FROM r WHERE r <= {k} GROUP BY vec_id"""


_CENTERS = """l AS (SELECT vec_id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e),
c AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM l GROUP BY 1, 2) GROUP BY 1)"""

def _lloyd(source: str, seed: int, k: int, rounds: int, dim: int, tag: str) -> str:
    """Tables of k-means over ``source`` (vec_id, v): ``{tag}c`` are the last centers (i, v), ``{tag}a`` the rows with their center i and squared distance d."""
    out = [f"{tag}0 AS (SELECT 0 AS i, arg_min(v, ({_unit('vec_id', f'{seed}|0')}, vec_id)) AS v FROM {source})"]
    for j in range(1, k):
        u = _unit("vec_id", f"{seed}|{j}")
        out.append(f"{tag}{j} AS MATERIALIZED (SELECT * FROM {tag}{j - 1} UNION ALL SELECT {j}, arg_min(v, (-ln(u) / d, vec_id)) FROM (SELECT vec_id, e.v, {u} AS u, min(list_distance(e.v, c.v) ** 2) AS d FROM {source} e, {tag}{j - 1} c GROUP BY 1, 2) WHERE d > 0)")
    near = lambda c: f"SELECT vec_id, e.v, i, list_distance(e.v, c.v) ** 2 AS d FROM {source} e, {c} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1"
    last = f"{tag}{k - 1}"
    for r in range(rounds):
        out.append(f"{tag}m{r} AS MATERIALIZED (SELECT i, list(m ORDER BY p) AS v FROM (SELECT i, p, avg(v[p]) AS m FROM ({near(last)}), range(1, {dim + 1}) s(p) GROUP BY 1, 2) GROUP BY 1)")
        last = f"{tag}m{r}"
    return ",\n".join([*out, f"{tag}a AS MATERIALIZED ({near(last)})"])


def _ensemble() -> str:
    seeds = (13, 47, 97)
    runs = ",\n".join(_lloyd("e", s, 3, 8, 64, f"k{s}_") for s in seeds)
    costs = " UNION ALL ".join(f"SELECT {n} AS run, sum(d) AS cost FROM k{s}_a" for n, s in enumerate(seeds))
    rows = " UNION ALL ".join(f"SELECT {n} AS run, vec_id, i::INT AS cluster FROM k{s}_a" for n, s in enumerate(seeds))
    return f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),\n{runs},\nbest AS (SELECT arg_min(run, (cost, run)) AS run FROM ({costs}))\nSELECT vec_id, cluster FROM ({rows}) JOIN best USING (run)"


def _mixture(rounds: int = 10) -> str:
    """Components (i, w, mx, my, a, b, c): weight, means, and the covariance ((a, b), (b, c))."""
    state = lambda source: f"""SELECT i, n / total AS w, mx, my, a + 1e-6 AS a, b, c + 1e-6 AS c FROM (SELECT i, n, mx, my, sum(n) OVER () AS total, sum_a / n AS a, sum_b / n AS b, sum_c / n AS c
  FROM (SELECT i, sum(r) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(r * (v[1] - mx) ** 2) AS sum_a, sum(r * (v[1] - mx) * (v[2] - my)) AS sum_b, sum(r * (v[2] - my) ** 2) AS sum_c
  FROM (SELECT *, sum(r * v[1]) OVER (PARTITION BY i) / sum(r) OVER (PARTITION BY i) AS mx, sum(r * v[2]) OVER (PARTITION BY i) / sum(r) OVER (PARTITION BY i) AS my FROM {source}) GROUP BY i))"""  # noqa: E731
    share = lambda c: f"""SELECT vec_id, v, i, exp(g - max(g) OVER o) / sum(exp(g)) OVER o * exp(max(g) OVER o) AS r, g FROM (SELECT vec_id, v, i,
  ln(w) - 0.5 * ln(a * c - b * b) - 0.5 * (c * (v[1] - mx) ** 2 - 2 * b * (v[1] - mx) * (v[2] - my) + a * (v[2] - my) ** 2) / (a * c - b * b) AS g FROM e, {c}) WINDOW o AS (PARTITION BY vec_id)"""  # noqa: E731
    out = [f"e AS (SELECT vec_id, embedding[1:2]::DOUBLE[] AS v FROM embeddings)", _lloyd("e", 42, 3, 8, 2, "g"), f"s0 AS MATERIALIZED ({state('(SELECT vec_id, v, i, 1.0::DOUBLE AS r FROM ga)')})"]
    out += [f"s{n + 1} AS MATERIALIZED ({state(f'({share(f"s{n}")})')})" for n in range(rounds)]
    return "WITH " + ",\n".join(out) + f"\nSELECT vec_id, i::INT AS cluster FROM ({share(f's{rounds}')}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, i) = 1"


_STAGE1 = f"""d AS (SELECT doc_id, (doc_id % 7 - 3)::DOUBLE AS h, {_unit('doc_id', 'dp')} AS dp, {_unit('doc_id', 'dn')} AS dn, {_unit('doc_id', 'k')} AS k FROM documents),
r AS (SELECT *, (dn - dp) / greatest(abs(dn) + abs(dp), 1e-6) AS rel FROM d),
z AS (SELECT doc_id, h, 0.55 * (h - avg(h) OVER ()) / stddev_pop(h) OVER () + 0.30 * (rel - avg(rel) OVER ()) / stddev_pop(rel) OVER () - 0.15 * (k - avg(k) OVER ()) / stddev_pop(k) OVER () AS s FROM r)"""

_BASE = _mod("doc_id", "", 3)
_VOTERS = f"voters AS (SELECT doc_id, {_BASE} AS base, " + ", ".join(f"CASE WHEN {_mod('doc_id', f'm{m}', 10)} < 8 THEN ({_BASE} + {m}) % 3 ELSE {_mod('doc_id', f'm{m}', 10)} % 3 END AS m{m}" for m in range(5)) + " FROM documents)"
_PERMS = list(itertools.permutations(range(3)))


def _matches(m: int) -> str:
    return " UNION ALL ".join(f"SELECT 'm{m}' AS model, {i} AS ordinal, '{''.join(map(str, p))}' AS permutation, count(*) FILTER (m0 = CASE m{m} WHEN 0 THEN {p[0]} WHEN 1 THEN {p[1]} ELSE {p[2]} END) AS matches FROM voters" for i, p in enumerate(_PERMS))


_ALIGN = " UNION ALL ".join(_matches(m) for m in range(5))
_ALIGNED = f"""{_VOTERS}, ms AS ({_ALIGN}), best AS (SELECT model, permutation AS p FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY matches DESC, ordinal) AS r FROM ms) WHERE r = 1),
al AS (SELECT doc_id, """ + ", ".join(f"substr((SELECT p FROM best WHERE model = 'm{m}'), (m{m} + 1)::BIGINT, 1)::INT AS a{m}" for m in range(5)) + " FROM voters)"
_SHARE = lambda c, p: "(" + " + ".join(f"({p}{m} = {c})::INT" for m in range(5)) + ") / 5.0"


def _ari(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS model_a, '{b}' AS model_b, round((s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS ari FROM (SELECT
  (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM voters GROUP BY {a}, {b})) AS s, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM voters GROUP BY {a})) AS sa,
  (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM voters GROUP BY {b})) AS sb, (SELECT count(*) * (count(*) - 1) / 2.0 FROM voters) AS t)"""


_BLEND = f"""WITH {_VOTERS}, v AS (SELECT doc_id, {_unit('doc_id', 'pr')} AS prob, {', '.join(f"{_SHARE(c, 'm')} AS v{c}" for c in range(3))}, {', '.join(f"0.1 + {_unit('doc_id', f'a{i}')} AS u{i}" for i in range(3))} FROM voters),
w AS (SELECT *, u0 / (u0 + u1 + u2) AS b0, u1 / (u0 + u1 + u2) AS b1, u2 / (u0 + u1 + u2) AS b2, prob >= 0.4 AS lab, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS cc FROM v),
x AS (SELECT *, {', '.join(f"CASE WHEN lab THEN 0.7 * v{c} + 0.3 * b{c} ELSE b{c} END AS c{c}" for c in range(3))} FROM w),
y AS (SELECT *, greatest(least(1 - prob, 1.0), 1e-9) AS q0, {', '.join(f"greatest(least(prob * c{c} / (c0 + c1 + c2), 1.0), 1e-9) AS q{k + 1}" for k, c in enumerate((2, 0, 1)))},
  CASE WHEN NOT lab THEN 0 WHEN cc = 2 THEN 1 WHEN cc = 0 THEN 2 ELSE 3 END AS di FROM x)
SELECT doc_id, CASE WHEN di = 0 THEN 'No_Festival' ELSE 'Drug_' || di END AS label_name, round(CASE di WHEN 0 THEN q0 WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END / (q0 + q1 + q2 + q3), 6) AS label_confidence,
  {', '.join(f"round(q{i} / (q0 + q1 + q2 + q3), 6) AS p{i}" for i in range(4))} FROM y"""

_SCORED = f"""scored0 AS (SELECT *, (quality + toxic) AS y, floor((0.7 * {_unit('doc_id', 's')} + 0.3 * toxic) * 1000) / 1000 AS score,
  {', '.join(f"0.1 + {_unit('doc_id', f'p{i}')} + CASE WHEN quality + toxic = {i} THEN 0.4 ELSE 0.0 END AS u{i}" for i in range(3))} FROM labels),
scored AS (SELECT *, u0 / (u0 + u1 + u2) AS p0, u1 / (u0 + u1 + u2) AS p1, u2 / (u0 + u1 + u2) AS p2 FROM scored0),
pred AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM scored)"""
_CLASS = f"""WITH {_SCORED}, cls AS (SELECT y AS class FROM pred UNION SELECT prediction FROM pred),
m AS (SELECT class, (SELECT count(*) FROM pred WHERE y = class) AS support, (SELECT count(*) FROM pred WHERE prediction = class) AS pre, (SELECT count(*) FROM pred WHERE y = class AND prediction = class) AS tp FROM cls),
f AS (SELECT class, support, CASE WHEN pre > 0 THEN tp / pre ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, 2.0 * tp / (support + pre) AS f1 FROM m)"""


def _auc(y: str, s: str) -> str:
    return f"""(SELECT (sum(rk) FILTER ({y}) - (count(*) FILTER ({y})) * ((count(*) FILTER ({y})) + 1) / 2.0) / ((count(*) FILTER ({y})) * (count(*) FILTER (NOT ({y}))))
  FROM (SELECT *, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rk FROM pred))"""


_FOLDS = "folds AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) - 1) % 5 AS fold FROM labels)"


def _exclusive(q: float) -> str:
    return f"(SELECT round(v[lo] + (v[lo + 1] - v[lo]) * (pos - lo), 6) FROM (SELECT v, {q}::DOUBLE * (len(v) + 1) AS pos, greatest(1, least(len(v) - 1, floor({q} * (len(v) + 1))::INT)) AS lo FROM l))"


def _call() -> str:
    u = [f"u{i} < 0.3" for i in range(4)]
    total = "3.0"
    for i in range(1, 4):
        total += f" + CASE WHEN {' AND '.join(u[:i])} THEN 3.0 + {1.25 * i} ELSE 0.0 END"
    return total


ORACLES = {
    "crosstab_nation_balance": """WITH s AS (SELECT s_nationkey, floor(s_acctbal / 2000)::BIGINT AS bucket FROM supplier),
g AS (SELECT * FROM (SELECT DISTINCT s_nationkey FROM s) CROSS JOIN (SELECT DISTINCT bucket FROM s)), c AS (SELECT s_nationkey, bucket, count(*) AS n FROM s GROUP BY 1, 2)
SELECT s_nationkey, bucket, coalesce(n, 0) AS count, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s_nationkey), 6) AS row_pct FROM g LEFT JOIN c USING (s_nationkey, bucket)""",
    "missingness_docs_labels": f"WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) {_MISSING}",
    "numeric_summary_lineitem": _NUMERIC,
    "categorical_summary_part": _CATEGORY,
    "value_counts_event_type": "SELECT event_type, count(*) AS count FROM events GROUP BY 1",
    "share_of_total": "SELECT event_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1",
    "key_overlap_tables": _overlap("documents", "doc_id", "labels", "doc_id") + " UNION ALL " + _overlap("orders", "o_custkey", "customer", "c_custkey"),
    "pattern_scan_documents": _SCAN,
    "group_sizes_with_nulls": "SELECT lang, quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "mode_consistency": r"""WITH c AS (SELECT role, CASE WHEN contains(lower(text), 'license') THEN 'assistant' WHEN contains(text, '?') THEN 'user' WHEN regexp_matches(lower(text), '\bthe\b') THEN 'system' ELSE 'unknown' END AS said FROM conversations)
SELECT role, said, role = said AS matches, count(*) AS count FROM c GROUP BY ALL""",
    "one_to_one_join_encounter": "SELECT doc_id, d.lang, n_chars, quality, toxic, 'xx' AS labels__lang FROM documents d JOIN labels USING (doc_id)",
    "left_join_customer_orders": "SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n_orders, spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "dup_key_check": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "missing_keys": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "distinct_first_by_key": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
    "column_slugify": "SELECT p_partkey, trim(regexp_replace(lower(trim(' ' || p_type || ' #/ ' || p_brand || '! ')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    "normalize_ws": f"SELECT doc_id, length({_norm('text')}) AS n, md5({_norm('text')}) AS h FROM documents",
    "text_corpus": f"SELECT doc_id, md5({_norm('''concat('[lang] ', lang, ' [source] ', source, ' [text] ', text)''')}) AS corpus, md5({_norm('''concat(lang, ' ', text)''')}) AS plain FROM documents",
    "conversation_corpus": "SELECT conv_id, count(*) AS turns, md5(string_agg('[' || role || '] ' || text, ' ' ORDER BY turn, role, text)) AS corpus FROM conversations GROUP BY 1",
    "term_hits_score": f"""WITH d AS (SELECT doc_id, lang, {_hits(["the ", "tion", "token", "license", "dance"])} AS a, {_hits(["que", "sch", "home", "street"])} AS b, source AS place FROM documents)
SELECT doc_id, place, a AS festival_hits, b AS community_hits, round(1.5 * contains(lang, 'en')::INT + 1.1 * a + regexp_matches(place, 'src1|src2')::INT - 0.9 * b - regexp_matches(place, 'src3|src4')::INT, 6) AS score FROM d""",
    "date_parts_orders": "SELECT o_orderkey, hour(o_orderdate) AS o_hour, isodow(o_orderdate) - 1 AS o_dow, month(o_orderdate) AS o_month, day(o_orderdate) AS o_day, (isodow(o_orderdate) >= 6)::BIGINT AS o_is_weekend FROM orders",
    "vitals_shorthand": """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, 'HR ' || round_even(q + 0.25, 0)::BIGINT || ' | RR ' || (q * 2)::BIGINT || ' | BP ' || (q + 100)::BIGINT || '/' || coalesce((CASE WHEN q > 25 THEN q END)::BIGINT::VARCHAR, 'NA') || ' | SpO2 ' || round_even(q * 1.3, 0)::BIGINT
  || '% | Temp ' || printf('%.1f', 36.0 + floor(q / 10) / 10) || 'C | GCS 15 | SuppO2 0' AS vitals FROM l""",
    "one_hot_segment": "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT::DOUBLE AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + ", (c_mktsegment IS NULL)::INT::DOUBLE AS c_mktsegment_nan FROM customer",
    "impute_median": """WITH j AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS n_chars FROM documents LEFT JOIN labels USING (doc_id)), m AS (SELECT median(quality) AS q, median(toxic) AS t, median(n_chars) AS n FROM j)
SELECT doc_id, round(coalesce(quality, q)::DOUBLE, 6) AS quality, round(coalesce(toxic, t)::DOUBLE, 6) AS toxic, round(coalesce(n_chars, n)::DOUBLE, 6) AS n_chars FROM j, m""",
    "standardize_ddof0": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal, 0.0::DOUBLE AS constant FROM customer",
    "train_fold_standardize": "WITH s AS (SELECT s_suppkey, s_acctbal, (s_suppkey % 5)::INT AS fold FROM supplier), m AS (SELECT avg(s_acctbal) AS a, stddev_pop(s_acctbal) AS d FROM s WHERE fold <> 0) SELECT s_suppkey, round((s_acctbal - a) / d, 6) AS s_acctbal, fold FROM s, m",
    "nested_len_hist": "SELECT length, count(*) AS count FROM (SELECT o_orderkey, count(l_linenumber) AS length FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1",
    "nested_event_counts": "SELECT event_type, count(*) AS count FROM events GROUP BY 1",
    "nested_summary_full": _nested(True),
    "nested_summary_reduced": _nested(False),
    "parse_nested_cells": f"""SELECT event_id, CASE {_K} % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n, CASE {_K} % 5 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n_strict, CASE WHEN {_K} % 5 IN (2, 3) THEN {_K}::BIGINT END AS last_k FROM events""",
    "props_key_types": "SELECT 'k' AS key, bool_or(try_cast(props->>'k' AS DOUBLE) IS NOT NULL) AS is_numeric, bool_or(try_cast(props->>'k' AS DOUBLE) IS NULL) AS is_categorical FROM events",
    "top_categories": "SELECT * FROM (SELECT user_id, event_type, count(*) AS count, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 2",
    "symptom_triples": _TRIPLES,
    "prototype_match": _prototypes(),
    "extraction_coerce": """SELECT c_custkey, (c_custkey % 4 <> 0)::BIGINT AS n_symptoms, CASE WHEN c_custkey % 4 <> 0 THEN 'sym' || (c_custkey % 3) END AS name,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 IN (0, 1) THEN NULL ELSE c_custkey % 50 END AS minutes, CASE WHEN c_custkey % 2 = 0 THEN 'ems' ELSE 'unknown' END AS arrival_mode, 'unknown' AS mental_status,
  CASE WHEN c_custkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM customer""",
    "knn_mean_distance": _knn("", 12),
    "nested_types": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) AS k FROM events),
v AS (SELECT string_agg(event_type, ',' ORDER BY c DESC, event_type) AS v FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1 ORDER BY c DESC, event_type LIMIT 8))
SELECT 'cell' AS column, 'k' AS key, k AS n_numeric, n - k AS n_other, 'BIGINT' AS types, '' AS values FROM n UNION ALL SELECT 'props', 'k', k, n - k, 'BIGINT', '' FROM n
UNION ALL SELECT 'cell', 'kind', 0, n, 'STRING', v FROM n, v UNION ALL SELECT 'cell', 'ok', n, 0, 'BOOLEAN', '' FROM n UNION ALL SELECT 'cell', 'note', 0, n, 'VOID', '' FROM n""",
    "network_gradient": """WITH r AS (SELECT l_quantity / 50 AS x0, l_discount * 10 AS x1, l_tax * 10 AS x2, (l_returnflag = 'R')::INT AS y, CASE WHEN l_returnflag = 'R' THEN 2.0::DOUBLE ELSE 0.75 END AS w FROM lineitem),
z AS (SELECT *, 0.1 * x0 + 0.3 * x1 - 0.4 * x2 + 0.05 AS z0, -0.2 * x0 + 0.1 * x1 + 0.2 * x2 - 0.05 AS z1 FROM r),
p AS (SELECT *, exp(z1) / (exp(z0) + exp(z1)) - y AS d, ln(exp(z0) + exp(z1)) - CASE WHEN y = 1 THEN z1 ELSE z0 END AS loss FROM z),
s AS (SELECT [-sum(w * d * x0), sum(w * d * x0), -sum(w * d * x1), sum(w * d * x1), -sum(w * d * x2), sum(w * d * x2), -sum(w * d), sum(w * d), sum(w * loss)] AS g, sum(w) AS total FROM p)
SELECT (i - 1)::INT AS place, round(g[i] / total, 6)::DOUBLE AS value FROM s, range(1, 10) t(i)""",
    "kmeans_ensemble": _ensemble(),
    "gmm_plane": _mixture(),
    "knn_pivot_join": _knn("", 12),
    "knn_to_anchor": _knn("WHERE f.label < 3", 18),
    "centroid_affinity": f"""WITH {_EMB}, {_CENTERS}, d AS (SELECT vec_id, {', '.join(f"list_distance(v, (SELECT c FROM c WHERE label = {i})) AS d{i}" for i in range(10))} FROM e),
t AS (SELECT quantile_cont(x, 0.5) AS t FROM ({' UNION ALL '.join(f"SELECT d{i} AS x FROM d" for i in range(10))})), w AS (SELECT vec_id, {', '.join(f"exp((least({', '.join(f'd{k}' for k in range(10))}) - d{i}) / t) AS w{i}" for i in range(10))} FROM d, t)
SELECT vec_id, {', '.join(f"round(w{i} / ({' + '.join(f'w{k}' for k in range(10))}), 6) AS a{i}" for i in range(10))} FROM w""",
    "cosine_prototypes": f"""WITH {_EMB}, {_CENTERS}, s AS (SELECT vec_id, c.label AS k, list_cosine_similarity(v, c.c) AS s FROM e CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS r FROM s) SELECT vec_id, round(s, 6) AS similarity, k::BIGINT AS prototype FROM r WHERE r = 1""",
    "stage1_scores": f"WITH {_STAGE1} SELECT doc_id, round(s, 6) AS score_raw, round(1 / (1 + exp(-s)), 6) AS prob FROM z",
    "stage1_embeddings": f"""WITH {_EMB}, a AS (SELECT vec_id, v, (vec_id % 7 - 3)::DOUBLE AS h FROM e), d AS (SELECT q.vec_id, f.h, list_distance(q.v, f.v) AS d FROM a q CROSS JOIN a f),
n AS (SELECT vec_id, h, d, row_number() OVER (PARTITION BY vec_id, h >= 2 ORDER BY d) AS rp, row_number() OVER (PARTITION BY vec_id, h <= -2 ORDER BY d) AS rn, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rk FROM d),
m AS (SELECT vec_id, avg(d) FILTER (h >= 2 AND rp <= 12) AS dp, avg(d) FILTER (h <= -2 AND rn <= 12) AS dn, avg(d) FILTER (rk <= 18) AS k FROM n GROUP BY 1),
r AS (SELECT vec_id, h, dp, dn, k, (dn - dp) / greatest(abs(dn) + abs(dp), 1e-6) AS rel FROM m JOIN a USING (vec_id)),
z AS (SELECT vec_id, dp, dn, 0.55 * (h - avg(h) OVER ()) / stddev_pop(h) OVER () + 0.30 * (rel - avg(rel) OVER ()) / stddev_pop(rel) OVER () - 0.15 * (k - avg(k) OVER ()) / stddev_pop(k) OVER () AS s FROM r)
SELECT vec_id, round(dp, 6) AS d_pos, round(dn, 6) AS d_neg, round(s, 6) AS score_raw, round(1 / (1 + exp(-s)), 6) AS prob FROM z""",
    "threshold_search": f"""WITH {_STAGE1}, p AS (SELECT round(1 / (1 + exp(-s)), 9) AS prob, h >= 2 AS pos, h <= -2 AS neg FROM z), g AS (SELECT 0.2::DOUBLE + (0.8::DOUBLE - 0.2::DOUBLE) * i / 60 AS t FROM range(61) r(i)),
b AS (SELECT t, ((count(*) FILTER (pos AND prob >= t)) / (count(*) FILTER (pos)) + (count(*) FILTER (neg AND prob < t)) / (count(*) FILTER (neg))) / 2 AS ba FROM p, g GROUP BY t),
w AS (SELECT least(greatest(t, 0.3), 0.75) AS t FROM b ORDER BY ba DESC, t LIMIT 1)
SELECT round(t, 6) AS threshold, round(((count(*) FILTER (pos AND prob >= t)) / (count(*) FILTER (pos)) + (count(*) FILTER (neg AND prob < t)) / (count(*) FILTER (neg))) / 2, 6) AS balanced_accuracy FROM p, w GROUP BY t""",
    "label_alignment": f"WITH {_VOTERS} SELECT model, permutation, matches FROM ({_ALIGN})",
    "consensus_votes": f"""WITH {_ALIGNED}, v AS (SELECT doc_id, {', '.join(f"{_SHARE(c, 'a')} AS v{c}" for c in range(3))} FROM al),
cc AS (SELECT doc_id, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS k, greatest(v0, v1, v2) AS conf FROM v),
ranks AS (SELECT k, row_number() OVER (ORDER BY n DESC, k) AS di FROM (SELECT r.k, count(cc.k) AS n FROM range(3) r(k) LEFT JOIN cc ON cc.k = r.k GROUP BY 1))
SELECT doc_id, cc.k::BIGINT AS cluster_consensus, round(conf, 6)::DOUBLE AS confidence, 'Drug_' || di AS drug FROM cc JOIN ranks ON ranks.k = cc.k""",
    "ari_pairs": f"WITH {_VOTERS} " + " UNION ALL ".join(_ari(f"m{a}", f"m{b}") for a, b in itertools.combinations(range(5), 2)),
    "blend_outputs": _BLEND,
    "shift_metrics": f"WITH {_VOTERS} SELECT round(avg((m0 <> base)::INT), 6) AS flip_rate, round(avg(abs({_unit('doc_id', 'x')} - {_unit('doc_id', 'y')})), 6) AS mean_abs_shift FROM voters",
    "class_weights": """WITH l AS (SELECT quality + toxic AS y FROM labels), c AS (SELECT r.y::INT AS y, count(l.y) AS n FROM range(4) r(y) LEFT JOIN l ON l.y = r.y GROUP BY 1)
SELECT y, n, round(CASE WHEN n > 0 THEN (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c WHERE n > 0) * n) ELSE 1.0 END, 6)::DOUBLE AS weight FROM c""",
    "stratified_folds": f"WITH {_FOLDS} SELECT * FROM folds",
    "fold_class_counts": f"WITH {_FOLDS} SELECT fold, count(*) AS n, count(*) FILTER (quality = 0) AS n_0, count(*) FILTER (quality = 1) AS n_1 FROM folds GROUP BY 1",
    "metrics_basic": f"{_CLASS} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM f",
    "class_precision_recall": f"{_CLASS} SELECT class::BIGINT AS class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "auroc": f"WITH {_SCORED} SELECT round({_auc('toxic = 1', 'score')}, 6) AS auroc",
    "macro_auroc": f"WITH {_SCORED} SELECT round(({' + '.join(_auc(f'y = {c}', f'p{c}') for c in range(3))}) / 3, 6) AS macro_auroc",
    "avg_precision": f"""WITH {_SCORED}, s AS (SELECT score, count(*) FILTER (toxic = 1) AS p, count(*) AS n FROM scored GROUP BY 1),
c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * tp / k) / sum(p), 6) AS average_precision FROM c""",
    "logloss": f"WITH {_SCORED} SELECT round(-avg(ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END / (p0 + p1 + p2))), 6) AS log_loss FROM scored",
    "fold_aggregate": f"WITH {_FOLDS}, s AS (SELECT fold, avg(quality) AS share, avg(doc_id) AS key FROM folds GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, round(min({m}), 6) AS min FROM s" for m in ("share", "key")),
    "group_folds": """WITH RECURSIVE g AS (SELECT coalesce(source, '__NA__') AS source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(source, '__NA__')) AS r FROM documents GROUP BY 1),
s AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS source, 0::BIGINT AS n, 0::BIGINT AS fold
  UNION ALL SELECT g.r, list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END)::BIGINT[], g.source, g.n, list_position(loads, list_min(loads)) - 1 FROM s JOIN g ON g.r = s.r + 1)
SELECT source, n, fold::INT AS fold FROM s WHERE r > 0""",
    "top_k_examples": "SELECT * FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5",
    "hash_sample_examples": """WITH p AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS r FROM documents)
SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM p WHERE r <= 5""",
    "category_order": r"""WITH l AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'No_Festival' WHEN o_orderkey % 9 = 1 THEN 'Other' ELSE 'Drug_' || (o_orderkey % 12) END AS label FROM orders)
SELECT label, count(*) AS count, row_number() OVER (ORDER BY CASE WHEN label LIKE 'Drug%' THEN 0 WHEN label = 'No_Festival' THEN 1 ELSE 2 END, try_cast(regexp_extract(label, '(\d+)', 1) AS INT), label) AS place FROM l GROUP BY 1""",
    "retry_simulation_expected": f"""WITH u AS (SELECT o_orderkey % 50 AS trial, {', '.join(f"{_unit('o_orderkey', str(i))} AS u{i}" for i in range(4))} FROM orders), t AS (SELECT trial, sum({_call()})::DOUBLE AS s FROM u GROUP BY 1), l AS (SELECT list(s ORDER BY s) AS v FROM t)
SELECT (SELECT round(avg(s), 6) FROM t) AS mean, {', '.join(f"{_exclusive(q / 100)} AS p{q}" for q in (50, 90, 95, 99))}""",
    "metric_value_summary": "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment)::DOUBLE FROM customer UNION ALL SELECT 'mean_balance', round(avg(c_acctbal), 4) FROM customer",
}
