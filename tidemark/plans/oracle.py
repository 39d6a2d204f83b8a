"""DuckDB SQL oracles for the registered queries.

Each oracle restates the operator's rules in plain SQL over the pre-registered
test-table views (no Spark, no shared code path with the library). Column
names and types match the Spark output; doubles are rounded to 6 decimals as
in ``registry.rounded``.
"""

from __future__ import annotations

import math

from tidemark.plans.inputs import BACKGROUND, PRICE_LIMITS, STATEMENTS, TIME_CUTS, duckdb_view

R = 6
WS = "[ \\t\\n\\x0B\\f\\r]"
NON_PRINTABLE = (
    "[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cs}\\p{Zl}\\p{Zp}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
)

CENSUS = duckdb_view("census")
STAY = duckdb_view("stay")
MESSY = duckdb_view("messy_orders")

# (name, type) of the profiled census columns, in order (o_orderkey is the key).
CENSUS_COLS = [
    ("id_cliente", "bigint"),
    ("estado", "string"),
    ("valor_total", "double"),
    ("prioridad", "string"),
    ("constante", "string"),
    ("vacia", "string"),
    ("fecha_ingreso", "string"),
    ("fecha_salida", "string"),
]
CENSUS_ALL = [("o_orderkey", "bigint")] + CENSUS_COLS
CUSTOMER_COLS = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
DOC_COLS = [("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
EVENT_COLS = [("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]
LINEITEM_NUM = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
]
NUMERIC = {"bigint", "int", "double"}
TEXT_NULL_TOKENS = ["NA", "N/A", "NULL", "NONE", "SIN DATO", "NO APLICA", "VACIO", "-", "--", ".", "NO REGISTRA"]
PANDAS_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def miss(c: str, t: str) -> str:
    return f"({q(c)} IS NULL OR isnan({q(c)}))" if t == "double" else f"({q(c)} IS NULL)"


def pct(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0) * 100.0, 0.0)"


def cnt(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def rnd(x: str) -> str:
    # Snap float noise at 12 decimals first, as registry.rounded does.
    return f"round(round({x}, 12), {R})"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'))"


def ckey(x: str) -> str:
    return f"regexp_replace({fold(x)}, '[!-/:-@\\[-`{{-~]', '', 'g')"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def text_of(c: str, t: str) -> str:
    return f"CASE WHEN NOT {miss(c, t)} THEN CAST({q(c)} AS VARCHAR) END"


# ---------------------------------------------------------------- D: nulls
def dimensions_sql(src: str, cols) -> str:
    n = len(cols)
    nulls = " + ".join(cnt(miss(c, t)) for c, t in cols)
    return f"""
SELECT rows, {n} AS columns, rows * {n} AS total_cells, rows * {n} - nulls AS informed_cells,
       nulls AS null_cells, {rnd(pct(f'rows * {n} - nulls', f'rows * {n}'))} AS completeness_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS rows, CAST({nulls} AS BIGINT) AS nulls FROM {src} AS t) AS a
"""


def nulls_by_column_sql(src: str, cols) -> str:
    parts = [
        f"SELECT {i + 1} AS position, {lit(c)} AS {q('column')}, {cnt(miss(c, t))} AS nulls, "
        f"CAST(count(*) AS BIGINT) AS rows FROM {src} AS t"
        for i, (c, t) in enumerate(cols)
    ]
    return f"""
SELECT position, {q('column')}, nulls, {rnd(pct('nulls', 'rows'))} AS nulls_pct, rows - nulls AS non_nulls,
       {rnd(pct('rows - nulls', 'rows'))} AS completeness_pct
FROM ({union(parts)}) AS p
"""


def _k(cols) -> str:
    return " + ".join(f"CAST({miss(c, t)} AS INTEGER)" for c, t in cols)


def row_completeness_sql(src: str, cols) -> str:
    n = len(cols)
    return f"""
SELECT {cnt(f'k = {n}')} AS all_null_rows, {cnt('k > 0')} AS rows_with_nulls, {cnt('k = 0')} AS complete_rows
FROM (SELECT {_k(cols)} AS k FROM {src} AS t) AS s
"""


def nulls_per_row_sql(src: str, cols) -> str:
    return f"""
SELECT nulls_in_row, rows, {rnd(pct('rows', 'sum(rows) OVER ()'))} AS rows_pct
FROM (SELECT {_k(cols)} AS nulls_in_row, CAST(count(*) AS BIGINT) AS rows FROM {src} AS t GROUP BY 1) AS g
"""


def missing_ranking_sql(src: str, cols) -> str:
    return f"""
SELECT CAST(row_number() OVER (ORDER BY nulls_pct DESC, position) AS INTEGER) AS rank, {q('column')}, nulls_pct
FROM ({nulls_by_column_sql(src, cols)}) AS b
"""


LINEITEM_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
DUP_ORDERS_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def date_layouts_sql() -> str:
    # M-d-y goes before d-M-y, as for slashes; offsets are turned to UTC.
    return f"""SELECT o_orderkey, CASE o_orderkey % 6
       WHEN 0 THEN strptime(substr(fecha, 1, 19), '%Y-%m-%dT%H:%M:%S') + INTERVAL 5 HOUR
       WHEN 1 THEN coalesce(try_strptime(fecha, '%m-%d-%Y'), try_strptime(fecha, '%d-%m-%Y'))
       WHEN 2 THEN strptime(fecha, '%m/%d/%Y %H:%M')
       WHEN 3 THEN strptime(fecha, '%Y-%m-%d %I:%M %p')
       WHEN 4 THEN strptime(substr(fecha, 1, 19), '%Y-%m-%dT%H:%M:%S') END AS at
FROM {duckdb_view("date_layouts")} AS t"""


# ---------------------------------------------------------------- E: duplicates
def exact_duplicates_sql(src: str, cols: list[str]) -> str:
    g = ", ".join(q(c) for c in cols)
    return f"""
SELECT dup AS duplicate_rows, {rnd(pct('dup', 'rows'))} AS duplicate_rows_pct, groups AS duplicate_groups,
       largest AS largest_group
FROM (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows,
             CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup,
             CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS groups,
             CAST(coalesce(max(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS largest
      FROM (SELECT {g}, count(*) AS n FROM {src} AS t GROUP BY {g}) AS x) AS a
"""


def _dup_members(src: str, cols: list[str]) -> str:
    g = ", ".join(q(c) for c in cols)
    match = " AND ".join(f"d.{q(c)} IS NOT DISTINCT FROM t.{q(c)}" for c in cols)
    return f"""(SELECT t.* FROM {src} AS t WHERE EXISTS (
    SELECT 1 FROM (SELECT {g} FROM {src} AS u GROUP BY {g} HAVING count(*) > 1) AS d WHERE {match}))"""


def duplicate_examples_sql(src: str, key: list[str], cols: list[str]) -> str:
    order = ", ".join(q(c) for c in key + cols)
    return f"SELECT {order} FROM {_dup_members(src, cols)} AS m ORDER BY {order} LIMIT 20"


def duplicate_row_keys_sql(src: str, key: list[str], cols: list[str]) -> str:
    return f"SELECT {', '.join(q(k) for k in key)} FROM {_dup_members(src, cols)} AS m"


# ---------------------------------------------------------------- C / F: shape
def column_inventory_sql(src: str, cols) -> str:
    parts = [
        f"SELECT {i + 1} AS position, {lit(c)} AS original_name, {lit(c)} AS normalized_name, {lit(t)} AS data_type, "
        f"{cnt('NOT ' + miss(c, t))} AS non_null, "
        f"CAST(count(DISTINCT CASE WHEN NOT {miss(c, t)} THEN {q(c)} END) AS BIGINT) AS {q('distinct')} "
        f"FROM {src} AS t"
        for i, (c, t) in enumerate(cols)
    ]
    return union(parts)


IDENTIFIER_TERMS = ["id", "identificacion", "documento", "episodio", "admision", "ingreso", "historia", "paciente", "consecutivo"]


def _id_name_match(name: str) -> str:
    folded = f"replace(lower(strip_accents({lit(name)})), ' ', '_')"
    return "(" + " OR ".join(f"contains({folded}, {lit(t)})" for t in IDENTIFIER_TERMS) + ")"


def identifier_candidates_sql(src: str, cols) -> str:
    parts = []
    for c, t in cols:
        s = text_of(c, t)
        parts.append(
            f"""SELECT {lit(c)} AS {q('column')}, {_id_name_match(c)} AS name_match,
       CAST(count({s}) AS BIGINT) AS nn, CAST(count(DISTINCT {s}) AS BIGINT) AS u, {cnt(miss(c, t))} AS nulls,
       CAST(min(length({s})) AS INTEGER) AS min_length, CAST(max(length({s})) AS INTEGER) AS max_length,
       CAST(median(length({s})) AS DOUBLE) AS median_length,
       {cnt(f"regexp_full_match({s}, '[0-9]+')")} AS dg, {cnt(f"regexp_full_match({s}, '[A-Za-z0-9._-]+')")} AS an
FROM {src} AS t"""
        )
    return f"""
SELECT {q('column')}, name_match, {rnd(pct('u', 'nn'))} AS uniqueness_pct, nn - u AS repeated_values, nulls,
       min_length, max_length, {rnd('median_length')} AS median_length, {rnd(pct('dg', 'nn'))} AS digits_pct,
       {rnd(pct('an', 'nn'))} AS alnum_pct
FROM ({union(parts)}) AS p
WHERE name_match OR (nn > 0 AND {pct('u', 'nn')} >= 95 AND greatest({pct('dg', 'nn')}, {pct('an', 'nn')}) >= 80)
"""


def _canon(c: str, t: str) -> str:
    if t == "double":
        return f"CASE WHEN {q(c)} = 0 THEN 0.0 ELSE {q(c)} END"
    return q(c)


def empty_constant_sql(src: str, cols) -> str:
    parts = []
    for c, t in cols:
        v = _canon(c, t)
        parts.append(
            f"""SELECT {lit(c)} AS {q('column')},
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {src} AS t WHERE NOT {miss(c, t)} GROUP BY {v}) AS f) AS nn,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM {src} AS t WHERE NOT {miss(c, t)} GROUP BY {v}) AS f) AS d,
       (SELECT CAST(coalesce(max(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {src} AS t WHERE NOT {miss(c, t)} GROUP BY {v}) AS f) AS top"""
        )
    return f"""
SELECT {q('column')}, nn = 0 AS is_empty, d = 1 AS single_value, d > 1 AND d <= 5 AS low_variability,
       {pct('top', 'nn')} > 95 AS dominant_over_95, d AS distinct_non_null, {rnd(pct('top', 'nn'))} AS dominant_pct
FROM ({union(parts)}) AS p
"""


def flagged_sql(src: str, cols) -> str:
    return f"""SELECT {q('column')}, is_empty, single_value, dominant_over_95 FROM ({empty_constant_sql(src, cols)}) AS e
WHERE is_empty OR single_value OR dominant_over_95"""


_PY_CLASS = {"bigint": "int", "int": "int", "double": "float", "timestamp_ntz": "datetime"}


def _text_class(v: str) -> str:
    return f"""CASE WHEN regexp_full_match({v}, '[+-]?[0-9]+') THEN 'int'
     WHEN regexp_full_match({v}, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
     WHEN lower({v}) IN ('true', 'false') THEN 'bool'
     WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,9}})?)?)?') THEN 'datetime'
     ELSE 'str' END"""


def type_profile_sql(src: str, key: str, cols) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        is_num = t in NUMERIC
        is_text = t == "string"
        is_dt = t.startswith("timestamp")
        flags = f"{i + 1} AS position, {lit(c)} AS {q('column')}, {lit(t)} AS data_type, {is_num} AS is_numeric, {is_text} AS is_text, false AS is_boolean, {is_dt} AS is_datetime, {not (is_num or is_dt)} AS is_object"
        if is_text:
            parts.append(
                f"""SELECT {flags},
   coalesce((SELECT string_agg(DISTINCT cls, ', ' ORDER BY cls) FROM (
       SELECT {_text_class(q(c))} AS cls FROM {src} AS t WHERE {q(c)} IS NOT NULL ORDER BY {q(key)}, {q(c)} LIMIT 100) AS s), '') AS sample_types,
   coalesce((SELECT string_agg(DISTINCT cls, ', ' ORDER BY cls) FROM (
       SELECT {_text_class(q(c))} AS cls FROM {src} AS t WHERE {q(c)} IS NOT NULL) AS s), '') AS all_types"""
            )
        else:
            cls = lit(_PY_CLASS[t])
            parts.append(
                f"""SELECT {flags},
   CASE WHEN (SELECT count(*) FROM {src} AS t WHERE NOT {miss(c, t)}) > 0 THEN {cls} ELSE '' END AS sample_types,
   CASE WHEN (SELECT count(*) FROM {src} AS t WHERE NOT {miss(c, t)}) > 0 THEN {cls} ELSE '' END AS all_types"""
            )
    return f"""SELECT *, contains(all_types, ',') AS mixed FROM ({union(parts)}) AS p"""


def mixed_type_sql(src: str, key: str, cols) -> str:
    return f"SELECT {q('column')}, all_types FROM ({type_profile_sql(src, key, cols)}) AS tp WHERE mixed"


# ---------------------------------------------------------------- G: text
def text_problems_sql(src: str, cols) -> str:
    parts = []
    for c, t in cols:
        if t != "string":
            continue
        v = q(c)
        parts.append(
            f"""SELECT {lit(c)} AS {q('column')},
       {cnt(f"regexp_matches({v}, '^{WS}')")} AS leading_spaces,
       {cnt(f"regexp_matches({v}, '{WS}\\z')")} AS trailing_spaces,
       {cnt(f"regexp_matches({v}, '{WS}{{2}}')")} AS double_spaces,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT {fold(v)} AS f FROM {src} AS u WHERE {v} IS NOT NULL
            GROUP BY 1 HAVING count(DISTINCT {v}) > 1) AS g) AS spelling_groups,
       {cnt(f"{v} = ''")} AS empty_strings,
       {cnt(f"regexp_full_match({v}, '{WS}+')")} AS only_spaces,
       {cnt(f"regexp_matches({v}, '{NON_PRINTABLE}')")} AS non_printable
FROM {src} AS t"""
        )
    return union(parts)


def textual_nulls_sql(src: str, cols) -> str:
    tokens = ", ".join(lit(x) for x in TEXT_NULL_TOKENS)
    parts = [
        f"SELECT {lit(c)} AS {q('column')}, upper({fold(q(c))}) AS token FROM {src} AS t WHERE {q(c)} IS NOT NULL"
        for c, t in cols
        if t == "string"
    ]
    return f"""SELECT {q('column')}, token, CAST(count(*) AS BIGINT) AS count FROM ({union(parts)}) AS p
WHERE token IN ({tokens}) GROUP BY 1, 2"""


# ---------------------------------------------------------------- H: categories
def _freq(src: str, cols) -> str:
    parts = [
        f"SELECT {i + 1} AS position, {lit(c)} AS {q('column')}, {q(c)} AS value FROM {src} AS t"
        for i, (c, t) in enumerate(cols)
        if t == "string"
    ]
    return f"""(SELECT position, {q('column')}, value, CAST(count(value) AS BIGINT) AS n FROM ({union(parts)}) AS p
GROUP BY 1, 2, 3)"""


def _kept(src: str, cols) -> str:
    return f"""(SELECT position, {q('column')},
        CAST(count(value) AS BIGINT) AS categories, CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS non_null,
        CAST(coalesce(max(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS top_count,
        arg_min(value, (-n, value)) FILTER (WHERE value IS NOT NULL) AS top_category
    FROM {_freq(src, cols)} AS f GROUP BY 1, 2
    HAVING NOT (count(value) > 50 AND {pct('count(value)', 'coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0)')} > 20))"""


def category_summary_sql(src: str, cols) -> str:
    return f"""SELECT {q('column')}, categories, {rnd(pct('categories', 'non_null'))} AS cardinality_pct, top_category,
       top_count, {rnd(pct('top_count', 'non_null'))} AS top_pct, (SELECT CAST(count(*) AS BIGINT) FROM {src} AS t) AS total_rows
FROM {_kept(src, cols)} AS k"""


def category_frequencies_sql(src: str, cols) -> str:
    return f"""SELECT f.{q('column')}, CAST(f.rk AS INTEGER) AS rank, f.value AS category, f.n AS frequency,
       {rnd(pct('f.n', 'k.non_null'))} AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY {q('column')} ORDER BY n DESC, value) AS rk
      FROM {_freq(src, cols)} AS x WHERE value IS NOT NULL) AS f
JOIN {_kept(src, cols)} AS k ON f.{q('column')} = k.{q('column')}
WHERE f.rk <= 10"""


def equivalent_categories_sql(src: str, cols) -> str:
    return f"""SELECT {q('column')}, key, string_agg(value, ' | ' ORDER BY value) AS variants,
       CAST(count(*) AS BIGINT) AS variant_count
FROM (SELECT f.{q('column')}, f.value, {ckey('f.value')} AS key FROM {_freq(src, cols)} AS f
      WHERE f.value IS NOT NULL AND f.{q('column')} IN (SELECT {q('column')} FROM {_kept(src, cols)} AS k)) AS x
WHERE key <> '' GROUP BY 1, 2 HAVING count(*) > 1"""


# ---------------------------------------------------------------- I: numeric
PCTS = [(0.01, "p1"), (0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99")]


def _exact(c: str, t: str) -> str:
    """Least, middle and greatest value of a whole-number column as text; null for floating columns."""
    if t not in ("bigint", "int"):
        return ", ".join(f"CAST(NULL AS VARCHAR) AS {n}_exact" for n in ("min", "median", "max"))
    inner = f"list_sort(list({q(c)}) FILTER (WHERE {q(c)} IS NOT NULL))"
    both = f"({inner})[CAST((count({q(c)}) - 1) // 2 AS INT) + 1] + ({inner})[CAST(count({q(c)}) // 2 AS INT) + 1]"
    median = f"CASE WHEN ({both}) % 2 = 0 THEN CAST(({both}) // 2 AS VARCHAR) ELSE CAST(({both}) // 2 AS VARCHAR) || '.5' END"
    return f"CAST(min({q(c)}) AS VARCHAR) AS min_exact, {median} AS median_exact, CAST(max({q(c)}) AS VARCHAR) AS max_exact"


def _num_stats(src: str, cols) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        x = f"CAST({q(c)} AS DOUBLE)"
        fin = f"CASE WHEN NOT isnan({x}) AND NOT isinf({x}) THEN {x} END"
        qs = ", ".join(f"quantile_cont({fin}, {p}) AS {n}" for p, n in PCTS)
        parts.append(
            f"""SELECT {i + 1} AS position, {lit(c)} AS {q('column')}, {cnt('NOT ' + miss(c, t))} AS count, {cnt(miss(c, t))} AS nulls,
       avg({fin}) AS mean, stddev_samp({fin}) AS stddev, min({fin}) AS min, max({fin}) AS max, {qs},
       {cnt(f'{x} = 0')} AS zeros, {cnt(f'{x} < 0')} AS negatives, {cnt(f'isinf({x})')} AS infinities, {_exact(c, t)}
FROM {src} AS t"""
        )
    return f"(SELECT *, p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi FROM ({union(parts)}) AS u)"


def numeric_summary_sql(src: str, cols) -> str:
    outs = union(
        [
            f"SELECT {lit(c)} AS {q('column')}, CAST(count(*) FILTER (WHERE NOT isnan(CAST({q(c)} AS DOUBLE)) AND "
            f"(CAST({q(c)} AS DOUBLE) < s.lo OR CAST({q(c)} AS DOUBLE) > s.hi)) AS BIGINT) AS iqr_outliers "
            f"FROM {src} AS t, (SELECT lo, hi FROM stats WHERE {q('column')} = {lit(c)}) AS s"
            for c, t in cols
        ]
    )
    r = ", ".join(rnd(n) + f" AS {n}" for n in ["mean", "p50", "stddev", "min", "max"])
    return f"""WITH stats AS {_num_stats(src, cols)}, outs AS ({outs})
SELECT s.{q('column')}, s.count, s.nulls, {rnd('s.mean')} AS mean, {rnd('s.p50')} AS median, {rnd('s.stddev')} AS stddev,
       {rnd('s.min')} AS min, {rnd('s.max')} AS max, {', '.join(rnd('s.' + n) + ' AS ' + n for _, n in PCTS)},
       {rnd('s.p75 - s.p25')} AS iqr, s.zeros, s.negatives, s.infinities, s.min_exact, s.median_exact, s.max_exact, o.iqr_outliers
FROM stats AS s JOIN outs AS o ON s.{q('column')} = o.{q('column')}"""


def numeric_outliers_sql(src: str, key: list[str], cols) -> str:
    keys = ", ".join(f"t.{q(k)}" for k in key)
    parts = [
        f"""SELECT {lit(c)} AS {q('column')}, {keys}{', ' if keys else ''}CAST(t.{q(c)} AS DOUBLE) AS value, s.lo AS lower_limit, s.hi AS upper_limit
FROM {src} AS t, (SELECT lo, hi FROM stats WHERE {q('column')} = {lit(c)}) AS s
WHERE NOT isnan(CAST(t.{q(c)} AS DOUBLE)) AND (CAST(t.{q(c)} AS DOUBLE) < s.lo OR CAST(t.{q(c)} AS DOUBLE) > s.hi)"""
        for c, t in cols
    ]
    outs = ", ".join([q("column")] + [q(k) for k in key])
    return f"""WITH stats AS {_num_stats(src, cols)}
SELECT {outs}, {rnd('value')} AS value, {rnd('lower_limit')} AS lower_limit, {rnd('upper_limit')} AS upper_limit
FROM ({union(parts)}) AS o"""


# ---------------------------------------------------------------- I: dates
DATE_HINT = "(?:[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4})|(?:[0-9]{1,2}:[0-9]{2})"
ISO = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?"


def lenient(v: str, t: str) -> str:
    if t.startswith("timestamp"):
        return f"CAST({v} AS TIMESTAMP)"
    s = f"trim(CAST({v} AS VARCHAR))"
    return f"""coalesce(
  CASE WHEN regexp_full_match({s}, '{ISO}') THEN TRY_CAST({s} AS TIMESTAMP) END,
  CASE WHEN regexp_full_match({s}, '[0-9]{{8}}') THEN try_strptime({s}, '%Y%m%d') END,
  CASE WHEN regexp_full_match({s}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN try_strptime({s}, '%Y/%m/%d') END,
  CASE WHEN regexp_full_match({s}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({s}, '%m/%d/%Y') END,
  CASE WHEN regexp_full_match({s}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({s}, '%d/%m/%Y') END)"""


def _date_tokens_match(name: str) -> str:
    toks = f"string_split(replace(lower(strip_accents({lit(name)})), '_', ' '), ' ')"
    explicit = f"(list_contains({toks}, 'fecha') OR list_contains({toks}, 'hora'))"
    terms = ["fecha", "hora", "ingreso", "egreso", "salida", "triage", "atencion", "admision", "hospitalizacion"]
    excl = ["clase", "estado", "meta", "orden", "tiempo", "total", "hrs", "dias"]
    has_t = " OR ".join(f"list_contains({toks}, {lit(x)})" for x in terms)
    has_x = " OR ".join(f"list_contains({toks}, {lit(x)})" for x in excl)
    return f"({explicit} OR (({has_t}) AND NOT ({has_x})))"


def date_profile_sql(src: str, cols, as_of: str = "2026-01-01 00:00:00", earliest: str = "1900-01-01") -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        eligible = t not in NUMERIC
        conv = lenient(q(c), t)
        hits = cnt(f"regexp_matches({text_of(c, t)}, '{DATE_HINT}')") if eligible else "CAST(0 AS BIGINT)"
        objects = "100.0" if t.startswith("timestamp") else "0.0"
        parts.append(
            f"""SELECT {i + 1} AS position, {lit(c)} AS {q('column')}, {_date_tokens_match(c)} AS by_name,
       {str(t.startswith('timestamp')).lower()} AS recognized, {lit(t)} AS data_type, {eligible} AS eligible,
       {cnt('NOT ' + miss(c, t))} AS non_null, {hits} AS hits,
       CAST(count({conv}) AS BIGINT) AS convertible, {cnt(f'NOT {miss(c, t)} AND {conv} IS NULL')} AS failed,
       min({conv}) AS min_date, max({conv}) AS max_date,
       {cnt(f"{conv} > TIMESTAMP '{as_of}'")} AS future_dates, {cnt(f"{conv} < TIMESTAMP '{earliest} 00:00:00'")} AS before_limit,
       {objects} AS obj
FROM {src} AS t"""
        )
    return f"""(SELECT *, {pct('hits', 'non_null')} AS date_pattern_pct, {pct('convertible', 'non_null')} AS conversion_pct,
        greatest({pct('hits', 'non_null')}, CASE WHEN non_null > 0 THEN obj ELSE 0.0 END) >= 80 AS content_hint,
        '{earliest}' AS earliest_limit
 FROM ({union(parts)}) AS p
 WHERE (by_name OR eligible OR recognized)
   AND (by_name OR recognized OR greatest({pct('hits', 'non_null')}, CASE WHEN non_null > 0 THEN obj ELSE 0.0 END) >= 80))"""


def date_candidates_sql(src: str, cols) -> str:
    return f"""SELECT {q('column')}, by_name, content_hint AND conversion_pct >= 80 AS by_content, data_type,
       {rnd('date_pattern_pct')} AS date_pattern_pct FROM {date_profile_sql(src, cols)} AS d"""


def date_conversion_sql(src: str, cols) -> str:
    return f"""SELECT {q('column')}, non_null, convertible, failed, {rnd('conversion_pct')} AS conversion_pct, min_date, max_date,
       future_dates, before_limit, earliest_limit FROM {date_profile_sql(src, cols)} AS d"""


def date_failures_sql(src: str, key: str, cols) -> str:
    parts = [
        f"""SELECT {lit(c)} AS {q('column')}, {q(key)}, {text_of(c, t)} AS original_value FROM {src} AS t
WHERE NOT {miss(c, t)} AND {lenient(q(c), t)} IS NULL"""
        for c, t in cols
        if t not in NUMERIC
    ]
    return f"""SELECT {q('column')}, {q(key)}, original_value FROM (
  SELECT *, row_number() OVER (PARTITION BY {q('column')} ORDER BY {q(key)}, original_value) AS rn FROM ({union(parts)}) AS f) AS r
WHERE rn <= 20 AND {q('column')} IN (SELECT {q('column')} FROM {date_profile_sql(src, cols)} AS d)"""


def converted_dates_sql(src: str, all_cols, candidates) -> str:
    base = ", ".join(rnd(q(c)) + f" AS {q(c)}" if t == "double" else q(c) for c, t in all_cols)
    types = dict(all_cols)
    added = ", ".join(f"{lenient(q(c), types[c])} AS {q(c + '__ts')}" for c in candidates)
    return f"SELECT {base}, {added} FROM {src} AS t"


def _hours(a: str, b: str) -> str:
    return f"(CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / 3.6e9)"


def temporal_consistency_sql(src: str, start: str, end: str, st: str, et: str) -> str:
    a, b = lenient(q(start), st), lenient(q(end), et)
    d = _hours(a, b)
    return f"""SELECT {lit(start)} AS start_column, {lit(end)} AS end_column, CAST(count(d) AS BIGINT) AS both_valid,
       {cnt('d < 0')} AS end_before_start, {cnt('d = 0')} AS zero_difference, {rnd('min(d)')} AS min_hours,
       {rnd('max(d)')} AS max_hours, {rnd('CAST(median(d) AS DOUBLE)')} AS median_hours
FROM (SELECT {d} AS d FROM {src} AS t) AS x"""


def temporal_inconsistencies_sql(src: str, key: list[str], start: str, end: str, st: str, et: str) -> str:
    a, b = lenient(q(start), st), lenient(q(end), et)
    keys = ", ".join(q(k) for k in key)
    return f"""SELECT {lit(start)} AS start_column, {lit(end)} AS end_column, {keys}, a AS start_value, b AS end_value,
       {rnd('h')} AS hours
FROM (SELECT {keys}, {a} AS a, {b} AS b, {_hours(a, b)} AS h FROM {src} AS t) AS x WHERE h < 0"""


# ---------------------------------------------------------------- C: names and storage
MESSY_NORMALIZED = [
    ("  Número Orden", "numero_orden", "bigint"),
    ("Cliente ID", "cliente_id", "bigint"),
    ("Estado", "estado", "string"),
    ("Valor Total ($)", "valor_total", "double"),
    ("Fecha Ingreso", "fecha_ingreso", "timestamp_ntz"),
    ("fecha ingreso", "fecha_ingreso__2", "string"),
]


def normalize_columns_sql() -> str:
    # DuckDB resolves identifiers case-insensitively, so read the source columns directly.
    sources = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    cols = ", ".join(
        (rnd(src) if t == "double" else src) + f" AS {q(n)}" for src, (_, n, t) in zip(sources, MESSY_NORMALIZED)
    )
    return f"SELECT {cols} FROM orders AS o"


def values_preserved_sql() -> str:
    return f"""SELECT a AS only_in_first, b AS only_in_second, a = 0 AND b = 0 AS preserved FROM (
 SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM {MESSY} AS x EXCEPT ALL SELECT * FROM {MESSY} AS y) AS e) AS a,
        (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM {MESSY} AS x EXCEPT ALL SELECT * FROM {MESSY} AS y) AS e) AS b) AS s"""


GROUPS = [
    ("identificacion", IDENTIFIER_TERMS),
    ("demograficas", ["edad", "sexo", "genero", "residencia", "municipio"]),
    ("clinicas", ["antecedente", "sintoma", "signo", "clinico"]),
    ("triage", ["triage"]),
    ("diagnostico", ["diagnostico", "cie"]),
    ("especialidad", ["especialidad", "servicio"]),
    ("administrativas", ["eps", "asegurador", "autorizacion", "administrativo"]),
    ("temporales", ["fecha", "hora", "ingreso", "egreso", "salida", "triage", "atencion", "admision", "hospitalizacion"]),
    ("ubicacion_o_cama", ["ubicacion", "cama", "sala", "piso"]),
    ("ocupacion", ["ocupacion", "capacidad"]),
    ("conducta", ["conducta", "destino"]),
    ("salida", ["salida", "egreso", "alta"]),
]


def classify_sql(cols) -> str:
    names = ", ".join(f"({i + 1}, {lit(c)}, {lit(t)})" for i, (c, t) in enumerate(cols))
    terms = ", ".join(f"({g + 1}, {lit(name)}, {lit(term)})" for g, (name, ts) in enumerate(GROUPS) for term in ts)
    return f"""WITH n(position, name, data_type) AS (VALUES {names}),
g(ord, grp, term) AS (VALUES {terms}),
m AS (SELECT DISTINCT n.position, g.ord, g.grp FROM n JOIN g ON contains(lower(strip_accents(n.name)), g.term)),
r AS (SELECT position, grp, row_number() OVER (PARTITION BY position ORDER BY ord) AS k, ord FROM m)
SELECT n.name AS {q('column')},
       coalesce((SELECT grp FROM r WHERE r.position = n.position AND k = 1), 'otras') AS proposed_group,
       coalesce((SELECT string_agg(grp, ' | ' ORDER BY ord) FROM r WHERE r.position = n.position AND k > 1), '') AS alternative_groups,
       n.data_type, 'name and type match, programmed' AS criterion, true AS needs_review
FROM n"""


WIDTH = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}


def storage_sql(src: str, cols) -> str:
    def b(c, t):
        if t == "string":
            return f"CAST(coalesce(sum(strlen({q(c)})), 0) AS BIGINT)"
        return f"CAST(count(*) * {WIDTH[t]} AS BIGINT)"

    per = union(
        [
            f"SELECT 'column' AS element, {lit(c)} AS {q('column')}, {b(c, t)} AS bytes, CAST(NULL AS BIGINT) AS source_bytes, "
            f"CAST(NULL AS BIGINT) AS output_bytes, CAST(NULL AS DOUBLE) AS source_to_output_ratio FROM {src} AS t"
            for c, t in cols
        ]
    )
    return f"""WITH per AS ({per})
SELECT 'dataframe_total' AS element, CAST(NULL AS VARCHAR) AS {q('column')}, CAST(sum(bytes) AS BIGINT) AS bytes,
       CAST(NULL AS BIGINT) AS source_bytes, CAST(NULL AS BIGINT) AS output_bytes, CAST(NULL AS DOUBLE) AS source_to_output_ratio
FROM per
UNION ALL SELECT * FROM per"""


# ---------------------------------------------------------------- J: summary
def validation_summary_sql() -> str:
    src, cols = CENSUS, CENSUS_COLS
    n = len(cols)
    text_total = " + ".join(
        ["leading_spaces", "trailing_spaces", "double_spaces", "spelling_groups", "empty_strings", "only_spaces", "non_printable"]
    )
    pairs_src = temporal_inconsistencies_sql(src, ["o_orderkey"], "fecha_ingreso", "fecha_salida", "string", "string")
    checks = [
        (1, "null values", f"(SELECT null_cells FROM ({dimensions_sql(src, cols)}) AS d)", f"(SELECT total_cells FROM ({dimensions_sql(src, cols)}) AS d)", False, "nulls_by_column", "null cells"),
        (2, "exact duplicates", f"(SELECT duplicate_rows FROM ({exact_duplicates_sql(src, [c for c, _ in cols])}) AS d)", f"(SELECT count(*) FROM {src} AS t)", True, "exact_duplicates", "rows that repeat another"),
        (3, "identifier candidates", f"(SELECT count(*) FROM ({identifier_candidates_sql(src, cols)}) AS d)", str(n), False, "identifier_candidates", "columns that look like identifiers"),
        (4, "empty or constant columns", f"(SELECT count(*) FILTER (WHERE is_empty OR single_value) FROM ({empty_constant_sql(src, cols)}) AS d)", str(n), True, "empty_constant_columns", "columns with one value or none"),
        (5, "text problems", f"((SELECT coalesce(sum({text_total}), 0) FROM ({text_problems_sql(src, cols)}) AS d) + (SELECT coalesce(sum(count), 0) FROM ({textual_nulls_sql(src, cols)}) AS e))", f"greatest(1, (SELECT count(*) FROM {src} AS t) * {n})", False, "text_problems", "defects in text"),
        (6, "date conversion", f"(SELECT coalesce(sum(failed), 0) FROM {date_profile_sql(src, cols)} AS d)", f"(SELECT count(*) FROM {src} AS t)", False, "date_conversion", "dates that could not be read"),
        (7, "temporal consistency", f"(SELECT count(*) FROM ({pairs_src}) AS d)", f"(SELECT count(*) FROM {src} AS t)", True, "temporal_inconsistencies", "intervals that end before they start"),
    ]
    parts = []
    for pos, name, affected, total, review, evidence, what in checks:
        status = "REVIEW" if review else "WARNING"
        parts.append(
            f"""SELECT {pos} AS position, {lit(name)} AS {q('check')},
       CASE WHEN a = 0 THEN 'OK' ELSE {lit(status)} END AS status, CAST(a > 0 AS BIGINT) AS warnings, a AS affected,
       {rnd(pct('a', 'tot'))} AS affected_pct, {lit(evidence + '.csv')} AS evidence,
       CASE WHEN a = 0 THEN 'no' ELSE CAST(a AS VARCHAR) END || ' ' || {lit(what)} AS observation
FROM (SELECT CAST({affected} AS BIGINT) AS a, CAST({total} AS BIGINT) AS tot) AS v"""
        )
    return union(parts)


# ---------------------------------------------------------------- A / B
def nullify_sql(src: str, all_cols) -> str:
    marks = ", ".join(lit(m) for m in PANDAS_MARKERS)
    cols = ", ".join(
        f"CASE WHEN {q(c)} IN ({marks}) THEN NULL ELSE {q(c)} END AS {q(c)}" if t == "string"
        else (rnd(q(c)) + f" AS {q(c)}" if t == "double" else q(c))
        for c, t in all_cols
    )
    return f"SELECT {cols} FROM {src} AS t"


def stringify_sql(src: str, all_cols, which) -> str:
    cols = ", ".join(f"CAST({q(c)} AS VARCHAR) AS {q(c)}" if c in which else q(c) for c, t in all_cols)
    return f"SELECT {cols} FROM {src} AS t"


# ---------------------------------------------------------------- tier 2
def length_of_stay_sql() -> str:
    h = _hours("fecha_ingreso", "fecha_salida")
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, fecha_ingreso, fecha_salida, {rnd('h')} AS stay_hours,
       h >= 12 AS prolonged_stay FROM (SELECT *, {h} AS h FROM {STAY} AS s) AS x"""


def classification_sql() -> str:
    scored = """(SELECT l.quality AS y, 1e0 - 1e0 / (1e0 + CAST(d.n_chars AS DOUBLE) / 1000e0) AS score
                 FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id)"""
    return f"""WITH s AS {scored},
c AS (SELECT {cnt('y = 1')} AS positives, {cnt('y = 0')} AS negatives, {cnt('y = 1 AND score >= 0.5')} AS tp,
             {cnt('y = 0 AND score >= 0.5')} AS fp, {cnt('y = 0 AND score < 0.5')} AS tn, {cnt('y = 1 AND score < 0.5')} AS fn FROM s),
d AS (SELECT score AS v, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
r AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb FROM d
      WINDOW w AS (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT sum(neg * (pb + pos * 0.5e0)) AS auc_num,
             sum(CASE WHEN pos > 0 THEN pos * CAST(pb + pos AS DOUBLE) / (pb + pos + nb + neg) END) AS ap_num FROM r)
SELECT positives, negatives, tp, fp, tn, fn,
       {rnd('CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)')} AS precision, {rnd('CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0)')} AS recall,
       {rnd('CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0)')} AS f1,
       {rnd('a.auc_num / NULLIF(CAST(positives * negatives AS DOUBLE), 0)')} AS roc_auc,
       {rnd('a.ap_num / NULLIF(CAST(positives AS DOUBLE), 0)')} AS pr_auc
FROM c, a"""


def regression_sql() -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS rows, {rnd('avg(abs(t - p))')} AS mae, {rnd('sqrt(avg((t - p) * (t - p)))')} AS rmse,
       {rnd('1e0 - sum((t - p) * (t - p)) / (var_pop(t) * count(*))')} AS r2
FROM (SELECT l_extendedprice AS t, l_quantity * 1000e0 AS p FROM lineitem) AS x"""


def explore_sql() -> str:
    g = "(SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS rows, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1, 2)"
    total = "(SELECT count(*) FROM customer)"
    return f"""WITH g AS {g},
s AS (SELECT *, rows < 10 AS little, coalesce(sum(rows) FILTER (rows < 10) OVER (), 0) AS folded,
             row_number() OVER (PARTITION BY rows < 10 ORDER BY rows, c_mktsegment NULLS FIRST, c_nationkey NULLS FIRST) AS place FROM g),
t AS (SELECT *, little OR (folded BETWEEN 1 AND 9 AND place = 1) AS small FROM s)
SELECT c_mktsegment, c_nationkey, rows, {rnd('m')} AS c_acctbal_mean, {rnd('sd')} AS c_acctbal_stddev, false AS suppressed,
       {rnd(pct('rows', total))} AS share_pct FROM t WHERE NOT small
UNION ALL
SELECT CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(sum(rows) AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       true, {rnd(pct('sum(rows)', total))} FROM t WHERE small HAVING sum(rows) >= 10"""


_SCORED = """(SELECT l.doc_id, d.lang, l.quality AS y, 1e0 - 1e0 / (1e0 + CAST(d.n_chars AS DOUBLE) / 1000e0) AS score
              FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id)"""


def time_split_sql() -> str:
    a, b = TIME_CUTS
    return f"""SELECT split, rows, {rnd('100e0 * rows / sum(rows) OVER ()')} AS share_pct, positives, {rnd('CAST(positives AS DOUBLE) / rows')} AS positive_rate
FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP {lit(a)} THEN 'train' WHEN o_orderdate < TIMESTAMP {lit(b)} THEN 'validation' ELSE 'test' END AS split,
             CAST(count(*) AS BIGINT) AS rows, {cnt("o_orderstatus = 'O'")} AS positives FROM orders GROUP BY 1) AS g"""


def baseline_regression_sql() -> str:
    a, b = TIME_CUTS
    r3 = "round(round({}, 12), 3)".format
    parts = []
    for model, p in (("mean", "m.mean"), ("linear_regression", "m.slope * x + m.rest")):
        e = f"(y - ({p}))"
        parts.append(
            f"""SELECT {lit(model)} AS model, split, CAST(count(*) AS BIGINT) AS rows, {r3(f'avg(abs({e}))')} AS mae, {r3(f'sqrt(avg({e} * {e}))')} AS rmse,
       {r3(f'1e0 - sum({e} * {e}) / (var_pop(y) * count(*))')} AS r2 FROM s, m WHERE split <> 'test' GROUP BY split"""
        )
    return f"""WITH s AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x,
  CASE WHEN l_shipdate < TIMESTAMP {lit(a)} THEN 'train' WHEN l_shipdate < TIMESTAMP {lit(b)} THEN 'validation' ELSE 'test' END AS split FROM lineitem),
m AS (SELECT avg(y) AS mean, regr_slope(y, x) AS slope, regr_intercept(y, x) AS rest FROM s WHERE split = 'train')
{union(parts)}"""


def calibration_sql() -> str:
    cuts = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))
    return f"""WITH s AS {_SCORED}, c AS (SELECT [{cuts}] AS cuts FROM s)
SELECT CAST(len(list_filter(cuts, lambda x: x <= score)) AS INT) AS bin, CAST(count(*) AS BIGINT) AS rows, {rnd('avg(score)')} AS mean_score,
       {rnd('avg(CAST(y AS DOUBLE))')} AS observed_rate FROM s, c GROUP BY 1"""


def subgroup_metrics_sql() -> str:
    return f"""SELECT lang AS subgroup, rows, {rnd('CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)')} AS precision,
       {rnd('CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0)')} AS recall, {rnd('2e0 * tp / NULLIF(2 * tp + fp + fn, 0)')} AS f1
FROM (SELECT lang, CAST(count(*) AS BIGINT) AS rows, {cnt('y = 1 AND score >= 0.5')} AS tp, {cnt('y = 0 AND score >= 0.5')} AS fp,
             {cnt('y = 1 AND score < 0.5')} AS fn FROM {_SCORED} AS s GROUP BY lang) AS g"""


def subgroup_effects_sql() -> str:
    return f"""SELECT CASE WHEN n >= 10 THEN lang END AS lang, CAST(sum(n) AS BIGINT) AS rows, {rnd('sum(s) / sum(n)')} AS mean_score, {rnd('sum(t) / sum(n)')} AS observed_rate
FROM (SELECT lang, count(*) AS n, sum(score) AS s, sum(CAST(y AS DOUBLE)) AS t FROM {_SCORED} AS x GROUP BY lang) AS g
GROUP BY 1 HAVING sum(n) >= 10"""


# Fixed values of the bootstrap: seed, replicates, variates per digest, steps of the score.
BOOTSTRAP_SEED, REPLICATES, PER_DIGEST, STEPS = 42, 64, 16, 1000


def bootstrap_sql() -> str:
    poisson = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    limits = ", ".join(str(math.floor(65_536 * p)) for p in poisson)
    digests = -(-REPLICATES // PER_DIGEST)
    metrics = "precision recall f1 roc_auc".split()
    return f"""WITH s AS (SELECT y, greatest(0, least({STEPS}, CAST(floor(score * {STEPS}) AS INT))) AS step, score >= 0.5 AS above,
  list_transform(range(0, {digests}), lambda d: sha256('{BOOTSTRAP_SEED}:' || doc_id || ':' || d)) AS h FROM {_SCORED} AS x),
w AS (SELECT y, step, above, unnest(range(-1, {REPLICATES})) AS b, h FROM s),
u AS (SELECT y, step, above, b, CASE WHEN b < 0 THEN 1 ELSE
  len(list_filter([{limits}], lambda x: x <= CAST('0x' || substr(h[b // {PER_DIGEST} + 1], b % {PER_DIGEST} * 4 + 1, 4) AS INT))) END AS n FROM w),
t AS (SELECT b, step, above, sum(n * y) AS pos, sum(n * (1 - y)) AS neg FROM u WHERE n > 0 GROUP BY ALL),
p AS (SELECT b, step, sum(pos) AS pos, sum(neg) AS neg FROM t GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg * 0.5e0 AS beaten FROM p),
a AS (SELECT b, sum(pos * beaten) / NULLIF(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS roc_auc FROM r GROUP BY b),
c AS (SELECT b, coalesce(sum(pos) FILTER (above), 0) AS tp, coalesce(sum(neg) FILTER (above), 0) AS fp, coalesce(sum(pos) FILTER (NOT above), 0) AS fn FROM t GROUP BY b),
m AS (SELECT b, CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
             2e0 * tp / NULLIF(2 * tp + fp + fn, 0) AS f1, roc_auc FROM c JOIN a USING (b)),
l AS ({union([f"SELECT b, {lit(x)} AS metric, {x} AS value FROM m" for x in metrics])})
SELECT metric, {rnd('max(value) FILTER (b < 0)')} AS estimate, {rnd('quantile_cont(value, 0.025) FILTER (b >= 0)')} AS low,
       {rnd('quantile_cont(value, 0.975) FILTER (b >= 0)')} AS high, CAST(count(value) FILTER (b >= 0) AS BIGINT) AS replicates FROM l GROUP BY metric"""


def contribution_sql() -> str:
    f = "ln(1e0 + {} / 1000e0) * (1e0 + {} / 1000e0)".format
    p0, c0 = (str(BACKGROUND[c]) for c in ("o_totalprice", "o_custkey"))
    p, c = "o_totalprice", "CAST(o_custkey AS DOUBLE)"
    price = f"(({f(p, c0)}) - ({f(p0, c0)}) + ({f(p, c)}) - ({f(p0, c)})) / 2"
    cust = f"(({f(p0, c)}) - ({f(p0, c0)}) + ({f(p, c)}) - ({f(p, c0)})) / 2"
    return union(
        [
            f"SELECT {lit(name)} AS feature, CAST(count(*) AS BIGINT) AS rows, {rnd('avg(v)')} AS mean_contribution, {rnd('avg(abs(v))')} AS mean_absolute, true AS adds_up FROM (SELECT {x} AS v FROM orders) AS {alias}"
            for name, x, alias in (("o_totalprice", price, "a"), ("o_custkey", cust, "b"))
        ]
    )


def statements_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, float) else lit(x) for x in st) + ")" for st in STATEMENTS)
    test = " ".join(f"WHEN compare = {lit(c)} THEN value {c} bound" for c in (">=", ">", "<=", "<", "="))
    numbers = ("positives negatives tp fp tn fn precision recall f1 roc_auc pr_auc", "rows precision recall f1")
    parts = [f"SELECT 'test' AS section, CAST(NULL AS VARCHAR) AS item, {lit(n)} AS metric, CAST({n} AS DOUBLE) AS value FROM ({classification_sql()}) AS x" for n in numbers[0].split()]
    parts += [f"SELECT 'language', subgroup, {lit(n)}, CAST({n} AS DOUBLE) FROM ({subgroup_metrics_sql()}) AS x" for n in numbers[1].split()]
    return f"""WITH st(statement, section, item, metric, compare, bound) AS (VALUES {rows}), m AS ({union(parts)}),
j AS (SELECT st.*, m.value FROM st LEFT JOIN m ON st.section = m.section AND st.item IS NOT DISTINCT FROM m.item AND st.metric = m.metric)
SELECT statement, section, CAST(item AS VARCHAR) AS item, metric, compare, {rnd('CAST(bound AS DOUBLE)')} AS bound, {rnd('value')} AS value,
       CASE WHEN value IS NULL THEN 'no metric' WHEN CASE {test} END THEN 'kept' ELSE 'refused' END AS verdict FROM j"""


def _cleaning_steps() -> tuple[str, list[tuple[str, list[str]]]]:
    """The census under the cleaning rules one after the other, and the columns that tell what each rule changed."""
    texts = [c for c, t in CENSUS_COLS if t == "string"]
    tokens = ", ".join(lit(x) for x in TEXT_NULL_TOKENS)
    lo, hi = PRICE_LIMITS
    rest = lambda chosen: ", ".join(q(c) for c in ["o_orderkey", *(n for n, _ in CENSUS_COLS)] if c not in chosen)
    a, b = lenient(q("fecha_ingreso"), "string"), lenient(q("fecha_salida"), "string")
    trimmed = f"SELECT {rest(texts)}, {', '.join(f'{_trim_sql(q(c))} AS {q(c)}' for c in texts)} FROM {CENSUS} AS t0"
    nulled = f"SELECT {rest(texts)}, {', '.join(f'CASE WHEN upper({fold(q(c))}) IN ({tokens}) THEN NULL ELSE {q(c)} END AS {q(c)}' for c in texts)} FROM ({trimmed}) AS t1"
    dates = ("fecha_ingreso", "fecha_salida")
    coherent = f"SELECT {rest(dates)}, {', '.join(f'CASE WHEN ({b}) < ({a}) THEN NULL ELSE {q(c)} END AS {q(c)}' for c in dates)} FROM ({nulled}) AS t2"
    ranged = f"SELECT {rest(('valor_total',))}, CASE WHEN valor_total < {lo} OR valor_total > {hi} THEN NULL ELSE valor_total END AS valor_total FROM ({coherent}) AS t3"
    return ranged, [(f"SELECT * FROM {CENSUS} AS t", texts), (trimmed, texts), (nulled, list(dates)), (coherent, ["valor_total"])]


def cleaning_contract_sql() -> str:
    final, steps = _cleaning_steps()
    names = ("trim_text", "textual_nulls", "incoherent_interval", "extreme_value")
    after = [sql for sql, _ in steps[1:]] + [final]
    rows = f"(SELECT CAST(count(*) AS BIGINT) FROM {CENSUS} AS t)"
    cols = ", ".join(q(c) for c, _ in CENSUS_COLS)
    parts = []
    for i, ((before, columns), then, name) in enumerate(zip(steps, after, names, strict=True), 1):
        changed = " + ".join(f"CAST(a.{q(c)} IS DISTINCT FROM b.{q(c)} AS BIGINT)" for c in columns)
        parts.append(f"SELECT {i} AS {q('order')}, {lit(name)} AS rule, {rows} AS rows_before, {rows} AS rows_after, CAST(sum({changed}) AS BIGINT) AS cells_changed FROM ({before}) AS a JOIN ({then}) AS b USING (o_orderkey)")
    parts.append(f"SELECT 5, 'exact_duplicates', {rows}, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT {cols} FROM ({final}) AS f) AS d), CAST(0 AS BIGINT)")
    return union(parts)


def cleaned_table_sql() -> str:
    final, _ = _cleaning_steps()
    cols = ", ".join(q(c) for c, _ in CENSUS_COLS)
    sel = ", ".join(rnd(q(c)) + f" AS {q(c)}" if t == "double" else q(c) for c, t in CENSUS_COLS)
    return f"SELECT min(o_orderkey) AS o_orderkey, {sel} FROM ({final}) AS f GROUP BY {cols}"


def correlations_sql() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return union([f"SELECT {lit(a)} AS {q('left')}, {lit(b)} AS {q('right')}, {rnd(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in pairs])


def _trim_sql(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '^{WS}+|{WS}+\\z', '', 'g'), '{WS}+', ' ', 'g')"


def _cleaned_cols() -> list[str]:
    tokens = ", ".join(lit(x) for x in TEXT_NULL_TOKENS)
    out = []
    for c, t in CENSUS_COLS:
        if t == "string":
            tv = _trim_sql(q(c))
            out.append(f"CASE WHEN upper({fold(tv)}) IN ({tokens}) THEN NULL ELSE {tv} END AS {q(c)}")
        else:
            out.append(q(c))
    return out


def clean_sql() -> str:
    cols = ", ".join(q(c) for c, _ in CENSUS_COLS)
    sel = ", ".join(rnd(q(c)) + f" AS {q(c)}" if t == "double" else q(c) for c, t in CENSUS_COLS)
    return f"""SELECT min(o_orderkey) AS o_orderkey, {sel}
FROM (SELECT o_orderkey, {', '.join(_cleaned_cols())} FROM {CENSUS} AS t) AS c GROUP BY {cols}"""


def clean_report_sql() -> str:
    tokens = ", ".join(lit(x) for x in TEXT_NULL_TOKENS)
    texts = [c for c, t in CENSUS_COLS if t == "string"]
    trim_cells = " + ".join(f"CAST(NOT ({_trim_sql(q(c))} IS NOT DISTINCT FROM {q(c)}) AS BIGINT)" for c in texts)
    null_cells = " + ".join(f"CAST(coalesce(upper({fold(_trim_sql(q(c)))}) IN ({tokens}), false) AS BIGINT)" for c in texts)
    cols = ", ".join(q(c) for c, _ in CENSUS_COLS)
    after = f"(SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT {cols} FROM (SELECT {', '.join(_cleaned_cols())} FROM {CENSUS} AS t) AS c) AS d)"
    base = f"(SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum({trim_cells}) AS BIGINT) AS tc, CAST(sum({null_cells}) AS BIGINT) AS nc FROM {CENSUS} AS t)"
    return f"""SELECT 1 AS {q('order')}, 'trim_text' AS rule, n AS rows_before, n AS rows_after, tc AS cells_changed FROM {base} AS b
UNION ALL SELECT 2, 'textual_nulls', n, n, nc FROM {base} AS b
UNION ALL SELECT 3, 'exact_duplicates', n, {after}, CAST(0 AS BIGINT) FROM {base} AS b"""


def infer_types_sql() -> str:
    return f"""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(id_cliente AS BIGINT) AS id_cliente, estado,
       {rnd('CAST(valor_total AS DOUBLE)')} AS valor_total, prioridad, constante, vacia, fecha_ingreso,
       CAST(fecha_salida AS TIMESTAMP) AS fecha_salida FROM {CENSUS} AS t"""


TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]


def list_members_sql() -> str:
    return union([f"SELECT {lit(n)} AS name, CAST(count(*) AS BIGINT) AS rows FROM {n}" for n in TABLE_NAMES])


def classified_columns_sql() -> str:
    return f"""SELECT c.*, n.non_nulls, n.completeness_pct FROM ({classify_sql(CENSUS_COLS)}) AS c
JOIN ({nulls_by_column_sql(CENSUS, CENSUS_COLS)}) AS n ON c.{q('column')} = n.{q('column')}"""


def data_dictionary_sql() -> str:
    none = "CAST(NULL AS VARCHAR)"
    return f"""SELECT CAST(n.position AS INT) AS position, c.{q('column')} AS variable, c.data_type, {none} AS description, {none} AS unit, {none} AS availability,
       c.proposed_group, n.non_nulls AS informed, n.completeness_pct AS informed_pct FROM ({classify_sql(CENSUS_COLS)}) AS c
JOIN ({nulls_by_column_sql(CENSUS, CENSUS_COLS)}) AS n ON c.{q('column')} = n.{q('column')}"""


def evidence_manifest_sql() -> str:
    tables = {"dimensions": dimensions_sql(CENSUS, CENSUS_COLS), "nulls": nulls_by_column_sql(CENSUS, CENSUS_COLS), "date_failures": date_failures_sql(CENSUS, "o_orderkey", CENSUS_COLS)}
    parts = [f"SELECT {lit(n)} AS name, true AS exists, true AS has_bytes, CAST(count(*) AS BIGINT) AS rows FROM ({sql}) AS e" for n, sql in tables.items()]
    return union([*parts, "SELECT 'not_written', false, false, CAST(NULL AS BIGINT)"])


def ingestion_metadata_sql() -> str:
    others = ",".join(n for n in TABLE_NAMES if n != "orders")
    produced = ",".join(sorted(f"{n}.parquet" for n in TABLE_NAMES))
    return f"""SELECT '2026-01-01T00:00:00' AS run_time, 'orders' AS member_used, {lit(others)} AS members_ignored, rows, columns, null_cells,
       (SELECT duplicate_rows FROM ({exact_duplicates_sql(CENSUS, [c for c, _ in CENSUS_COLS])}) AS d) AS duplicate_rows,
       {lit(produced)} AS produced, CAST(1 AS BIGINT) AS source_files, true AS source_hashed FROM ({dimensions_sql(CENSUS, CENSUS_COLS)}) AS x"""


def validation_report_sql() -> str:
    return f"""SELECT '2026-01-01T00:00:00' AS run_time, r.*, s.* FROM ({row_completeness_sql(CENSUS, CENSUS_COLS)}) AS r, ({validation_summary_sql()}) AS s"""


def headed_round_trip_sql() -> str:
    # Empty text reads back as null, then every column takes the narrowest type its values allow.
    return f"""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(id_cliente AS BIGINT) AS id_cliente, estado,
       {rnd('CAST(valor_total AS DOUBLE)')} AS valor_total, NULLIF(prioridad, '') AS prioridad, constante, vacia,
       fecha_ingreso, CAST(fecha_salida AS TIMESTAMP) AS fecha_salida FROM {CENSUS} AS t"""


def category_variants_sql(src: str, cols) -> str:
    return f"""SELECT {q('column')}, key, value AS variant, CAST(n AS BIGINT) AS frequency, CAST(variant_count AS BIGINT) AS variant_count FROM (
  SELECT *, count(*) OVER (PARTITION BY {q('column')}, key) AS variant_count
  FROM (SELECT f.{q('column')}, f.value, f.n, {ckey('f.value')} AS key FROM {_freq(src, cols)} AS f
        WHERE f.value IS NOT NULL AND f.{q('column')} IN (SELECT {q('column')} FROM {_kept(src, cols)} AS k)) AS x
  WHERE key <> '') AS y WHERE variant_count > 1"""


def _evidence() -> list[tuple[str, str, str, str, str]]:
    """Evidence of the profile job over the census: name, SQL, columns of the item, numbers, timestamps."""
    src, cols, names = CENSUS, CENSUS_COLS, [c for c, _ in CENSUS_COLS]
    nums = [(c, t) for c, t in cols if t in NUMERIC]
    dates = ("fecha_ingreso", "fecha_salida", "string", "string")
    summary = validation_summary_sql()
    pcts = " ".join(n for _, n in PCTS)
    return [
        ("dimensions", dimensions_sql(src, cols), "", "rows columns total_cells informed_cells null_cells completeness_pct", ""),
        ("nulls", nulls_by_column_sql(src, cols), "column", "position nulls nulls_pct non_nulls completeness_pct", ""),
        ("missing_ranking", missing_ranking_sql(src, cols), "column", "rank nulls_pct", ""),
        ("nulls_per_row", nulls_per_row_sql(src, cols), "", "nulls_in_row rows rows_pct", ""),
        ("row_completeness", row_completeness_sql(src, cols), "", "all_null_rows rows_with_nulls complete_rows", ""),
        ("duplicate_summary", exact_duplicates_sql(src, names), "", "duplicate_rows duplicate_rows_pct duplicate_groups largest_group", ""),
        ("duplicate_row_keys", duplicate_row_keys_sql(src, ["o_orderkey"], names), "o_orderkey", "", ""),
        ("duplicate_examples", duplicate_examples_sql(src, ["o_orderkey"], names), "o_orderkey estado prioridad constante vacia fecha_ingreso fecha_salida", "id_cliente valor_total", ""),
        ("columns", column_inventory_sql(src, cols), "original_name normalized_name data_type", "position non_null distinct", ""),
        ("data_types", type_profile_sql(src, "o_orderkey", cols), "column data_type sample_types all_types", "position is_numeric is_text is_boolean is_datetime is_object mixed", ""),
        ("identifiers", identifier_candidates_sql(src, cols), "column", "name_match uniqueness_pct repeated_values nulls min_length max_length median_length digits_pct alnum_pct", ""),
        ("empty_constants", empty_constant_sql(src, cols), "column", "is_empty single_value low_variability dominant_over_95 distinct_non_null dominant_pct", ""),
        ("flagged_columns", flagged_sql(src, cols), "column", "is_empty single_value dominant_over_95", ""),
        ("text_problems", text_problems_sql(src, cols), "column", "leading_spaces trailing_spaces double_spaces spelling_groups empty_strings only_spaces non_printable", ""),
        ("textual_nulls", textual_nulls_sql(src, cols), "column token", "count", ""),
        ("category_summary", category_summary_sql(src, cols), "column top_category", "categories cardinality_pct top_count top_pct total_rows", ""),
        ("category_frequencies", category_frequencies_sql(src, cols), "column category", "rank frequency pct", ""),
        ("category_variants", category_variants_sql(src, cols), "column key variant", "frequency variant_count", ""),
        ("category_equivalences", equivalent_categories_sql(src, cols), "column key variants", "variant_count", ""),
        ("numeric_summary", numeric_summary_sql(src, nums), "column min_exact median_exact max_exact", f"count nulls mean median stddev min max {pcts} iqr zeros negatives infinities iqr_outliers", ""),
        ("date_candidates", date_candidates_sql(src, cols), "column data_type", "by_name by_content date_pattern_pct", ""),
        ("date_results", date_conversion_sql(src, cols), "column earliest_limit", "non_null convertible failed conversion_pct future_dates before_limit", "min_date max_date"),
        ("numeric_outliers", numeric_outliers_sql(src, ["o_orderkey"], nums), "column o_orderkey", "value lower_limit upper_limit", ""),
        ("date_failures", date_failures_sql(src, "o_orderkey", cols), "column o_orderkey original_value", "", ""),
        ("temporal_summary", temporal_consistency_sql(src, *dates), "start_column end_column", "both_valid end_before_start zero_difference min_hours max_hours median_hours", ""),
        ("temporal_inconsistencies", temporal_inconsistencies_sql(src, ["o_orderkey"], *dates), "start_column end_column o_orderkey", "hours", "start_value end_value"),
        ("memory", storage_sql(src, cols), "element column", "bytes source_bytes output_bytes source_to_output_ratio", ""),
        ("validation_summary", summary, "check status evidence observation", "position warnings affected affected_pct", ""),
        ("status_counts", f"SELECT status, CAST(count(*) AS BIGINT) AS checks FROM ({summary}) AS s GROUP BY status", "status", "checks", ""),
        ("pending_validations", f"SELECT {q('check')}, status, observation FROM ({summary}) AS s WHERE status <> 'OK'", "check status observation", "", ""),
    ]


def profile_job_sql() -> str:
    """Every evidence table in long form: one row per evidence row and value."""
    parts = []
    for name, sql, about, numbers, stamps in _evidence():
        item = ", ".join(f"{lit(c + '=')} || CAST({q(c)} AS VARCHAR)" for c in about.split())
        item = f"concat_ws('|', {item})" if item else "''"
        cells = [f"{{'metric': {lit(c)}, 'number': {rnd(f'CAST({q(c)} AS DOUBLE)')}, 'text': CAST(NULL AS VARCHAR)}}" for c in numbers.split()]
        cells += [f"{{'metric': {lit(c)}, 'number': CAST(NULL AS DOUBLE), 'text': strftime({q(c)}, '%Y-%m-%d %H:%M:%S')}}" for c in stamps.split()]
        cells = cells or ["{'metric': 'row', 'number': 1.0::DOUBLE, 'text': CAST(NULL AS VARCHAR)}"]
        parts.append(f"SELECT {lit(name)} AS {q('table')}, {item} AS item, unnest([{', '.join(cells)}]) AS v FROM ({sql}) AS e")
    return f"SELECT {q('table')}, item, v.metric AS metric, v.number AS number, v.text AS text FROM ({union(parts)}) AS w"


def oracles() -> dict[str, str]:
    census, cc = CENSUS, CENSUS_COLS
    stay_ts = ("fecha_ingreso", "fecha_salida", "timestamp_ntz", "timestamp_ntz")
    summary = validation_summary_sql()
    return {
        "dimensions": dimensions_sql(census, cc),
        "nulls_by_column": nulls_by_column_sql(census, cc),
        "row_completeness": row_completeness_sql(census, cc),
        "nulls_per_row": nulls_per_row_sql(census, cc),
        "missing_ranking": missing_ranking_sql(census, cc),
        "exact_duplicates_documents": exact_duplicates_sql("documents", ["text", "lang", "source", "n_chars"]),
        "exact_duplicates_rows": exact_duplicates_sql("lineitem", LINEITEM_ALL),
        "exact_duplicates_dup_orders": exact_duplicates_sql(duckdb_view("dup_orders"), DUP_ORDERS_COLS),
        "date_layouts": date_layouts_sql(),
        "numeric_summary_persisted": numeric_summary_sql("events", [("user_id", "bigint"), ("value", "double")]),
        "duplicate_examples_documents": duplicate_examples_sql("documents", ["doc_id"], ["text", "lang", "source", "n_chars"]),
        "duplicate_examples_dup_orders": duplicate_examples_sql(duckdb_view("dup_orders"), [], DUP_ORDERS_COLS),
        "duplicate_row_keys_documents": duplicate_row_keys_sql("documents", ["doc_id"], ["text", "lang", "source", "n_chars"]),
        "column_inventory": column_inventory_sql(census, cc),
        "identifier_candidates": identifier_candidates_sql(census, CENSUS_ALL),
        "identifier_candidates_customer": identifier_candidates_sql("customer", CUSTOMER_COLS),
        "empty_constant_columns": empty_constant_sql(census, cc),
        "flagged_columns": flagged_sql(census, cc),
        "type_profile": type_profile_sql(census, "o_orderkey", cc),
        "mixed_type_columns": mixed_type_sql(census, "o_orderkey", cc),
        "fold_text": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
        "category_key": f"SELECT doc_id, {ckey('text')} AS key FROM documents",
        "text_problems": text_problems_sql(census, cc),
        "text_problems_documents": text_problems_sql("documents", DOC_COLS),
        "textual_nulls": textual_nulls_sql(census, cc),
        "category_summary": category_summary_sql(census, cc),
        "category_summary_events": category_summary_sql("events", EVENT_COLS),
        "category_frequencies": category_frequencies_sql(census, cc),
        "category_frequencies_events": category_frequencies_sql("events", EVENT_COLS),
        "equivalent_categories": equivalent_categories_sql(census, cc),
        "category_variants": category_variants_sql(census, cc),
        "profile_job": profile_job_sql(),
        "numeric_summary": numeric_summary_sql("events", [("user_id", "bigint"), ("value", "double")]),
        "numeric_summary_documents": numeric_summary_sql("documents", [("n_chars", "bigint")]),
        "numeric_summary_lineitem": numeric_summary_sql("lineitem", LINEITEM_NUM),
        "numeric_outliers": numeric_outliers_sql("events", ["event_id"], [("user_id", "bigint"), ("value", "double")]),
        "numeric_outliers_documents": numeric_outliers_sql("documents", ["doc_id"], [("n_chars", "bigint")]),
        "date_candidates": date_candidates_sql(census, cc),
        "date_conversion": date_conversion_sql(census, cc),
        "date_failures": date_failures_sql(census, "o_orderkey", cc),
        "converted_dates": converted_dates_sql(census, CENSUS_ALL, ["fecha_ingreso", "fecha_salida"]),
        "temporal_consistency": temporal_consistency_sql(STAY, *stay_ts),
        "temporal_inconsistencies": temporal_inconsistencies_sql(STAY, ["l_orderkey", "l_linenumber", "l_partkey"], *stay_ts),
        "temporal_consistency_census": temporal_consistency_sql(census, "fecha_ingreso", "fecha_salida", "string", "string"),
        "normalize_columns": normalize_columns_sql(),
        "values_preserved": values_preserved_sql(),
        "storage_footprint": storage_sql(census, cc),
        "validation_summary": summary,
        "status_counts": f"SELECT status, CAST(count(*) AS BIGINT) AS checks FROM ({summary}) AS s GROUP BY status",
        "pending_validations": f"SELECT {q('check')}, status, observation FROM ({summary}) AS s WHERE status <> 'OK'",
        "nullify_markers": nullify_sql(census, CENSUS_ALL),
        "stringify_mixed": stringify_sql(census, CENSUS_ALL, {"id_cliente", "valor_total"}),
        "length_of_stay": length_of_stay_sql(),
        "classification_metrics": classification_sql(),
        "regression_metrics": regression_sql(),
        "split_leakage": "SELECT CAST(0 AS BIGINT) AS leaking_groups",
        "explore": explore_sql(),
        "correlations": correlations_sql(),
        "time_split_report": time_split_sql(),
        "baseline_regression": baseline_regression_sql(),
        "calibration": calibration_sql(),
        "subgroup_metrics": subgroup_metrics_sql(),
        "subgroup_effects": subgroup_effects_sql(),
        "bootstrap_intervals": bootstrap_sql(),
        "contribution_summary": contribution_sql(),
        "supported_statements": statements_sql(),
        "cleaning_contract": cleaning_contract_sql(),
        "cleaned_table": cleaned_table_sql(),
        "clean": clean_sql(),
        "clean_report": clean_report_sql(),
        "infer_types": infer_types_sql(),
        "list_members": list_members_sql(),
        "classified_columns": classified_columns_sql(),
        "data_dictionary": data_dictionary_sql(),
        "evidence_manifest": evidence_manifest_sql(),
        "ingestion_metadata": ingestion_metadata_sql(),
        "validation_report": validation_report_sql(),
        "read_headed_table": headed_round_trip_sql(),
    }
