"""DuckDB SQL with the same rows as the queries of the same name."""

from millrace import sheet_queries

_PARSE = r"""CASE WHEN regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{2}(:\d{2})?)?$') THEN try_strptime(split_part(t, ' ', 1), '%Y-%m-%d') WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(t, '%m/%d/%Y')
    WHEN regexp_matches(t, '^\d{1,2}-\d{1,2}-\d{4}$') THEN try_strptime(t, '%m-%d-%Y') WHEN regexp_matches(t, '^\d{8}$') THEN try_strptime(t, '%Y%m%d') WHEN regexp_matches(t, '^\d{5}$') THEN (DATE '1899-12-30' + t::INT)::TIMESTAMP END"""
#: A text as an exact amount: marks, digits with groups of three, parentheses and per cent.
_AMOUNT = r"""CASE WHEN regexp_matches(t, '^[-+$(]*(\d{1,3}(,\d{3})+|\d+)(\.\d*)?[)%]*$') AND contains(t, '(') = contains(t, ')')
    THEN (CASE WHEN contains(t, '(') OR starts_with(t, '-') THEN -1 ELSE 1 END * regexp_replace(t, '[^0-9.]', '', 'g')::DECIMAL(24,4) * CASE WHEN contains(t, '%') THEN 0.01 ELSE 1 END)::DECIMAL(38,10) END"""
_RAW_DATES = """r AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d.%-m.%Y')
    WHEN 3 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 4 THEN strftime(o_orderdate, '%Y%m%d') WHEN 5 THEN date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::VARCHAR WHEN 6 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 7 THEN '13/45/1996' END AS raw FROM orders),
    s AS (SELECT *, trim(raw) AS t FROM r),
    p AS (SELECT o_orderkey, raw, day, strftime(""".replace("\\\\", "\\") + _PARSE + """, '%Y-%m-%d') AS parsed FROM s)"""


def _of(sql: str, column: str) -> str:
    """The expression of another column than t."""
    return sql.replace("(t,", f"({column},").replace("t::INT", f"{column}::INT")


_TOTALS = """r AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    u AS (SELECT *, o_orderstatus AS line FROM r UNION ALL SELECT c_mktsegment, 'TOTAL', sum(n)::BIGINT, sum(value), 'Z' FROM r GROUP BY 1),
    a AS (SELECT *, count(*) OVER w >= 3 AND abs(2 * n - sum(n) OVER w) <= 0.01 AND abs(2 * value::DOUBLE - (sum(value) OVER w)::DOUBLE) <= greatest(0.01, 2 * value::DOUBLE * 1e-6) AS agrees FROM u WINDOW w AS (PARTITION BY c_mktsegment)),
    t AS (SELECT *, agrees AND row_number() OVER (PARTITION BY c_mktsegment, agrees ORDER BY line DESC) = 1 AS is_total FROM a)"""
_NAMES = """b AS (SELECT CASE WHEN c_custkey % 11 > 0 THEN CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN '  ' || c_name || ' ' ELSE c_name END END AS account, c_mktsegment, c_nationkey FROM customer),
    o AS (SELECT o_orderkey, c_name || ' ' AS buyer FROM orders JOIN customer ON o_custkey = c_custkey)"""
_INVALID = f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'abc' ELSE '1.5' END AS n FROM orders)
    SELECT o_orderkey, concat_ws(',', CASE WHEN d IS NOT NULL AND {_of(_PARSE, "d")} IS NULL THEN 'd' END, CASE WHEN n IS NOT NULL AND {_of(_AMOUNT, "n")} IS NULL THEN 'n' END) AS invalid_columns FROM r"""


def _profile(table: str, columns: dict[str, str], by: str = "") -> str:
    """columns: name and kind (int, float or text) of each; kind decides how extremes and sums are written."""
    plain = lambda x: f"CASE WHEN contains(({x})::VARCHAR, '.') THEN regexp_replace(({x})::VARCHAR, '\\.?0+$', '') ELSE ({x})::VARCHAR END"
    parts = []
    for c, kind in columns.items():
        dtype = {"bigint": "bigint", "int": "int", "double": "double", "string": "string"}[kind]
        low, high = (plain(f"{f}({c})::DECIMAL(38,6)") for f in ("min", "max")) if kind == "double" else (f"{f}({c})::VARCHAR" for f in ("min", "max"))
        total = "'NA'" if kind == "string" else plain(f"sum({c}::VARCHAR::DECIMAL(38,6))")
        group = f"{by}, " if by else ""
        parts.append(f"""SELECT {group}'{c}' AS column_name, '{dtype}' AS datatype, count(DISTINCT {c}) AS distinct_count, count({c}) AS present, count(*) AS total, coalesce({low}, 'NA') AS low, coalesce({high}, 'NA') AS high,
            coalesce({total}, 'NA') AS sum, printf('%.2f', (count(*) - count({c})) * 100.0 / count(*)) AS null_percentage FROM {table}{f" GROUP BY {by}" if by else ""}""")
    return " UNION ALL ".join(parts)


_LEFT = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
_RIGHT = {"s_suppkey": "s_suppkey::VARCHAR", "s_name": "s_name", "s_nationkey": "s_nationkey::VARCHAR", "s_acctbal": "s_acctbal::VARCHAR"}
_OVERLAP = f"""l AS ({" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS c, lower(trim({c}::VARCHAR)) AS v FROM lineitem" for c in _LEFT)}), q AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, lower(trim({v})) AS v FROM supplier" for c, v in _RIGHT.items())}),
    r AS (SELECT DISTINCT c, v FROM q), t AS (SELECT c, count(v) AS tried FROM l GROUP BY 1), u AS (SELECT c, count(v) = count(DISTINCT v) AS right_unique FROM q GROUP BY 1),
    o AS (SELECT l.c AS left_column, r.c AS right_column, tried, count(*) AS found, round(count(*) / tried, 6) AS share FROM l JOIN r ON l.v = r.v JOIN t ON t.c = l.c GROUP BY 1, 2, 3)"""
_KINDS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")}


def _roles() -> str:
    """Counts of each table's columns by what they hold: numbers by their type, dates by their name."""
    parts = []
    for table, columns in _KINDS.items():
        held = []
        for c in columns:
            number = not any(w in c for w in ("name", "segment", "brand", "type", "status", "priority", "flag", "date"))
            fine = f"coalesce(bool_or({c} % 1 <> 0 OR {c} < 0), false)" if number else "false"
            held.append(f"SELECT '{c}' AS c, {number} AS number, {fine} AS fine, count(DISTINCT {c}) >= 0.9 * count({c}) AS near, count({c}) >= 2 AS several FROM {table}")
        dates = sum("date" in c for c in columns)
        parts.append(f"""SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS rows, count_if(several AND number AND (fine OR NOT near))::BIGINT AS measures, count_if(several AND near)::BIGINT AS keys, {dates}::BIGINT AS dates,
            (SELECT coalesce(max(n) = 1, true) FROM (SELECT count(*) AS n FROM {table} GROUP BY ALL, {", ".join(columns)})) AS unique_rows FROM ({" UNION ALL ".join(held)})""".replace("GROUP BY ALL, ", "GROUP BY "))
    return f"""WITH e AS ({" UNION ALL ".join(parts)}) SELECT *, CASE WHEN rows = 0 THEN 'UNKNOWN' WHEN measures > 0 AND (keys > 0 OR dates > 0) THEN 'FACT' WHEN measures = 0 AND unique_rows AND rows <= 200 AND keys > 0 THEN 'DIMENSION' ELSE 'UNKNOWN' END AS role FROM e"""


_EXPORT = """x AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, o_orderdate AS day, format('{:,.2f}', o_totalprice) AS price, o_totalprice FROM orders)"""
_SILVER = f"""r AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k, o_orderdate AS day, format('{{:,.2f}}', o_totalprice) AS price FROM orders),
    c AS (SELECT o_orderkey AS order_number, CASE WHEN k <> 5 THEN 'Acc ' || o_custkey END AS account,
        CASE k WHEN 0 THEN strftime(day, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(day, '%-m/%-d/%Y') WHEN 2 THEN strftime(day, '%Y%m%d') WHEN 3 THEN '31/31/2020' ELSE strftime(day, '%-m-%-d-%Y') END AS b,
        CASE k WHEN 0 THEN '($' || price || ')' WHEN 4 THEN '5-' ELSE price END AS a, ((o_custkey % 100) * 0.01)::DECIMAL(10,6) AS rate, CASE WHEN k = 1 THEN month(day) END AS named_month, CASE WHEN k = 2 THEN NULL ELSE k < 2 END AS urgent, k = 2 AS bad_flag FROM r),
    d AS (SELECT *, ({_of(_PARSE, "b")})::DATE AS booked, ({_of(_AMOUNT, "a")})::DECIMAL(18,2) AS amount FROM c),
    s AS (SELECT order_number, account, strftime(booked, '%Y-%m-%d') AS booked, amount::VARCHAR AS amount, rate::VARCHAR AS rate, year(booked)::INT AS booked_year, coalesce(named_month, month(booked))::INT AS booked_month, urgent, NULL::VARCHAR AS unmapped,
        concat_ws(',', CASE WHEN b IS NOT NULL AND booked IS NULL THEN 'booked' END, CASE WHEN a IS NOT NULL AND amount IS NULL THEN 'amount' END, CASE WHEN bad_flag THEN 'urgent' END) AS invalid_columns FROM d)"""

_GAPPED = """g AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::DECIMAL(18,2) END AS price FROM orders)"""

ORACLES: dict[str, str] = {
    "monthly_rollup": """
        WITH g AS (SELECT n_name, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR AS price, sum(l_discount::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR AS discount,
            sum(l_tax::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR AS tax, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
        SELECT *, sha256(concat_ws('|', n_name, month, price, orders::VARCHAR)) AS row_hash FROM g""",
    "column_profile_lineitem": _profile("lineitem", {
        "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string"}),
    "column_profile_orders": "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders) " + _profile("o", {"o_orderkey": "bigint", "o_totalprice": "double", "priority": "string"}, "o_orderstatus"),
    "month_stats": """
        SELECT CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS rows, round(avg((o_orderstatus <> 'O')::INT) * 100, 2) AS shipped, round(avg((o_orderkey % 4 > 0)::INT) * 100, 2) AS booked
        FROM orders WHERE o_orderkey % 10 > 0 AND o_orderdate IS NOT NULL GROUP BY 1""",
    "date_ladder": f"WITH {_RAW_DATES} SELECT o_orderkey, raw, parsed FROM p",
    "date_role_stats": f"""
        WITH {_RAW_DATES} SELECT 'spelled' AS role, count(*) AS rows, count(parsed) AS populated, count_if(raw IS NOT NULL AND parsed IS NULL)::BIGINT AS invalid, min(parsed) AS first_day, max(parsed) AS last_day, round(count(parsed) * 100.0 / count(*), 2)::DOUBLE AS readable FROM p
        UNION ALL SELECT 'plain', count(*), count(day), 0, strftime(min(day), '%Y-%m-%d'), strftime(max(day), '%Y-%m-%d'), 100.0 FROM p""",
    "amount_parse": f"""
        WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS v, CASE l_linenumber % 8 WHEN 0 THEN v::VARCHAR WHEN 1 THEN '$' || format('{{:,.2f}}', l_extendedprice) WHEN 2 THEN '(' || v::VARCHAR || ')'
            WHEN 3 THEN v::VARCHAR || '%' WHEN 4 THEN ' ' || format('{{:,.2f}}', l_extendedprice) || ' ' WHEN 5 THEN v::VARCHAR || '-' WHEN 6 THEN '1,23,4.5' END AS raw FROM lineitem),
        t AS (SELECT l_orderkey, l_linenumber, raw, trim(raw) AS t FROM r), a AS (SELECT *, {_AMOUNT} AS x FROM t)
        SELECT l_orderkey, l_linenumber, raw, round(x, 2)::DECIMAL(18,2)::VARCHAR AS amount, CASE WHEN abs(x) < 1000000 THEN round(x, 1)::DECIMAL(7,1)::VARCHAR END AS short FROM a""",
    "bool_int_parse": f"""
        WITH r AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN ' f ' WHEN 2 THEN '1' WHEN 3 THEN o_custkey || '.0' WHEN 4 THEN o_custkey || '.5' WHEN 5 THEN 'n/a' WHEN 6 THEN o_custkey || '%' WHEN 7 THEN '0.0' END AS raw FROM orders),
        t AS (SELECT *, lower(trim(raw)) AS t FROM r), a AS (SELECT *, CASE WHEN NOT contains(t, '%') THEN {_AMOUNT} END AS x FROM t)
        SELECT o_orderkey, raw, CASE WHEN t IN ('true', 't', 'yes', 'y', '1', '1.0') THEN true WHEN t IN ('false', 'f', 'no', 'n', '0', '0.0') THEN false END AS flag, CASE WHEN x = floor(x) THEN x::BIGINT END AS number FROM a""",
    "invalid_names": _INVALID,
    "invalid_counts": f"WITH i AS ({_INVALID}) SELECT column_name, count(*) AS n FROM (SELECT unnest(string_split(invalid_columns, ',')) AS column_name FROM i) WHERE column_name <> '' GROUP BY 1",
    "row_hash": """
        SELECT c_custkey, sha256(concat(lower(trim(c_name)), chr(31), coalesce(CASE WHEN c_custkey % 4 > 0 THEN lower(trim(c_mktsegment)) END, ''), chr(31), c_acctbal::DECIMAL(18,2)::DECIMAL(38,6)::VARCHAR)) AS row_hash FROM customer""",
    "unpivot_measures": """
        WITH q AS (SELECT o_orderstatus, 'Quarter ' || quarter(o_orderdate) AS period, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2) SELECT * FROM q""",
    "unpivot_all_years": """
        SELECT o_orderstatus, year(o_orderdate)::INT AS year, coalesce('Quarter ' || quarter(o_orderdate), 'Undated') AS period, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR AS value FROM orders GROUP BY 1, 2, 3 HAVING sum(o_totalprice) IS NOT NULL""",
    "total_rows_detect": f"WITH {_TOTALS} SELECT c_mktsegment, o_orderstatus, n, value::DECIMAL(28,2)::VARCHAR AS value, is_total FROM t",
    "total_column_detect": """
        WITH s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, sum(l_quantity) AS t FROM lineitem GROUP BY 1),
        m AS (SELECT 'a' AS measure, a AS v, n + r + t AS o, 0 AS b, false AS later FROM s UNION ALL SELECT 'n', n, a + r + t, a, false FROM s UNION ALL SELECT 'r', r, a + n + t, a + n, true FROM s UNION ALL SELECT 'all_', t, a + n + r, a + n + r, true FROM s),
        x AS (SELECT measure, round(coalesce(count_if(v <> 0 AND abs(v - o) <= greatest(0.01, abs(v) * 1e-6)) / nullif(count_if(v <> 0), 0), 0), 6) AS of_others,
            round(coalesce(CASE WHEN bool_or(later) THEN count_if(v <> 0 AND abs(v - b) <= greatest(0.01, abs(v) * 1e-6)) / nullif(count_if(v <> 0), 0) END, 0), 6) AS of_before FROM m GROUP BY 1)
        SELECT *, greatest(of_others, of_before) >= 0.95 AS is_total FROM x""",
    "running_total_check": """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS price FROM lineitem), u AS (SELECT * FROM r UNION ALL SELECT l_orderkey, 99, sum(price)::DECIMAL(18,2) FROM r GROUP BY 1),
        s AS (SELECT *, (sum(price) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DECIMAL(28,2) AS b FROM u)
        SELECT l_orderkey, l_linenumber, price::VARCHAR AS price, b::VARCHAR AS sum_before, coalesce(abs(price - b) <= 0.01, false) AS is_subtotal FROM s""",
    "fill_down": """
        SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN 's' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events""",
    "islands": """
        WITH e AS (SELECT event_id, event_id // 1000 AS sheet FROM events WHERE event_type IN ('view', 'click')), r AS (SELECT *, event_id - row_number() OVER (PARTITION BY sheet ORDER BY event_id) AS run FROM e),
        g AS (SELECT sheet, run, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM r GROUP BY 1, 2) SELECT sheet, first, last, size, row_number() OVER (PARTITION BY sheet ORDER BY first)::INT AS island FROM g""",
    "companion_join_left": f"WITH {_NAMES} SELECT o_orderkey, account, c_mktsegment AS segment FROM o LEFT JOIN b ON lower(trim(buyer)) = lower(trim(account))",
    "companion_join_inner": f"WITH {_NAMES} SELECT o_orderkey, account, c_nationkey AS nation FROM o JOIN b ON lower(trim(buyer)) = lower(trim(account))",
    "companion_join_right": f"WITH {_NAMES} SELECT account, o_orderkey FROM b LEFT JOIN o ON lower(trim(buyer)) = lower(trim(account))",
    "join_match_stats": f"WITH {_NAMES} SELECT count(*) AS rows, count(account) AS matched, count(*) - count(account) AS unmatched FROM o LEFT JOIN b ON lower(trim(buyer)) = lower(trim(account))",
    "dup_key_report": "SELECT l_partkey, l_suppkey, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY times DESC, 1, 2 LIMIT 20",
    "lookup_resolve": r"""
        WITH f AS (SELECT s_suppkey, s_suppkey % 6 AS k, n_nationkey, n_name, CASE WHEN k IN (1, 3) THEN NULL WHEN k = 4 THEN '999' WHEN k = 5 THEN 'PC-' || (n_nationkey + 1) ELSE n_nationkey::VARCHAR END AS number,
            CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 'n/a' WHEN k = 4 THEN 'Nobody' WHEN k = 5 THEN n_name || '  old' ELSE ' ' || lower(n_name) END AS name, 'PC0' || (s_suppkey % 30) AS pc FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        c AS (SELECT s_suppkey, CASE WHEN lower(trim(name)) NOT IN ('', 'n/a', 'null', 'none') THEN trim(name) END AS name, regexp_replace(lower(name), '\s+', ' ', 'g') AS key, lpad(regexp_replace(number, '^PC-', ''), 4, '0') AS number, lpad(regexp_replace(pc, '^PC0*(.)', '\1'), 4, '0') AS pc FROM f),
        e AS (SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS number, n_name AS name, true AS live FROM nation UNION ALL SELECT lpad(n_nationkey::VARCHAR, 4, '0'), n_name || ' OLD', false FROM nation),
        named AS (SELECT lower(name) AS key, first(number ORDER BY live DESC, number, name) AS its_number FROM e GROUP BY 1), numbered AS (SELECT number, first(name ORDER BY live DESC, name) AS its_name FROM e GROUP BY 1)
        SELECT s_suppkey, CASE WHEN c.name IS NULL AND c.number IS NULL THEN numbered.number ELSE coalesce(its_number, c.number) END AS ref_number, coalesce(c.name, its_name) AS ref_name,
            CASE WHEN c.name IS NOT NULL THEN CASE WHEN its_number IS NULL THEN 'no_match' WHEN c.number IS NULL THEN 'filled_number' WHEN c.number = its_number THEN 'kept' ELSE 'corrected' END
                 WHEN c.number IS NOT NULL THEN 'name_missing' WHEN its_name IS NOT NULL THEN 'filled_name' ELSE 'no_match' END AS outcome
        FROM c LEFT JOIN named ON trim(c.key) = named.key AND c.name IS NOT NULL LEFT JOIN numbered ON c.name IS NULL AND c.number IS NULL AND c.pc = numbered.number""",
    "key_overlap": f"WITH {_OVERLAP} SELECT * FROM o",
    "key_overlap_best": f"""WITH {_OVERLAP}, b AS (SELECT *, row_number() OVER (PARTITION BY left_column ORDER BY share DESC, right_column) AS nth FROM o WHERE share >= 0.5)
        SELECT left_column, b.right_column, tried, found, share, right_unique FROM b JOIN u ON u.c = b.right_column WHERE nth = 1""",
    "period_overlap": """
        WITH s AS (SELECT o_custkey, o_orderstatus AS id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1, 2)
        SELECT x.o_custkey, x.id, y.id AS other_id, x.a <= y.a AND x.b >= y.b AS covers FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.a <= y.b AND y.a <= x.b AND x.id < y.id""",
    "stack_with_provenance": "SELECT coalesce(year(o_orderdate)::VARCHAR, 'undated') AS source_sheet, o_orderkey, o_totalprice AS value FROM orders",
    "role_classify": _roles(),
    "grain_signals": f"""WITH {_TOTALS} SELECT 2 AS measures, 2 AS dimensions, NULL::VARCHAR AS total_column, count_if(is_total)::BIGINT AS total_rows, count_if(is_total) > 0 AS totals, true AS mostly_amounts, count_if(is_total) > 0 AS aggregated FROM t""",
    "typed_columns": f"""WITH {_EXPORT} SELECT o_orderkey AS "order", 'C-' || o_custkey AS account, strftime(day, '%Y-%m-%d') AS booked, CASE WHEN k = 1 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END::DOUBLE AS amount, round(o_totalprice, 2)::DOUBLE AS betrag,
        lpad((o_orderkey % 90000)::VARCHAR, 5, '0') AS zip, CASE WHEN k <> 3 THEN o_custkey % 50 END AS count, CASE WHEN k = 1 THEN '12AB' ELSE o_custkey::VARCHAR END AS mixed, strftime(day, '%Y-%m-%d') AS ship_date, NULL::VARCHAR AS nothing FROM x""",
    "silver_transform": f"""WITH {_SILVER} SELECT *, sha256(order_number || chr(31) || coalesce(lower(account), '')) AS business_key_hash,
        sha256(concat(order_number, chr(31), coalesce(lower(account), ''), chr(31), coalesce(booked, ''), chr(31), coalesce(amount::DECIMAL(38,6)::VARCHAR, ''), chr(31), rate::DECIMAL(38,6)::VARCHAR, chr(31), coalesce(booked_year::VARCHAR, ''), chr(31), coalesce(booked_month::VARCHAR, ''), chr(31), coalesce(urgent::VARCHAR, ''), chr(31))) AS row_hash FROM s""",
    "silver_quality": f"""WITH {_SILVER} SELECT t.name AS target, count(*) AS rows, count(CASE t.name WHEN 'order_number' THEN order_number::VARCHAR WHEN 'account' THEN account WHEN 'booked' THEN booked WHEN 'amount' THEN amount WHEN 'rate' THEN rate WHEN 'booked_year' THEN booked_year::VARCHAR WHEN 'booked_month' THEN booked_month::VARCHAR
        WHEN 'urgent' THEN urgent::VARCHAR END) AS filled, count_if(list_contains(string_split(invalid_columns, ','), t.name))::BIGINT AS invalid FROM s, (SELECT unnest(['order_number', 'account', 'booked', 'amount', 'rate', 'booked_year', 'booked_month', 'urgent', 'unmapped']) AS name) t GROUP BY 1""",
    "unpivot_spread": """SELECT year(o_orderdate)::INT AS year, coalesce('Quarter ' || quarter(o_orderdate), 'Undated') AS period, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F')::DECIMAL(28,2)::VARCHAR AS F, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O')::DECIMAL(28,2)::VARCHAR AS O,
        sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'P')::DECIMAL(28,2)::VARCHAR AS P FROM orders GROUP BY 1, 2""".replace(" FILTER (", " FILTER (WHERE "),
    "schema_evolve_append": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN o_orderpriority END AS o_orderpriority FROM orders",
    "replace_supersede": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN o_orderstatus END AS load_id FROM orders)
        SELECT * FROM o WHERE load_id IS NULL OR load_id NOT IN ('P', 'O') UNION ALL SELECT o_orderkey, 'O2' FROM o WHERE load_id = 'O'""",
    "replace_month": """
        WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders)
        SELECT * FROM o WHERE month IS NULL OR NOT (o_orderstatus IN ('O', 'F') AND month IN ('1996-03', '1997-11'))""",
    "replace_rollup": "SELECT o_orderstatus, count(*) + CASE WHEN o_orderstatus = 'P' THEN 1000 ELSE 0 END AS n FROM orders GROUP BY 1",
    "preview_search_sort": """
        SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size END AS size, p_type FROM part
        WHERE contains(lower(concat_ws(chr(31), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'gear') ORDER BY size DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 10""",
    "first_samples": """
        WITH s AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id)::INT AS nth FROM s) SELECT user_id, event_type, nth FROM r WHERE nth <= 3""",
    "header_names": """
        WITH h AS (SELECT p_partkey, concat(CASE WHEN p_partkey % 4 = 0 THEN '2 ' ELSE ' ' END, p_type, ' (%)') AS header FROM part),
        s AS (SELECT *, trim(regexp_replace(lower(trim(header)), '[^a-z0-9]+', '_', 'g'), '_') AS b, CASE WHEN regexp_matches(b, '^[0-9]+$') THEN 'col_' || b ELSE b END AS name FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS nth FROM s)
        SELECT p_partkey, CASE WHEN nth > 1 THEN name || '_' || nth ELSE name END AS name, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS loose FROM r""",
    "pc_pad": """
        WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS n, CASE WHEN length(c_custkey::VARCHAR) >= 4 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 4, '0') END AS p FROM customer)
        SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN p WHEN 1 THEN CASE WHEN length(n) <= 2 THEN p ELSE '00' || n END WHEN 2 THEN p || '_01' WHEN 3 THEN 'X' || n END AS code FROM c""",
    "name_keys": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lower(s_name) || ' - east' WHEN 2 THEN lower(s_name) || ' co' END AS name_key FROM supplier",
    "history_runs": """
        SELECT user_id, min(event_id) AS first_id, count(*) AS events FROM events GROUP BY 1 HAVING bool_or(event_type = 'error') AND count(*) >= 3 ORDER BY first_id DESC LIMIT 20""",
    "vector_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0",
    "contracts_rows": f"WITH {_TOTALS} SELECT c_mktsegment, count(*) AS raw, count_if(is_total)::BIGINT AS removed, count_if(NOT is_total)::BIGINT AS kept, 0::BIGINT AS unaccounted FROM t GROUP BY 1",
    "empty_columns": "SELECT unnest(['nothing', 'none']) AS column_name",
    "null_safe_changes": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS before, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS after FROM orders) SELECT * FROM o WHERE before IS DISTINCT FROM after""",
    "missing_keys": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    "rows_per_month": "SELECT o_orderstatus AS pc, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows FROM orders GROUP BY 1, 2",
    "row_change_check": """
        WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS old_rows, count_if(o_orderkey % 7 > 0) + count_if(month(o_orderdate) = 1) AS new_rows FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
        SELECT month, new_rows::BIGINT AS new_rows, old_rows, round((new_rows - old_rows) * 100.0 / old_rows, 2)::DOUBLE AS change FROM o WHERE abs(round((new_rows - old_rows) * 100.0 / old_rows, 2)) > 10""",
    "common_priority": f"""WITH {_GAPPED}, t AS (SELECT o_custkey, priority, count(*) AS times, min(o_orderkey) AS first_key FROM g WHERE priority IS NOT NULL GROUP BY 1, 2)
        SELECT o_custkey, priority, times FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY times DESC, first_key) = 1""",
    "null_findings": f"""WITH {_GAPPED}, n AS (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_custkey', 'day', 'priority', 'price']) AS column_name, unnest([count(*) - count(o_orderkey), count(*) - count(o_orderstatus), count(*) - count(o_custkey), count(*) - count(day), count(*) - count(priority), count(*) - count(price)]) AS nulls,
        count(*) AS rows FROM g) SELECT column_name, nulls, round(nulls / rows, 3)::DOUBLE AS rate FROM n WHERE nulls > 0""",
    "fill_mode": f"""WITH {_GAPPED}, f AS (SELECT o_custkey, (priority IS NOT NULL)::INT + (price IS NOT NULL)::INT + (day IS NOT NULL)::INT AS fill FROM g), t AS (SELECT o_custkey, fill, count(*) AS times FROM f WHERE fill > 0 GROUP BY 1, 2)
        SELECT o_custkey, fill AS modal_fill FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY times DESC, fill DESC) = 1""",
    "fitness": f"WITH {_GAPPED} SELECT o_orderstatus, count(price) AS checks, round(count_if(price > 100000) * 100.0 / nullif(count(price), 0), 2)::DOUBLE AS fitness FROM g GROUP BY 1",
    "as_text": """SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice::DECIMAL(18,2)::VARCHAR AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "ranked_candidates": """WITH v AS (SELECT l_suppkey, l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS nth, score - coalesce(lead(score) OVER w, 0) AS lead FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY score DESC, l_returnflag))
        SELECT l_suppkey, l_returnflag, score, lead FROM r WHERE nth = 1 AND score >= 10 AND lead >= 5""",
    "division_lookup": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 > 0 THEN r_name ELSE '' END AS divisions FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
}
ORACLES["outcome_counts"] = f"SELECT outcome, count(*) AS rows FROM ({ORACLES['lookup_resolve']}) GROUP BY 1"
ORACLES |= sheet_queries.ORACLES
