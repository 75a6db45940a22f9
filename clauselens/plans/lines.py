"""Text, grid and name operators over the lines of documents and over names, paths and replies of the given tables."""

from clauselens.registry import sql_query

SPARK_LINES = "(SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, line)"
DUCK_LINES = "(SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS line_no, parts[pos + 1] AS line FROM (SELECT doc_id, lang, source, parts, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)))"
SPARK_CELLS, DUCK_CELLS = "filter(transform(split(line, '[|]'), c -> trim(c)), c -> c <> '')", "list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '')"

# Read alike by both engines, over @lines.
LINES = {
    "text_blocks": "SELECT doc_id, line_no, TRIM(line) AS block, LENGTH(TRIM(line)) AS n FROM @lines t WHERE LENGTH(TRIM(line)) >= 20",
    "win_line_context": "SELECT doc_id, line_no, before_1, line, after_1, after_2 FROM (SELECT doc_id, line_no, line, LAG(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before_1, LEAD(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS after_1, LEAD(line, 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS after_2 FROM @lines t) u WHERE LOWER(line) LIKE '%license%'",
}
for _name, _sql in LINES.items():
    sql_query(_name, _sql.replace("@lines", SPARK_LINES), _sql.replace("@lines", DUCK_LINES))

# One text for both engines.
SAME = {
    "filter_regex": "SELECT o_orderkey FROM orders WHERE REGEXP_EXTRACT(o_orderpriority, '^([12]-)', 1) <> ''",
    "resume_todo": "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL",
}
for _name, _sql in SAME.items():
    sql_query(_name, _sql)

_USED = f"SELECT doc_id, line_no, @size AS n_cells, @join AS cells FROM @lines t WHERE line LIKE '%|%'"
sql_query("grid_clean", _USED.replace("@size", f"size({SPARK_CELLS})").replace("@join", f"array_join({SPARK_CELLS}, '|')").replace("@lines", SPARK_LINES), _USED.replace("@size", f"len({DUCK_CELLS})").replace("@join", f"array_to_string({DUCK_CELLS}, '|')").replace("@lines", DUCK_LINES))
sql_query("name_cell", f"SELECT doc_id, line_no, try_element_at(filter(slice({SPARK_CELLS}, 1, 3), c -> length(c) > 2 AND NOT c RLIKE '^[0-9.,]+$'), 1) AS name FROM {SPARK_LINES} t WHERE line LIKE '%|%'", f"SELECT doc_id, line_no, list_filter(({DUCK_CELLS})[1:3], lambda c: length(c) > 2 AND NOT regexp_matches(c, '^[0-9.,]+$'))[1] AS name FROM {DUCK_LINES} t WHERE line LIKE '%|%'")
sql_query("agg_array_filter", "SELECT l_orderkey, array_join(transform(sort_array(collect_set(CASE WHEN l_returnflag = 'R' THEN l_partkey END)), x -> CAST(x AS STRING)), ',') AS parts FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, COALESCE(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R')), ','), '') AS parts FROM lineitem GROUP BY l_orderkey")
sql_query("nest_children", "SELECT conv_id, array_join(transform(sort_array(collect_list(struct(turn, role))), x -> concat(CAST(x.turn AS STRING), ':', x.role)), ',') AS turns FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(concat(turn, ':', role), ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id")
sql_query("filter_array_overlap", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING arrays_overlap(collect_set(l_linenumber), array(6, 7))", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_has_any(list(l_linenumber), [6, 7])")
sql_query("age_asof", "SELECT o_orderkey, CAST(FLOOR(months_between(DATE '2024-01-01', CAST(o_orderdate AS DATE)) / 12) AS BIGINT) AS years FROM orders", "SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-01-01') AS BIGINT) AS years FROM orders")
