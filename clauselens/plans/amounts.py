"""Money amounts as text: rendering, parsing and filters, over the prices of the given tables.

Amounts are rendered from l_extendedprice in the units of the source documents, so that the parsers run over a whole
table. One parser adds up the units that a text names; the narrower rules keep their own limits.
"""

from clauselens.registry import sql_query

# Units of ten thousand and of a hundred million, and the unit of money.
MAN, EOK, WON = "만", "억", "원"

WORTH = "(SELECT l_orderkey, l_linenumber, CAST(FLOOR(l_extendedprice) AS BIGINT) * 10000 AS v, l_tax FROM lineitem)"
EOKS, MANS = "CAST(FLOOR(v / 100000000) AS BIGINT)", "CAST(FLOOR((v - CAST(FLOOR(v / 100000000) AS BIGINT) * 100000000) / 10000) AS BIGINT)"
RENDERED = (
    f"CASE WHEN v >= 100000000 AND {MANS} > 0 THEN CONCAT(CAST({EOKS} AS VARCHAR(20)), '{EOK} ', CAST({MANS} AS VARCHAR(20)), '{MAN}{WON}') "
    f"WHEN v >= 100000000 THEN CONCAT(CAST({EOKS} AS VARCHAR(20)), '{EOK}{WON}') "
    f"WHEN v >= 10000 THEN CONCAT(CAST({MANS} AS VARCHAR(20)), '{MAN}{WON}') ELSE CONCAT(CAST(v AS VARCHAR(20)), '{WON}') END"
)
TEXTS = f"(SELECT l_orderkey, l_linenumber, v, {RENDERED} AS amount FROM {WORTH} w)"


def part(pattern: str, text: str = "amount") -> str:
    return f"TRY_CAST(NULLIF(REGEXP_EXTRACT(REPLACE(REPLACE({text}, ',', ''), ' ', ''), '{pattern}', 1), '') AS BIGINT)"


def parsed(text: str = "amount") -> str:
    """The value of an amount: the sum of its units, or plain money; null if it has none."""
    units = [(f"([0-9]+){EOK}", 100000000), (f"([0-9]+)천(?:[0-9]+백)?{MAN}", 10000000), (f"([0-9]+)백{MAN}", 1000000), (f"([0-9]+){MAN}", 10000)]
    total = " + ".join(f"COALESCE({part(p, text)}, 0) * {unit}" for p, unit in units)
    return f"COALESCE(NULLIF({total}, 0), {part(f'^([0-9]+){WON}', text)})"


QUERIES = {
    "amount_format": f"SELECT l_orderkey, l_linenumber, {RENDERED} AS amount FROM {WORTH} w",
    "amount_display": f"SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(REGEXP_EXTRACT(amount, '([0-9]+{EOK}[0-9 ]*{MAN}?{WON})', 1), ''), NULLIF(REGEXP_EXTRACT(amount, '([0-9]+{MAN}{WON})', 1), ''), 'none') AS shown FROM {TEXTS} t",
}

for _name, _sql in QUERIES.items():
    sql_query(_name, _sql)
