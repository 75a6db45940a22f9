"""Listings, forms and JSON values over files that Spark writes of the given tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators import forms, parsing
from clauselens.operators.rounds import folder, spread
from clauselens.plans import names, rendered
from clauselens.registry import ORACLE_SQL, query, table
from clauselens.sources import files, nested

# Listings.
_CODES = list(parsing.CARRIERS.values())
_KINDS = ["terms", "proposal", "easy_summary"]


@query(
    f"""WITH d AS (SELECT doc_id, source, regexp_extract(source, '[0-9]+')::BIGINT % 8 AS c, doc_id % 3 AS kind, doc_id % 2 AS v FROM documents WHERE source IS NOT NULL),
       named AS (SELECT doc_id, {[*_CODES]}[c + 1] AS folder, {_KINDS}[kind + 1] AS doc_type, CASE WHEN kind = 2 THEN 'easy_summary' WHEN v = 1 THEN 'female' END AS doc_subtype FROM d)
       SELECT folder || '-' || doc_type || CASE WHEN doc_type <> 'easy_summary' AND doc_subtype IS NOT NULL THEN '-' || doc_subtype ELSE '' END AS document_id, folder, folder AS carrier, doc_type, doc_subtype, any_value(product_code) AS product_code, any_value(n) AS n
       FROM named JOIN (SELECT folder, 'P-' || folder AS product_code, count(*) AS n FROM named GROUP BY ALL) USING (folder) WHERE folder <> 'kb' GROUP BY ALL"""
)
def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of carriers with files named by kind and variant, decomposed as some file systems do, and the information of each folder; one has none."""
    path, c = folder(spark), F.regexp_extract("source", "([0-9]+)", 1).cast("long") % 8
    kind, said = F.col("doc_id") % 3, F.array(F.lit("약관"), F.lit("가입설계서"), F.lit("쉬운요약서"))
    carrier, code = (F.array(*map(F.lit, x)) for x in (parsing.CARRIERS, _CODES))
    name = F.concat(F.get(carrier, c), F.lit("_"), F.get(said, kind.cast("int")), F.when(F.col("doc_id") % 2 == 1, "(여자)").otherwise(""), F.lit("_2511.pdf"))
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", F.get(code, c.cast("int")).alias("folder"), name.alias("name"))
    # Spark names the files that it writes itself, so that a folder stands for a file: its parts are listed.
    docs.repartition("folder", "name").write.partitionBy("folder", "name").json(f"{path}/files")
    counts = docs.groupBy("folder").agg(F.count("*").alias("n")).filter("folder <> 'kb'")
    counts.select("folder", F.concat(F.lit("P-"), "folder").alias("product_code"), "n").repartition("folder").write.partitionBy("folder").json(f"{path}/info")
    listed = files.listed(spark, f"{path}/files", "*.json").select(F.regexp_extract("file_path", "/folder=([^/]+)/", 1).alias("folder"), F.regexp_extract("file_path", "/name=([^/]+)/", 1).alias("file_name")).distinct()
    info = files.folder_info(spark, f"{path}/info", "product_code string, n long", "*.json").withColumn("folder", F.substring_index("folder", "=", -1))
    found = files.documents(listed.withColumn("file_path", F.col("file_name")), info)
    return found.select("document_id", "folder", "carrier", "doc_type", "doc_subtype", "product_code", "n").distinct()


# Forms.
_FORM_SQL = """
    SELECT o_orderkey, 1 AS row_no, '계약 사항_피보험자' AS field, '고객(650407-' || CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END || '******) ' || (20 + o_custkey % 50) || '세' AS value FROM orders
    UNION ALL SELECT o_orderkey, 2, '계약 사항_보험기간', '100세만기/20년납' FROM orders
    UNION ALL SELECT o_orderkey, 4, '계약 사항_' || CASE WHEN o_orderkey % 5 = 0 THEN '보험수익자에게 지급' ELSE '직업' END, '보장보험료 합계' FROM orders
    UNION ALL SELECT o_orderkey, 4, '계약 사항_' || CASE WHEN o_orderkey % 5 = 0 THEN '연간 1회에 한하여' ELSE '사무직 1급' END, floor(o_totalprice)::BIGINT || ' 원' FROM orders
    UNION ALL SELECT o_orderkey, 6, '계약 사항_' || unnest(['성별', '나이', '면적']), unnest(['남 / ' || (20 + o_custkey % 50) || '세', (20 + o_custkey % 50) || '세', o_custkey::VARCHAR || '0']) FROM orders
    UNION ALL SELECT o_orderkey, 9, '추가 사항_직업', (1 + o_orderkey % 3) || '급' FROM orders
"""


@query(_FORM_SQL)
def form_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of forms with sections, keys beside values, header rows over data rows (a row of labels takes the row below it), and a second section."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    age = F.concat((20 + F.col("o_custkey") % 50).cast("string"), F.lit("세"))
    more = {
        6: ["성별", "나이", "", "면적", "", ""], 7: [F.concat(F.lit("남 / "), age), "", age, "", F.concat(F.col("o_custkey").cast("string"), F.lit("0")), ""], 8: ["추가 사항", "", "", "", "", ""],
        9: ["", "직업", "", F.concat((1 + F.col("o_orderkey") % 3).cast("string"), F.lit("급")), "", ""], 10: ["※ 참고", "", "", "", "", ""],
    }
    cells = {i: F.expr(rendered.in_spark(row)) for i, row in enumerate(names._FORM)} | {i: F.array(*(F.lit(c) if isinstance(c, str) else c for c in row)) for i, row in more.items()}
    # A form's rows are made where its order is, so that no row is shuffled.
    rows = orders.select("o_orderkey", F.inline(F.array(*(F.struct(F.lit(i).alias("row_no"), row.alias("cells")) for i, row in cells.items()))))
    return forms.key_values(rows, ["o_orderkey"])


@query()
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the grids of documents: the lines with bars of a page are a table."""
    rows = nested.lines(spark, sf_dir).filter(F.col("line").contains("|"))
    return forms.key_values(rows.select("doc_id", "page", F.col("i").alias("row_no"), F.transform(F.split("line", "[|]"), lambda c: F.trim(c)).alias("cells")), ["doc_id", "page"])


# JSON.
@query(
    """SELECT event_id, k, CASE WHEN k IS NULL THEN '{' ELSE '{"k":' || k || ',' END || '"type":"' || event_type || '"}' AS packed FROM
       (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) WHERE k = 5 OR event_type = 'purchase'"""
)
def filter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their properties; some properties are cut off and some have a text where the number should be, which give null."""
    k = F.col("event_id")
    given = F.when(k % 7 == 0, F.expr("left(props, length(props) - 1)")).when(k % 11 == 0, F.regexp_replace("props", ": *([0-9]+)", ': "x$1"')).otherwise(F.col("props"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.try_variant_get(F.try_parse_json(given), "$.k", "bigint").alias("k"))
    found = events.filter((F.col("k") == 5) | (F.col("event_type") == "purchase"))
    return found.select("event_id", "k", F.to_json(F.struct("k", F.col("event_type").alias("type"))).alias("packed"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS answer FROM conversations LEFT JOIN events ON event_id = conv_id WHERE role = 'assistant'")
def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON that stands in a reply: in a fence, bare, or cut off; a reply has the properties of an event."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), "props")
    replies = table(spark, sf_dir, "conversations").filter("role = 'assistant'").join(events, "conv_id", "left")
    kind = F.col("turn") % 3
    said = F.when(kind == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat("props", F.lit("\nend"))).otherwise(F.concat(F.lit("```"), F.expr("left(props, 3)"), F.lit("```")))
    return replies.select("conv_id", "turn", F.try_variant_get(parsing.json_of(said), "$.k", "bigint").alias("answer"))
