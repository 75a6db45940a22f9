"""The clauses of all documents: parser by type of document, articles, blocks and table rows by the layout of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselens.operators import parsing
from clauselens.registry import query, table

ROUTES = {"en": "text", "de": "table"}


def layouts() -> parsing.Layouts:
    """Layouts of three sources; the second has two, by number of cells."""
    out = parsing.Layouts().register("src0", 1, 2, 3, least=2, drop_empty=True)
    return out.register("src1", 2, 3, least=3, most=6).register("src1", 2, 4, 5, least=7).register("src2", 1, 2, least=2, most=4)


@query(
    """WITH lines AS (SELECT doc_id, lang AS doc_type, source, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'table' ELSE 'hybrid' END AS parser, pos - 1 AS part_no, trim(parts[pos]) AS line
            FROM (SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))),
       cut AS (SELECT *, list_transform(string_split(line, '|'), lambda c: trim(c)) AS cells, list_filter(cells, lambda c: c <> '') AS filled,
            CASE WHEN parser = 'text' THEN CASE WHEN line <> '' THEN 'article' END WHEN contains(line, '|') THEN CASE WHEN len(filled) > 0 THEN 'row' END WHEN parser = 'hybrid' AND length(line) >= 20 THEN 'block' END AS kind FROM lines),
       laid AS (SELECT *, CASE WHEN kind <> 'row' THEN NULL WHEN source = 'src0' AND len(filled) >= 2 THEN filled[1:3] WHEN source = 'src1' AND len(cells) BETWEEN 3 AND 6 THEN [cells[2], cells[3], NULL]
            WHEN source = 'src1' AND len(cells) >= 7 THEN [cells[2], cells[4], cells[5]] WHEN source = 'src2' AND len(cells) BETWEEN 2 AND 4 THEN [cells[1], cells[2], NULL] END AS got FROM cut WHERE kind IS NOT NULL)
       SELECT doc_id, doc_type, parser, part_no, kind, CASE WHEN kind <> 'row' AND length(line) < 100 THEN line END AS title, got[1] AS name, got[2] AS amount, got[3] AS premium,
            CASE WHEN kind <> 'row' THEN line WHEN got IS NOT NULL THEN got[1] || ', 가입금액: ' || got[2] || coalesce(', 보험료: ' || got[3], '') ELSE array_to_string(filled, ', ') END AS clause_text FROM laid"""
)
def build_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as articles, German ones as tables, others as both."""
    return parsing.clauses(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", ROUTES, layouts())
