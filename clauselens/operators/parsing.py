"""Names of files, headings, chunks and table rows, for any DataFrame of texts, lines or cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.functions.unicode import nfc

# Carriers and kinds of documents in file names, kinds in the order in which they are looked for, variants.
CARRIERS = {"삼성": "samsung", "DB": "db", "롯데": "lotte", "한화": "hanwha", "현대": "hyundai", "KB": "kb", "메리츠": "meritz", "흥국": "heungkuk"}
DOC_TYPES = {"약관": "terms", "사업방법서": "business_spec", "사업설명서": "business_spec", "상품요약서": "product_summary", "쉬운요약서": "easy_summary", "가입설계서": "proposal"}
VARIANTS = {"(남)": "male", "(남자)": "male", "(여)": "female", "(여자)": "female", "40세이하": "age_40_under", "40세 이하": "age_40_under", "41세이상": "age_41_over", "41세 이상": "age_41_over"}
# Headings in the order in which they are tried: pattern, kind, level, and the title made of its groups.
HEADINGS = [
    (r"^제(\d+)관\s*[:\.]?\s*(.+?)(?:\s+\d+)?$", "chapter", 1, "제{1}관 {2}"),
    (r"^제(\d+)조\s*\(([^)]+)\)", "clause", 2, "제{1}조 ({2})"),
    (r"^제(\d+)조의?\d*\s*\(([^)]+)\)", "clause", 2, "제{1}조 ({2})"),
    (r"^(\d+[-\.]\s*.+특별약관)", "special_terms", 2, "{1}"),
    (r"^\d+[-\.]?\d*[-\.]?\s*(.+특별약관)", "special_terms", 2, "{1}"),
    (r"^제(\d+)장\s*(.+?)(?:\s+\d+)?$", "section", 1, "제{1}장 {2}"),
]


def _first(options: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda rest, option: F.when(option[0], option[1]).otherwise(rest), reversed(options), F.lit(None))


def json_of(reply: Column) -> Column:
    """The JSON of a reply as a VARIANT: that of the first fenced block, else the text from the first brace to the last; null if it is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.when(fenced != "", fenced).otherwise(bare))


def file_metadata(name: Column) -> Column:
    """struct(carrier, doc_type, doc_subtype) of names like carrier_kind(variant)_yymm.pdf; an unknown carrier is its own code.

    Names are composed first, as some file systems give them decomposed.
    """
    stem = F.regexp_replace(nfc(name), r"\.[^.]*$", "")
    first = F.split(stem, "_")[0]
    carrier = F.coalesce(_first([(first == said, F.lit(code)) for said, code in CARRIERS.items()]), F.lower(first))
    bare = F.regexp_replace(stem, r"\([^)]*\)", "")
    kind = F.coalesce(_first([(bare.contains(said), F.lit(code)) for said, code in DOC_TYPES.items()]), F.lit("unknown"))
    variant = _first([(stem.contains(said), F.lit(code)) for said, code in VARIANTS.items()])
    return F.struct(carrier.alias("carrier"), kind.alias("doc_type"), F.when(kind == "easy_summary", kind).otherwise(variant).alias("doc_subtype"))


def headings(lines: DataFrame, line: str = "line", patterns: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """The lines that are headings, with kind, title and level by the first pattern that fits."""
    text = F.trim(F.col(line))

    def title(pattern: str, form: str) -> Column:
        parts = [F.regexp_extract(text, pattern, int(x[0])) if i % 2 else F.lit(x) for i, x in enumerate(form.replace("}", "{").split("{"))]
        return F.concat(*parts)

    found = _first([(text.rlike(p), F.struct(F.lit(kind).alias("kind"), title(p, form).alias("title"), F.lit(level).alias("level"))) for p, kind, level, form in patterns or HEADINGS])
    return lines.withColumn("_found", found).filter(F.col("_found").isNotNull()).select(*lines.columns, "_found.*")


def chunks(docs: DataFrame, key: str, text: str, doc_type: str, routes: dict[str, str], other: str = "hybrid", marker: str = "\n", least: int = 20, keep: list[str] | None = None) -> DataFrame:
    """(key, parser, part_no, kind, body, title) of documents, each by the parser of its type.

    `text` cuts a text at a marker; `table` takes the cells of lines with bars; `hybrid` takes those, and of the other
    lines those of `least` characters or more. A first line below 100 characters is the title. `keep` names
    more columns to be kept; `cells` has all cells of a line.
    """
    parser = F.coalesce(_first([(F.col(doc_type) == t, F.lit(p)) for t, p in routes.items()]), F.lit(other))
    more = [c for c in keep or [] if c != "cells"]
    lines = docs.select(key, *more, parser.alias("parser"), F.posexplode(F.split(text, marker)).alias("part_no", "line")).withColumn("line", F.trim("line"))
    barred = F.col("line").contains("|")
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    kind = F.when(F.col("parser") == "text", F.when(F.col("line") != "", "article")).when(barred, F.when(F.size(cells) > 0, "row")).when((F.col("parser") == "hybrid") & (F.length("line") >= least), "block")
    body = F.when(F.col("kind") == "row", F.array_join(cells, ", ")).otherwise(F.col("line"))
    out = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("body", body)
    if "cells" in (keep or []):
        out, more = out.withColumn("cells", F.transform(F.split("line", r"\|"), lambda c: F.trim(c))), [*more, "cells"]
    return out.select(key, *more, "parser", F.col("part_no").cast("long").alias("part_no"), "kind", "body", F.when((F.col("kind") != "row") & (F.length("body") < 100), F.col("body")).alias("title"))


def clauses(docs: DataFrame, key: str, text: str, doc_type: str, carrier: str, routes: dict[str, str], layouts: Layouts, marker: str = "\n") -> DataFrame:
    """Clauses of documents: those of `chunks`, by the parser of each type of document, with their rows read by the layout of the carrier.

    (key, doc_type, parser, part_no, kind, title, name, amount, premium, clause_text). A row that its carrier's layout fits
    has name, amount and premium, and a text made of them; another row has its cells. NUL characters are dropped.
    """
    clean = docs.select(key, F.col(doc_type).alias("doc_type"), F.col(carrier).alias("carrier"), F.translate(F.col(text), "\x00", "").alias("_text"))
    parts = chunks(clean, key, "_text", "doc_type", routes, marker=marker, keep=["doc_type", "carrier", "cells"])
    read = layouts.parse(parts.filter("kind = 'row'"), "carrier", "cells", keep=True)
    read = read.withColumn("body", F.when(F.col("name").isNotNull(), row_text(F.col("name"), F.col("amount"), F.col("premium"), F.lit(None).cast("string"))).otherwise(F.col("body")))
    none = F.lit(None).cast("string")
    other = parts.filter("kind <> 'row'").select("*", none.alias("name"), none.alias("amount"), none.alias("premium"))
    return read.unionByName(other).select(key, "doc_type", "parser", "part_no", "kind", "title", "name", "amount", "premium", F.col("body").alias("clause_text"))


def row_text(name: Column, amount: Column, premium: Column, period: Column) -> Column:
    """A table row as text; parts that are null are left out."""
    return F.concat_ws(", ", name, F.concat(F.lit("가입금액: "), amount), F.concat(F.lit("보험료: "), premium), F.concat(F.lit("기간: "), period))


class Layouts:
    """Where each carrier has name, amount and premium in its rows (from 1, 0 for none), by number of cells."""

    def __init__(self):
        self.rows: list[tuple[str, int, int, int, int, int, bool]] = []

    def register(self, carrier: str, name_at: int, amount_at: int, premium_at: int = 0, least: int = 1, most: int = 1 << 30, drop_empty: bool = False) -> Layouts:
        """A layout for rows of `least` to `most` cells; a carrier may have several. With drop_empty, empty cells do not count."""
        self.rows.append((carrier, name_at, amount_at, premium_at, least, most, drop_empty))
        return self

    def parse(self, rows: DataFrame, carrier: str, cells: str, keep: bool = False) -> DataFrame:
        """Rows of registered carriers with `name`, `amount` and `premium`; rows that no layout fits drop out, or with `keep` have nulls.

        Layouts of one carrier should differ in the numbers of cells that they fit.
        """
        table = rows.sparkSession.createDataFrame(self.rows, "_carrier string, _name int, _amount int, _premium int, _least int, _most int, _drop boolean")
        n, filled = F.size(cells), F.size(F.filter(cells, lambda c: F.trim(c) != ""))
        fits = (F.col(carrier) == F.col("_carrier")) & F.when(F.col("_drop"), filled).otherwise(n).between(F.col("_least"), F.col("_most"))
        joined = rows.join(F.broadcast(table), fits, "left" if keep else "inner")  # as many rows as were registered
        packed = F.when(F.col("_drop"), F.filter(cells, lambda c: F.trim(c) != "")).otherwise(F.col(cells))
        joined = joined.withColumn("_cells", packed)

        def at(place: str) -> Column:
            return F.when(F.col(place) > 0, F.try_element_at("_cells", F.col(place)))

        return joined.select(*rows.columns, at("_name").alias("name"), at("_amount").alias("amount"), at("_premium").alias("premium"))
