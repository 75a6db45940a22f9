"""Forms, merge writes, streams that skip what is there, listings, property maps, quantiles and JSON values."""

import glob
import json
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from clauselens.operators import forms, graph, parsing, tables, writes
from clauselens.sources import files
from clauselens.streaming.ingest import ingest_new


@pytest.mark.parametrize(("grid", "wanted"), [
    ([["계약 사항", "", ""], ["피보험자", "", "홍길동 1,000원"]], {"계약 사항_피보험자": "홍길동 1,000원"}),
    ([["성별", "나이", "면적"], ["남 / 40세", "40세", "1200"]], {"성별": "남 / 40세", "나이": "40세", "면적": "1200"}),
    ([["성별", "", "나이"], ["", "남 / 40세", "40세"], ["직업", "3급", ""]], {"성별": "남 / 40세", "나이": "40세", "직업": "3급"}),
    ([["계약자", "100원", "피보험자", "200원"], ["직업", "3급", "만기", "80세만기"]], {"계약자": "100원", "피보험자": "200원", "직업": "3급", "만기": "80세만기"}),
    ([["※ 참고", ""], ["1. 안내", ""], ["", ""], ["보험료", "월납"]], {"보험료": "월납"}),
    ([["보험료", "100원"], ["보험료", "200원"]], {"보험료": "200원"}),
    ([["100원", "보험료"]], {}), ([], {}), ([[None, " "]], {}),
    ([["x" * 60, ""], ["보험료", "5명"]], {"보험료": "5명"}),
])
def test_forms(grid, wanted):
    assert {k: v for k, (v, _) in forms.fields(grid).items()} == wanted


def test_forms_of_many_tables(spark):
    rows = [(t, p, i, row) for t in range(3) for p in ("a", "b") for i, row in enumerate([["구분", ""], ["나이", f"{t}0세"], None])]
    rng = random.Random(1)
    rng.shuffle(rows)
    found = forms.key_values(spark.createDataFrame(rows, "t int, p string, row_no int, cells array<string>").repartition(3), ["t", "p"])
    assert sorted(map(tuple, found.collect())) == sorted((t, p, 1, "구분_나이", f"{t}0세") for t in range(3) for p in ("a", "b"))


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_part=*/*.parquet")}


def test_merge_writes_touched_parts_only(spark, tmp_path):
    path = f"file://{tmp_path}/target"
    writes.create(spark.range(500).select("id", F.lit("old").alias("v"), F.lit(1).alias("n")), path, ["id"])
    before = stamps(f"{tmp_path}/target")
    rows = spark.createDataFrame([(3, "new", None, 1), (3, "newer", None, 2), (1000, "added", 5, 1)], "id long, v string, n int, seq int")
    touched = writes.merge_latest(spark, path, rows, ["id"], [F.col("seq")], coalesce=True)
    after = stamps(f"{tmp_path}/target")
    assert 1 <= len(touched) <= 2
    assert {f for f in after if before.get(f) != after[f]} == {f for f in after if int(f.split("_part=")[1].split("/")[0]) in touched}
    assert all(f in after for f in before if int(f.split("_part=")[1].split("/")[0]) not in touched)
    found = {r.id: (r.v, r.n) for r in writes.read(spark, path).collect()}
    assert len(found) == 501 and found[3] == ("newer", 1) and found[1000] == ("added", 5) and found[4] == ("old", 1)
    writes.merge_latest(spark, path, rows, ["id"], [F.col("seq")], coalesce=True)
    assert {r.id: (r.v, r.n) for r in writes.read(spark, path).collect()} == found


def test_insert_leaves_what_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/target"
    writes.create(spark.range(50).select("id", F.lit("old").alias("v")), path, ["id"], 8)
    rows = spark.createDataFrame([(3, "no"), (70, "b"), (70, "a"), (71, "c")], "id long, v string")
    writes.merge_absent(spark, path, rows, ["id"], [F.col("v")], 8)
    assert {r.id: r.v for r in writes.read(spark, path).filter("id IN (3, 70, 71)").collect()} == {3: "old", 70: "a", 71: "c"}
    assert writes.merge_absent(spark, path, rows.limit(0), ["id"], [F.col("v")], 8) == [] and writes.read(spark, path).count() == 52


@pytest.mark.parametrize("remember", [False, True])
def test_stream_skips_what_is_there(spark, tmp_path, remember):
    """The same rows in other files add nothing; a batch that is repeated adds nothing either."""
    base, schema = f"file://{tmp_path}", "id long, v string"
    rows = spark.range(40).select("id", F.concat(F.lit("v"), "id").alias("v"))
    where = (f"{base}/in", rows.schema, lambda d: d, f"{base}/out", f"{base}/progress", ["id"], remember)

    def found():
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{base}/out").select("id", "v").collect())

    rows.repartition(2).write.parquet(f"{base}/in/a")
    ingest_new(spark, *where)
    assert found() == [(i, f"v{i}") for i in range(40)]
    rows.unionByName(rows).repartition(3).write.parquet(f"{base}/in/b")
    ingest_new(spark, *where)
    assert len(found()) == 40
    spark.range(30, 60).select("id", F.concat(F.lit("v"), "id").alias("v")).write.parquet(f"{base}/in/c")
    ingest_new(spark, *where)
    assert found() == [(i, f"v{i}") for i in range(60)]
    last = max(int(os.path.basename(f)) for f in glob.glob(f"{tmp_path}/progress/commits/[0-9]*"))
    for f in (f"{last}", f".{last}.crc"):  # as if it had been killed before it was noted
        os.remove(tmp_path / "progress" / "commits" / f)
    ingest_new(spark, *where)
    assert found() == [(i, f"v{i}") for i in range(60)]


def test_listing_of_decomposed_names(spark, tmp_path):
    names = {"samsung": ["삼성_약관(남).pdf", "삼성_쉬운요약서(여자).pdf", "note.txt"], "db": ["DB_가입설계서(40세이하)_2511.pdf"], "lotte": ["롯데_약관.pdf"]}
    for folder, inside in names.items():
        os.makedirs(tmp_path / folder)
        for n in inside:
            (tmp_path / folder / unicodedata.normalize("NFD", n)).write_bytes(b"%PDF")
        if folder != "lotte":
            (tmp_path / folder / "product_info.json").write_text(json.dumps({"product_code": f"p-{folder}", "version": None}, indent=1))
    info = files.folder_info(spark, f"file://{tmp_path}", "product_code string, version string")
    found = files.documents(files.listed(spark, f"file://{tmp_path}"), info)
    assert sorted((r.document_id, r.carrier, r.doc_type, r.doc_subtype, r.product_code) for r in found.collect()) == [
        ("db-proposal-age_40_under", "db", "proposal", "age_40_under", "p-db"), ("samsung-easy_summary", "samsung", "easy_summary", "easy_summary", "p-samsung"), ("samsung-terms-male", "samsung", "terms", "male", "p-samsung"),
    ]
    assert all(unicodedata.is_normalized("NFC", r.file_path) for r in found.collect())


def test_property_maps(spark):
    a = spark.createDataFrame([(1, {"x": "1", "y": None}), (2, {}), (3, {"x": "low"}), (3, {"x": "top"})], "k int, p map<string,string>")
    b = spark.createDataFrame([(1, {"x": None, "y": "2"}), (3, {"z": "z"}), (4, None)], "k int, p map<string,string>")
    for first, second, wanted in ((a, b, "1"), (b, a.replace("1", "9"), "1")):
        found = {r.id: r.properties for r in graph.merged_nodes([("L", first, F.col("k"), F.col("p")), ("L", second, F.col("k"), F.col("p"))]).collect()}
        assert found == {"1": {"x": wanted, "y": "2"}, "2": {}, "3": {"x": "top", "z": "z"}, "4": {}}
    c = spark.createDataFrame([(1, {"x": "late"})], "k int, p map<string,string>")
    assert graph.merged_edges([("R", a.limit(1), F.col("k"), F.col("k"), F.col("p")), ("R", c, F.col("k"), F.col("k"), F.col("p"))]).first().properties["x"] == "late"


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 0.95, 0.9999, 1.0])
def test_quantiles(spark, share):
    rng = random.Random(7)
    data = [("many", rng.gauss(0, 1)) for _ in range(30_000)] + [("same", 2.0)] * 500 + [("few", x) for x in (3.0, 1.0, 2.0)] + [("few", None), ("none", None)] + [(None, float(i % 3)) for i in range(10)]
    rows = spark.createDataFrame(data, "g string, v double").repartition(4)
    wanted = {}
    for g in {g for g, v in data if v is not None}:
        values = sorted(v for h, v in data if h == g and v is not None)
        wanted[g] = values[min(int(len(values) * share), len(values) - 1)]
    assert {r.g: r.at_share for r in tables.quantile(rows, "g", "v", share).collect()} == wanted


def test_sketches_merge(spark):
    half = [spark.range(a, b).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v")) for a, b in ((0, 5000), (5000, 10_000))]
    both = tables.sketches(half[0], "g", "v").unionByName(tables.sketches(half[1], "g", "v"))
    found = tables.merged_sketches(both, "g").select(tables.from_sketch(F.col("sketch"), 0.9).alias("v")).first().v
    assert abs(found - 9000) < 300


def test_json_of_replies(spark):
    said = ['x\n```json\n{"a": 1}\n```', "```\n{\"a\": 2}```", 'so {"a": 3} it is', '```json\n{"a": ', "none", "", None, '{"a": "x"}', '{"b": 1}']
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    found = rows.select("i", F.try_variant_get(parsing.json_of(F.col("t")), "$.a", "int").alias("a")).orderBy("i").collect()
    assert [r.a for r in found] == [1, 2, 3, None, None, None, None, None, None]


def test_narrowest_tier(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 3, 2), ("b", 4, 5), (None, 5, 1), (None, 6, 4), ("c", 7, None)], "g string, i int, t int")
    found = tables.narrowest(rows, ["g"], F.col("t"))
    assert {(r.g, r.i) for r in found.collect()} == {("a", 2), ("a", 3), ("b", 4), (None, 5)}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_lists_of_bounded_size(spark):
    rows = spark.createDataFrame([("big", i // 2) for i in range(101)] + [("small", 5)], "g string, v int").repartition(4)
    found = {(r.g, r.part): r.values for r in tables.numbered_lists(rows, "g", "v", 10).collect()}
    assert found[("small", 0)] == [5] and [v for k in sorted(found) if k[0] == "big" for v in found[k]] == [i // 2 for i in range(101)]
    assert all(len(v) == 10 for k, v in found.items() if k[0] == "big" and k[1] < 10)


def test_sample_is_of_n_rows_and_stays(spark):
    rows = spark.range(1000)
    drawn = [{r.id for r in tables.selected(rows.repartition(p), 50, F.col("id")).collect()} for p in (1, 7)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 50 and {r.id for r in tables.selected(rows, 50, F.col("id"), 1).collect()} != drawn[0]
    assert tables.selected(rows.limit(3), 50, F.col("id")).count() == 3


def test_extremes(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("a", 4, None), ("b", 5, 7), ("c", 6, 2), ("c", 7, 2), ("d", 8, None)], "g string, i int, v int")
    found = {r.g: tuple(r)[1:] for r in tables.extremes(rows, ["g"], F.col("i"), F.col("v"), "top").collect()}
    assert found == {"a": (2, 9, False, True), "b": (5, 7, True, False), "c": (6, 2, True, True)}
    assert {r.g: r.low for r in tables.extremes(rows, ["g"], F.col("i"), F.col("v"), "low", largest=False).collect()} == {"a": 1, "b": 5, "c": 6}
