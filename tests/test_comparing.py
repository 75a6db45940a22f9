"""Comparison of companies: rows without data stay, related offers, verdicts that need two different values."""

from pyspark.sql import functions as F

from clauselens.operators import comparing


def test_compared(spark):
    offers = spark.createDataFrame([("A", "abc1", 10, 5), ("A", "abc1", 30, 7), ("B", "abc1", 20, 4), ("C", "abc2", 50, None), ("A", "xyz", 9, 9), ("B", "xyz", 9, 9)], "company string, name string, amount int, premium int")
    questions = spark.createDataFrame([(1, ["A", "B", "D"], ["abc1"]), (2, ["C", "A"], ["xyz"]), (3, [], ["abc1"]), (4, ["A", "B"], ["xyz"]), (5, ["A"], []), (6, ["A"], ["abc1", "none"])], "q int, companies array<string>, coverages array<string>")
    pairs = comparing.asked_pairs(questions, "q", offers.select("company").distinct(), F.col("q") == 3)
    found = {(r.q, r.company, r.coverage): tuple(r)[3:] for r in comparing.compared(pairs, offers, "q", F.substring("name", 1, 3)).collect()}
    assert found == {
        (1, "A", "abc1"): (30, 5, 2, "success", True, False), (1, "B", "abc1"): (20, 4, 1, "success", False, True), (1, "D", "abc1"): (None, None, 0, "no_data", False, False),
        (2, "C", "xyz"): (None, None, 0, "no_data", False, False), (2, "A", "xyz"): (9, 9, 1, "success", False, False),
        (3, "A", "abc1"): (30, 5, 2, "success", False, False), (3, "B", "abc1"): (20, 4, 1, "success", False, True), (3, "C", "abc1"): (50, None, 1, "related", True, False),
        (4, "A", "xyz"): (9, 9, 1, "success", False, False), (4, "B", "xyz"): (9, 9, 1, "success", False, False),
        (6, "A", "abc1"): (30, 5, 2, "success", False, False), (6, "A", "none"): (None, None, 0, "no_data", False, False),
    }
