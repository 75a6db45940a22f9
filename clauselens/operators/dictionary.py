"""Dictionary search: which words of a table stand in which texts, by automata (tries with failure links) over shards of it.

A dictionary has the columns kind, word, place, form and within: `form` is what is looked for in the text column named by
`within`, and stands for `word`, which comes in the order of `place` among the words of its kind. A word may have many
forms, and a form many words. Forms have any length; null and empty ones are never found.

The dictionary is cut by a hash of the form into shards of about SHARD_CHARS characters, which are broadcast one by one:
each task builds the automaton of a shard once and reads its texts once, however many forms there are. Texts are read once
for each shard; with one shard nothing is shuffled, with more the hits are put together by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.operators.rounds import written

SHARD_CHARS = 2_000_000
HITS = "found array<struct<kind:string,place:long,word:string,at:long>>"
_built: dict[str, dict[str, ahocorasick.Automaton]] = {}


def _automata(shard: Broadcast, name: str) -> dict[str, ahocorasick.Automaton]:
    """The automaton of each text column; a worker keeps the last shard's."""
    if name not in _built:
        _built.clear()
        out: dict[str, ahocorasick.Automaton] = {}
        for i, (within, form) in enumerate(zip(*(shard.value.column(c).to_pylist() for c in ("within", "form")), strict=True)):
            automaton = out.setdefault(within, ahocorasick.Automaton())
            automaton.add_word(form, [*automaton.get(form, []), i])
        for automaton in out.values():
            automaton.make_automaton()
        _built[name] = out
    return _built[name]


def _pass(texts: DataFrame, keys: list[str], within: list[str], shard: Broadcast, name: str) -> DataFrame:
    """The hits of one shard in each text, one array for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, words = _automata(shard, name), shard.value
        for batch in batches:
            lists: list[dict[int, int]] = [{} for _ in range(batch.num_rows)]
            for column, automaton in automata.items():
                for hits, text in zip(lists, batch.column(f"text_{column}").to_pylist(), strict=True):
                    for end, entries in automaton.iter(text) if text else ():
                        for i in entries:
                            hits.setdefault(i, end)
            ends = [0]
            for hits in lists:
                ends.append(ends[-1] + len(hits))
            rows = pa.array([i for hits in lists for i in hits], pa.int64())
            lasts = [end for hits in lists for end in hits.values()]
            sizes = words.column("size").take(rows).to_pylist()
            at = pa.array([end + 2 - n for end, n in zip(lasts, sizes, strict=True)], pa.int64())
            found = pa.StructArray.from_arrays([*(words.column(c).take(rows) for c in ("kind", "place", "word")), at], ["kind", "place", "word", "at"])
            yield pa.record_batch([*(batch.column(f"key_{i}") for i in range(len(keys))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], [*(f"key_{i}" for i in range(len(keys))), "found"])

    given = texts.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"text_{c}") for c in within))
    schema = ", ".join(f"key_{i} {given.schema[f'key_{i}'].dataType.simpleString()}" for i in range(len(keys)))
    return given.mapInArrow(run, f"{schema}, {HITS}")


def found(texts: DataFrame, dictionary: DataFrame, keys: list[str], shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A row for each row of texts: its `keys`, which are unique, and `found`, the words it has: kind, place, word and at.

    `at` is the place, from 1, of the first hit in its text column. A word found by several forms is there for each; see
    `words`. The order of `found` is by kind, place, word and at.
    """
    words = written(dictionary.select("kind", F.col("place").cast("long").alias("place"), "word", "form", "within", F.length("form").cast("long").alias("size")).filter("size > 0"))  # once, as it is read for each shard
    chars = words.agg(F.sum("size").alias("n")).first().n or 0
    n = max(1, -(-chars // shard_chars))
    within = sorted(r.within for r in words.select("within").distinct().collect())  # as many as text columns
    sc, passes = texts.sparkSession.sparkContext, []
    for k in range(n):
        table = words.filter(F.pmod(F.xxhash64("form"), F.lit(n)) == k).toArrow().combine_chunks()  # some `shard_chars` characters
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        shared = sc.broadcast(batch)
        passes.append(_pass(texts, keys, within, shared, uuid.uuid4().hex))
    named = [f"key_{i}" for i in range(len(keys))]
    out = reduce(DataFrame.unionByName, passes)
    if n > 1:
        out = out.groupBy(*named).agg(F.flatten(F.collect_list("found")).alias("found"))
    return out.select(*(F.col(a).alias(k) for a, k in zip(named, keys, strict=True)), F.array_sort("found").alias("found"))


def words(hits: Column, kind: str) -> Column:
    """The different words of a kind, in the order of the dictionary."""
    return F.array_distinct(F.transform(F.filter(hits, lambda h: h["kind"] == kind), lambda h: h["word"]))


def entries(spark, kind: str, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A dictionary of one kind from (word, form, within), in their order."""
    return spark.createDataFrame([(kind, word, i, form, within) for i, (word, form, within) in enumerate(rows)], "kind string, word string, place long, form string, within string")
