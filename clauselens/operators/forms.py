"""Keys and values of form tables: grids whose rows are read in order, with a section carried on and header rows paired with data rows.

A row of one cell that is no note opens a section, whose name goes before the keys below it. A row of labels followed by a
row that has values is a header: both rows are consumed, and each value takes the nearest label. Any other row gives each
of its keys, from left to right, the nearest value on its right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of keys, signs of notes, words and patterns of what is no key, and patterns of values.
KEYS = [
    "계약자", "계 약 자", "피보험자", "피 보 험 자", "만기", "납기", "보험료", "플랜", "방법", "관계", "주민번호", "상해급수", "직업", "운행차량", "환급금", "차량용도", "구분", "가입금액", "담보", "보장", "합계", "성별", "나이",
    "기간", "수익자",
]
NOTES = ["※", "1.", "2.", "◎"]
NO_KEYS = ["세만기", "년납", "년/100세", "종_"]
NO_KEY_CELLS = ["월납", "연납", "일시납", "-"]
VALUES = [r"\d.*원|원.*\d", r"^\d{4}\.\d{2}\.\d{2}", r"^\d+[급세명]$", r"^[남여]\s*/\s*\d+세", r"\d{6}-"]
SECTION, LABEL, HEADER, NEAR, FAR = 50, 15, 20, 2, 3
KEPT = 1 << 16  # cells and rows that a worker remembers, as forms say the same again and again

_value, _years = re.compile("|".join(VALUES)), re.compile(r"\d.*년|년.*\d")


def _digits(cell: str) -> str:
    return re.sub("[,. -]", "", cell)


@lru_cache(KEPT)
def is_value(cell: str) -> bool:
    cell = cell.strip()
    return bool(_value.search(cell) or _years.search(cell)) or (_digits(cell).isdigit() and len(_digits(cell)) > 1)


@lru_cache(KEPT)
def is_key(cell: str) -> bool:
    if _value.search(cell) or cell in NO_KEY_CELLS or any(w in cell for w in NO_KEYS) or "플랜" in cell.lower():
        return False
    return any(w in cell for w in KEYS) or (len(cell) < LABEL and not _digits(cell).isdigit() and "원" not in cell)


def is_header(row: Sequence[tuple[int, str]], below: Sequence[tuple[int, str]]) -> bool:
    """Whether a row of (place, cell) holds the labels of the row below it."""
    labels = [c for _, c in row]
    if min(len(row), len(below)) < 2 or any(map(is_value, labels)) or not any(is_value(c) for _, c in below):
        return False
    if len(row) >= 4 and sum(len(c) < LABEL for c in labels) >= 2:
        return False  # keys and values side by side
    beside = sum(any(abs(i - j) <= NEAR for j, _ in row) for i, _ in below)
    return sum(len(c) < HEADER for c in labels) >= 0.7 * len(labels) and 2 * beside >= len(below)


def paired(row: Sequence[tuple[int, str]], below: Sequence[tuple[int, str]]) -> list[tuple[str, str]]:
    """Each value with the nearest label that is not taken, the left one of two, FAR places away at most."""
    free, out = dict(row), []
    for at, value in below:
        near = min(free, key=lambda i: (abs(i - at), i), default=None)
        if near is not None and abs(near - at) <= FAR:
            out.append((free.pop(near).strip(), value.strip()))
    return out


def side_by_side(row: Sequence[tuple[int, str]]) -> list[tuple[str, str]]:
    values, out = [x for x in row if not is_key(x[1])], []
    for at, key in (x for x in row if is_key(x[1])):
        right = next((x for x in values if x[0] > at), None)
        if right:
            values.remove(right)
            out.append((key.strip(), right[1].strip()))
    return out


@lru_cache(KEPT)
def filled(cells: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    """The cells of a row that are not blank, with their places."""
    return tuple((i, c) for i, c in enumerate(cells) if c and c.strip())


@lru_cache(KEPT)
def read(row: tuple[tuple[int, str], ...], below: tuple[tuple[int, str], ...]) -> tuple[str | None, tuple[tuple[str, str], ...], int]:
    """What a row says with the row below it: the section that it opens or None, its pairs, and how many rows are consumed."""
    if len(row) == 1 and len(row[0][1]) < SECTION and not any(n in row[0][1] for n in NOTES):
        return row[0][1], (), 1
    if is_header(row, below):
        return None, tuple(x for x in paired(row, below) if all(x)), 2
    return None, tuple(x for x in side_by_side(row) if all(x)), 1


def fields(grid: Sequence[Sequence[str]]) -> dict[str, tuple[str, int]]:
    """Of each field its last value and the row of it; the key has the section before it."""
    rows = [filled(tuple(row)) for row in grid]
    out: dict[str, tuple[str, int]] = {}
    section, at = None, 0
    while at < len(rows):
        opened, pairs, step = read(rows[at], rows[at + 1] if at + 1 < len(rows) else ())
        section = section if opened is None else opened
        for k, v in pairs:
            out[f"{section}_{k}" if section else k] = (v, at)
        at += step
    return out


def _grids(tables: pa.ListArray) -> Iterator[tuple[list[int], list[tuple[str, ...]]]]:
    """Of each table the numbers and the cells of its rows; equal cells of a batch are one text."""
    numbers, cells = tables.flatten().flatten()
    texts = cells.flatten().dictionary_encode()
    known = texts.dictionary.to_pylist()
    said = [None if i is None else known[i] for i in texts.indices.to_pylist()]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)).tolist()
    rows, numbers, at = [tuple(said[a:b]) for a, b in zip([0, *ends], ends)], numbers.to_pylist(), 0
    for n in pc.list_value_length(tables).to_pylist():
        yield numbers[at : at + n], rows[at : at + n]
        at += n


def key_values(rows: DataFrame, keys: list[str], row_no: str = "row_no", cells: str = "cells") -> DataFrame:
    """keys, row_no, field and value of the tables whose rows have `keys` in common.

    Spark puts the rows of each table together, in order; a batch of tables is read at once.
    """
    tables = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(row_no).cast("long").alias("no"), F.col(cells).alias("cells")))).alias("_rows"))  # one table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, numbers[at], k, v) for i, (numbers, grid) in enumerate(_grids(batch.column("_rows"))) for k, (v, at) in fields(grid).items()]
            at, no, field, value = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch([*(batch.column(f"k{i}").take(pa.array(at, pa.int64())) for i in range(len(keys))), pa.array(no, pa.int64()), pa.array(field, pa.string()), pa.array(value, pa.string())], [*(f"k{i}" for i in range(len(keys))), "no", "field", "value"])

    named = tables.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), "_rows")
    schema = ", ".join(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    return named.mapInArrow(run, f"{schema}, no long, field string, value string").toDF(*keys, row_no, "field", "value")
