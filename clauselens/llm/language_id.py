"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ORDER bytes, with the counts of the bytes that follow. The code length
of a byte is that of method C under frozen counts: from the longest context that was seen, a byte seen there costs
-log2(c / (n + t)) bits (c: its count, n: all counts, t: different bytes), any other byte costs an escape of
-log2(t / (n + t)) bits and goes on in the next shorter context; below the empty context a byte costs 8 bits. The
language with the shortest code for the whole text wins, and its score is its share of 2 ** -length over all languages.

The counts come from a sample of the labelled rows, about TRAIN_DOCS whole documents for each language, chosen by a
hash of doc_id and text; fewer are all taken. If more than MOST_LANGS values of `lang` are given, the most frequent ones
are learned. Both bound what is collected and broadcast. Spark counts the n-grams.

A text that is null or has no letter is `und` with score 0, and so is every text if no label was given. Ties go to the
language whose name comes first. Texts are scored whole, and repeated rows alike; a null doc_id is not held out. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.llm.byte_grams import Lookup, find, packed, sums
from clauselens.llm.shared import blocks, held, id_and_text

ORDER, TRAIN_DOCS, MOST_LANGS = 3, 400, 256
#: Bytes of text whose n-grams are held at once; each takes some 50 bytes of memory meanwhile.
GRAM_BYTES = 1 << 20
_letter = regex.compile(r"\p{L}").search


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _train_rows(docs: DataFrame, train_docs: int, most_langs: int) -> DataFrame:
    """About `train_docs` labelled rows of each of the `most_langs` most frequent languages."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    rows = [x for r in found for x in (F.lit(r["lang"]), F.lit(float(r["count"])))]
    if not rows:
        return labelled.select("lang", "text").limit(0)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.filter(share * F.create_map(*rows)[F.col("lang")] < F.lit(float(train_docs))).select("lang", "text")


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each n-gram of `order` bytes stands in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for block in blocks(batches, limit=GRAM_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append((text or "").encode())
            for lang, texts in by_lang.items():
                parts = held.setdefault(lang, [])
                parts.append(np.unique(packed(texts, order)[0], return_counts=True))
                if len(parts) > 8:
                    held[lang] = [_merged(parts)]
        for lang, parts in held.items():
            grams, n = _merged(parts)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype("i8")), pa.array(n.astype("i8"))], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([p[1] for p in parts]), len(grams)).astype("i8")


class ContextTree:
    """Contexts of one language by order: sorted keys with n and t, and sorted keys of context and byte with c."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int):
        self.levels = []
        for o in range(order, -1, -1):
            full, back = np.unique(grams & ((1 << 8 * (o + 1)) - 1), return_inverse=True)
            c = np.bincount(back, n, len(full))
            contexts, back = np.unique(full >> 8, return_inverse=True)
            self.levels.append((o, contexts, np.bincount(back, c, len(contexts)), np.bincount(back, minlength=len(contexts)), full, c))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each n-gram after the others."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for o, contexts, n, t, full, c in self.levels:
            gram = keys[todo] & ((1 << 8 * (o + 1)) - 1)
            seen, at = find(contexts, gram >> 8)
            total = np.where(seen, n[at] + t[at], 1) if len(n) else np.ones(len(todo))
            known, place = find(full, gram)
            out[todo[known]] -= np.log2(c[place[known]] / total[known])
            escaped = seen & ~known
            out[todo[escaped]] -= np.log2(t[at[escaped]] / total[escaped])
            todo = todo[~known]
        out[todo] += 8
        return out


class Model:
    """Context trees of all languages; made from plain arrays, so that it can be broadcast."""

    def __init__(self, langs: list[str], trees: list[ContextTree], order: int):
        self.langs, self.trees, self.order, self.name = langs, trees, order, uuid.uuid4().hex

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        lookup = held(self.name, lambda: Lookup(self._bits, len(self.trees), "f8"))
        keys, starts = packed(texts, self.order + 1)
        out, step = np.zeros((len(texts), len(self.langs))), 1 << 20
        for first in range(0, len(keys), step):  # long texts are summed part by part
            a, b = np.searchsorted(starts, first, side="right") - 1, np.searchsorted(starts, first + step)
            out[a:b] += sums(lookup(keys[first : first + step]), np.maximum(starts[a:b] - first, 0))
        return out

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([tree.bits(keys.astype("i8")) for tree in self.trees], axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and bits per byte under that language (0 for `und`)."""
        use = [i for i, text in enumerate(texts) if text and _letter(text)] if self.langs else []
        langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        data = [texts[i].encode() for i in use]
        if use:
            bits = self.lengths(data)
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            for k, i in enumerate(use):
                langs[i], scores[i], rates[i] = self.langs[best[k]], float(share[k]), float(least[k] / len(data[k]))
        return langs, scores, rates


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, most_langs: int = MOST_LANGS) -> Model:
    """Fits the trees; `docs` has doc_id, text and lang, and rows that are held out are not used."""
    table = count_grams(_train_rows(docs, train_docs, most_langs), order + 1).toPandas()
    langs = sorted(table["lang"].unique())
    groups = [table[table["lang"] == lang] for lang in langs]
    return Model(langs, [ContextTree(g["gram"].to_numpy("i8"), g["n"].to_numpy("i8"), order) for g in groups], order)


def identify(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=GRAM_BYTES):
            langs, scores, _ = model.value.predict(block.column("text").to_pylist())
            yield pa.record_batch([block.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Broadcast, least_score: float = 0.5, most_bits: float = 6.0) -> DataFrame:
    """The rows of `docs`, all columns, whose text is in one of the learned languages.

    Rejected are `und` texts, scores below `least_score`, and texts that take more than `most_bits` bits a byte even
    under the best language, which are in none of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=GRAM_BYTES):
            langs, scores, rates = model.value.predict(block.column("text").to_pylist())
            yield block.filter(pa.array([lang != "und" and s >= least_score and r <= most_bits for lang, s, r in zip(langs, scores, rates, strict=True)], pa.bool_()))

    plain = docs.toDF(*("text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))  # mapInArrow takes a dot for a field
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_language_id(docs: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
