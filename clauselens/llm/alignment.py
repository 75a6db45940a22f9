"""Links between the tokens of two tokenizers over the same bytes, counted over the corpus.

Tokens of A (byte-level BPE) and B (pieces) are cut into groups at the byte offsets where a token of both ends. An array
gives for each id of A the id of B with the same bytes. A group of one token each whose ids the array pairs needs no
pair: its documents are counted in a vector of the length of A's vocabulary, and these vectors are added up. Only the
pairs of other groups are counted by shuffle. A pair that the array holds goes to the vector wherever it is met, so that
a document counts once for it.

Texts are cut where neither tokenizer can join what is left and right: before a single space that a visible character
follows and no space precedes. Parts are encoded and aligned once for each worker, in a bounded cache. Texts are encoded
once: the links of each document are written to the shared folder, packed, some 2 kB for 3 kB of text.

To give the counts back to the documents, the vectors (one number for each id of A) and the HEAD most frequent pairs are
broadcast, a few MB at any size of the corpus; the documents' other, rare pairs are joined by shuffle. No pair that many
documents share is in that join.

A null or empty text, and one whose joined token bytes of A or B are not a space and the text (such as one with U+2581),
has no tokens: zeros, and '' for the groups. Long texts are read whole, in blocks of bounded size; all links of a group
are counted. Repeated rows are documents of their own and get equal results. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauselens.llm.pretokens import PieceCache
from clauselens.llm.shared import blocks, delete_folder, held, id_and_text, shared_folder, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAD, BINS, HELD_PAIRS = 1 << 18, 8, 1 << 21
_wide = re.compile(r" (?:\s|\Z)").search
_cut = re.compile(r"(?<! )(?= \S)").split


def parts_of(text: str) -> list[str]:
    """Parts of a space and the text, each without its first space."""
    if _wide(text) or text[0].isspace():
        return [p[1:] for p in _cut(" " + text) if p]
    return text.split(" ")


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the byte length and bytes of each token, and the array from ids of A to the same-bytes ids of B."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        chars = byte_level()
        named = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(chars[c] for c in named[i]) if all(c in chars for c in named.get(i, "")) else named[i].encode() for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on after a space, so texts cannot be cut before spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in v], "i8") for v in (self.a_bytes, self.b_bytes))
        first = {}
        for i, piece in enumerate(self.b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (piece not in first or self.b.is_byte(first[piece])):
                first[piece] = i
        self.same = np.array([first.get(x, -1) for x in self.a_bytes], "i8")
        self.shift = max(1, len(pieces) - 1).bit_length()


class Aligner:
    """Alignments of parts of texts, kept in a bounded cache.

    A part's value is False if its bytes do not come back, else its counts (n_a, n_b, n_groups, n_links), the groups as
    text, each followed by `;`, the codes of its links (A id << shift | B id) and how often it has each.
    """

    def __init__(self, a_path: str, b_path: str):
        self.v = Vocabularies(a_path, b_path)
        self.cache = PieceCache(self.align, 100_000)
        self.ends = {s: [f"{i}{s}" for i in range(max(len(self.v.a_bytes), len(self.v.b_bytes)))] for s in ",|;"}

    def align(self, parts: list[str]) -> Iterator[tuple]:
        for start in range(0, len(parts), 20_000):
            yield from self._align(parts[start : start + 20_000])

    def _encoded(self, parts: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Which parts come back from the bytes of their tokens, and the ids of those under A and B."""
        v, full = self.v, [(" " + p) for p in parts]
        ids_a = [e.ids for e in v.a.encode_batch_fast(full, add_special_tokens=False)]
        ids_b = v.b.encode(parts, num_threads=1)
        raw = [text.encode() for text in full]
        joined = b"".join(raw)
        if all(b"".join([v_bytes[x] for x in chain.from_iterable(ids)]) == joined and self._sizes(ids, size) == [len(r) for r in raw] for ids, v_bytes, size in ((ids_a, v.a_bytes, v.a_size), (ids_b, v.b_bytes, v.b_size))):
            return list(range(len(parts))), ids_a, ids_b
        good = [i for i, (r, a, b) in enumerate(zip(raw, ids_a, ids_b, strict=True)) if r == b"".join([v.a_bytes[x] for x in a]) == b"".join([v.b_bytes[x] for x in b])]
        return good, [ids_a[i] for i in good], [ids_b[i] for i in good]

    @staticmethod
    def _sizes(ids: list[list[int]], size: np.ndarray) -> list[int]:
        ends = np.cumsum([0, *map(len, ids)])
        before = np.append(0, size[np.fromiter(chain.from_iterable(ids), "i8", ends[-1])].cumsum())
        return np.diff(before[ends]).tolist()

    def _align(self, parts: list[str]) -> list[tuple | bool]:
        v = self.v
        good, ids_a, ids_b = self._encoded(parts)
        out: list = [False] * len(parts)
        if not good:
            return out
        a, b = (np.fromiter(chain.from_iterable(ids), "i8") for ids in (ids_a, ids_b))
        part_a, part_b = (np.repeat(np.arange(len(good)), [*map(len, ids)]) for ids in (ids_a, ids_b))
        end_a, end_b = v.a_size[a].cumsum(), v.b_size[b].cumsum()
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        group_part = part_a[np.cumsum(n_a) - 1]
        counts = np.stack([np.bincount(part_a, minlength=len(good)), np.bincount(part_b, minlength=len(good)), np.bincount(group_part, minlength=len(good)), np.bincount(group_part, n_a * n_b, len(good)).astype("i8")], 1)

        texts = self._texts(a, b, group_a, group_b, n_a + n_b, np.cumsum(counts[:, 0] + counts[:, 1]))
        each = n_b[group_a]  # links of each token of A: the tokens of B in its group
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(n_b) - n_b)[group_a], each)
        links = np.repeat(part_a, each) << 40 | np.repeat(a, each) << v.shift | b[at]
        links, times = np.unique(links, return_counts=True)
        ends = np.searchsorted(links, np.arange(1, len(good) + 1) << 40).tolist()
        codes, times = (links & (1 << 40) - 1).astype("<u4").tobytes(), times.astype("<u4").tobytes()
        counts, before = counts.astype("<i8").tobytes(), 0
        for k, (i, end) in enumerate(zip(good, ends, strict=True)):
            out[i] = (counts[32 * k : 32 * k + 32], texts[k], codes[4 * before : 4 * end], times[4 * before : 4 * end])
            before = end
        return out

    def _texts(self, a, b, group_a, group_b, in_group, part_ends) -> list[str]:
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        ids, side = np.concatenate([a, b])[order], np.concatenate([np.zeros(len(a), "i1"), np.ones(len(b), "i1")])[order]
        last = np.zeros(len(ids), bool)
        last[np.cumsum(in_group) - 1] = True
        kind = np.where(last, 2, np.append(side[1:] != side[:-1], False))
        tables = [self.ends[s] for s in ",|;"]
        tokens = [tables[k][i] for k, i in zip(kind.tolist(), ids.tolist(), strict=True)]
        ends = part_ends.tolist()
        return ["".join(tokens[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def of(self, texts: list[str | None]) -> Iterator[tuple[tuple, ...] | None]:
        """For each text the counts, texts, codes and times of its parts, None if it has no tokens."""
        split = [parts_of(t) if t else [] for t in texts]
        known = self.cache.of({p for parts in split for p in parts})
        for parts in split:
            values = list(map(known.__getitem__, parts))
            yield tuple(zip(*values, strict=True)) if values and False not in values else None


def _aligner(a_path: str, b_path: str) -> Aligner:
    return held(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path))


@lru_cache(maxsize=1)
def _shift(a_path: str, b_path: str) -> int:
    return Vocabularies(a_path, b_path).shift


class PairCounts:
    """Documents of each pair within a task: a vector for same-bytes pairs, sorted codes for the others."""

    def __init__(self, v: Vocabularies):
        self.v, self.vector, self.codes, self.n, self.more = v, np.zeros(len(v.a_bytes), "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), []

    def add(self, code: np.ndarray) -> None:
        """Adds pairs, each once for each document that holds it."""
        a = code >> self.v.shift
        same = self.v.same[a] == (code & (1 << self.v.shift) - 1)
        self.vector += np.bincount(a[same], minlength=len(self.vector))
        self.more.append(np.unique(code[~same], return_counts=True))
        if sum(len(c) for c, _ in self.more) > HELD_PAIRS:
            self.merge()

    def merge(self) -> None:
        codes, n = (np.concatenate([own, *(m[k] for m in self.more)]) for k, own in enumerate((self.codes, self.n)))
        self.codes, place = np.unique(codes, return_inverse=True)
        self.n, self.more = np.bincount(place, n, len(self.codes)).astype("i8"), []

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The pairs as packed codes and counts, when they are many or it is the `last` time, and then the vector."""
        if last:
            self.merge()
            yield _record(VECTOR, codes=[b""], times=[self.vector.astype("<i8").tobytes()])
        if last or len(self.codes) > HELD_PAIRS:
            for k in range(0, len(self.codes), PACK):
                yield _record(PAIRS, codes=[self.codes[k : k + PACK].astype("<u4").tobytes()], times=[self.n[k : k + PACK].astype("<i8").tobytes()])
            self.codes, self.n = self.codes[:0], self.n[:0]


DOC, PAIRS, VECTOR, PACK = 0, 1, 2, 1 << 16
FIELDS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "codes": pa.binary(), "times": pa.binary()}
SCHEMA = "kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _record(kind: int, **columns) -> pa.RecordBatch:
    n = len(columns["codes"])
    return pa.record_batch([pa.array(np.full(n, kind, "i4")), *(pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in FIELDS.items())], ["kind", *FIELDS])


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document (kind DOC) its counts, the digest of its groups, the codes of its links and how often it has each.

    Each task adds the documents of its irregular pairs (kind PAIRS, packed) and its vector (kind VECTOR).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        counts = PairCounts(aligner.v)
        for block in blocks(batches):
            sums, digests, code, times = [], [], [], []
            for found in aligner.of(block.column("text").to_pylist()):
                c, t, k, n = found or ((), (), (), ())
                sums.append(np.frombuffer(b"".join(c), "<i8").reshape(-1, 4).sum(0))
                digests.append(sha256("".join(t)[:-1].encode()).hexdigest() if t else "")
                code.append(b"".join(k))
                times.append(b"".join(n))
            doc = np.repeat(np.arange(len(code)), [len(k) // 4 for k in code]) << 32
            links, place = np.unique(doc | np.frombuffer(b"".join(code), "<u4").astype("i8"), return_inverse=True)
            n = np.bincount(place, np.frombuffer(b"".join(times), "<u4"), len(links)).astype("<u4").tobytes()
            ends = np.searchsorted(links, np.arange(len(code) + 1) << 32).tolist()
            links = links & 0xFFFFFFFF
            counts.add(links)
            packed = links.astype("<u4").tobytes()
            sums = np.stack(sums)
            spans = list(zip(ends, ends[1:]))
            yield _record(DOC, doc_id=block.column("doc_id"), n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], groups_sha256=digests, codes=[packed[4 * x : 4 * y] for x, y in spans], times=[n[4 * x : 4 * y] for x, y in spans])
            yield from counts.rows(False)
        yield from counts.rows(True)

    return docs.mapInArrow(run, SCHEMA)


def unpacked(counted: DataFrame, shift: int) -> DataFrame:
    """a, b and n of rows of kind PAIRS; of kind VECTOR a and n, b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, codes, times in zip(*(batch.column(c).to_pylist() for c in ("kind", "codes", "times")), strict=True):
                n = np.frombuffer(times, "<i8")
                code = np.frombuffer(codes, "<u4").astype("i8") if kind == PAIRS else np.flatnonzero(n)
                a, b, n = (code >> shift, pa.array(code & (1 << shift) - 1, pa.int32()), n) if kind == PAIRS else (code, pa.nulls(len(code), pa.int32()), n[code])
                yield pa.record_batch([pa.array(a, pa.int32()), b, pa.array(n)], ["a", "b", "n"])

    return counted.select("kind", "codes", "times").mapInArrow(run, "a int, b int, n long")


def head_of(pairs: DataFrame, limit: int) -> int:
    """The least count from which on at most `limit` pairs are left, by counts in BINS bins to the octave."""
    bins = pairs.groupBy(F.floor(F.log2("n") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("pairs")).collect()
    left, least = 0, 1 << 62
    for r in sorted(bins, reverse=True):
        left += r.pairs
        if left > limit:
            break
        least = int(np.floor(2 ** (r.bin / BINS)))
    return least


class Known:
    """What the tasks are given: counts and highest counts by id of A, and the codes of the most frequent pairs."""

    def __init__(self, same: np.ndarray, best: np.ndarray, head: np.ndarray, n: np.ndarray):
        self.same, self.best, self.head, self.n = same, best, head, n


def scored(docs: DataFrame, known, a_path: str, b_path: str) -> DataFrame:
    """Rows of `aligned` with what the vectors and the head say of their links; `rest` has their rare pairs."""
    v = Vocabularies(a_path, b_path)
    shared = docs.sparkSession.sparkContext.broadcast((v.same, v.shift))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, (twin, shift) = known.value, shared.value
        for block in blocks(batches, "codes"):
            codes, times = (block.column(c).to_pylist() for c in ("codes", "times"))
            code, times = (np.frombuffer(b"".join(x), "<u4").astype("i8") for x in (codes, times))
            doc = np.repeat(np.arange(len(codes)), [len(x) // 4 for x in codes])
            a, b = code >> shift, code & (1 << shift) - 1
            same, at = twin[a] == b, np.searchsorted(k.head, code)
            n = np.where(same, k.same[a], k.n[at])
            sure = same | (k.head[at] == code)
            n_best = np.bincount(doc[sure], (times * (n == k.best[a]))[sure], len(codes)).astype("i8")
            total = np.zeros(len(codes), "i8")
            np.add.at(total, doc[sure], (times * n)[sure])
            rest = pa.StructArray.from_arrays([pa.array(a[~sure], pa.int32()), pa.array(b[~sure], pa.int32()), pa.array(times[~sure])], ["a", "b", "times"])
            ends = np.searchsorted(doc[~sure], np.arange(len(codes) + 1)).astype("i4")
            yield pa.record_batch([*(block.column(c) for c in kept), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), rest)], [*kept, "n_best", "count_sum", "rest"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<a:int,b:int,times:long>>"
    return docs.select(*kept, "codes", "times").mapInArrow(run, schema)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Per document its counts of tokens, groups and links, and what the corpus says of its links; and the table of pairs.

    The pairs have a, b, n (documents that hold them linked) and is_best (n is the highest of a, ties included).
    """
    spark = docs.sparkSession
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    rows, shift = id_and_text(docs, id_col, text_col), _shift(a_path, b_path)
    path = shared_folder(spark)
    aligned(rows, a_path, b_path).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(SCHEMA.removeprefix("kind int, ") + ", kind int").parquet(path)
    counted = unpacked(found.filter(F.col("kind") != DOC), shift)
    other = written(counted.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")))
    same = counted.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).toPandas()  # one row for each id of A at most
    best = other.groupBy("a").agg(F.max("n").alias("n")).toPandas()  # likewise
    least = head_of(other, head)
    top = other.filter(F.col("n") >= least).select((F.shiftleft(F.col("a").cast("long"), shift) + F.col("b")).alias("code"), "n").toPandas().sort_values("code")  # `head` rows at most

    v = Vocabularies(a_path, b_path)
    vectors = np.zeros((2, len(v.a_bytes)), "i8")
    vectors[0, same["a"]] = same["n"]
    vectors[1, best["a"]] = best["n"]
    vectors[1] = np.maximum(vectors[0], vectors[1])
    known = spark.sparkContext.broadcast(Known(*vectors, np.append(top["code"].to_numpy("i8"), np.iinfo("i8").max), np.append(top["n"].to_numpy("i8"), 0)))

    highest = spark.createDataFrame(list(enumerate(vectors[1].tolist())), "a int, best long")
    twins = spark.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(v.same, vectors[0], strict=True)) if n], "a int, b int, n long")
    pairs = other.unionByName(twins).join(F.broadcast(highest), "a").select("a", "b", "n", (F.col("n") == F.col("best")).alias("is_best"))

    found = written(scored(found.filter(F.col("kind") == DOC), known, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    delete_folder(spark, path)
    rare = found.select("row", F.inline("rest"))
    rest = rare.join(pairs.filter(F.col("n") < least), ["a", "b"]).groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = found.join(rest, "row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return out.withColumns(added).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs


def op12_cross_tokenizer(docs: DataFrame) -> DataFrame:
    """Per document its tokens, groups and links of both tokenizers, and how the corpus counts its links."""
    return align(docs)[0]
