"""Token counts by trie-shared dynamic programming over distinct pre-tokens.

A vocabulary with a score for each piece (a unigram model) splits a pre-token into the pieces with the largest sum of
scores. The forward score at a position depends on the bytes before it alone, so pre-tokens go into a trie, each of whose
nodes gets its forward score once, for all pre-tokens that share the prefix; the node where a pre-token ends stores its
number of pieces. A Python worker keeps its trie from block to block and begins a new one at MOST_NODES nodes.

The public files carry ranks instead of probabilities, and tokenizers are not trained here. The model is Zipf's law over
the ranks: a piece of rank r gets the probability 1 / ((r + 1) H) where H makes the sum 1; the column `model` says so. Of
two splits with equal scores the one with fewer pieces counts.

Null and empty texts have 0 pre-tokens and 0 tokens. Texts are counted whole, whatever their length; repeated rows give
repeated results, and an empty table none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.pretokens import PieceCache, load_ranks, pieces, pretokens
from clauselens.llm.shared import blocks, held, id_and_text

RANKS, MODEL = "byte_bpe_50k.tiktoken", "zipf over ranks"
MOST_NODES = 500_000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class TrieCounter:
    """Counts of pieces under a unigram model whose pieces cover every single byte."""

    def __init__(self, scores: dict[bytes, float], most_nodes: int = MOST_NODES):
        self.scores, self.longest, self.most_nodes = scores, max(map(len, scores)), most_nodes
        self.cache = PieceCache(self.count_pieces)
        self.plant()

    def plant(self) -> None:
        """An empty trie. Children are keyed by parent and byte; node 0 is the root."""
        self.children: dict[int, int] = {}
        self.forward, self.fewest, self.terminal = [0.0], [0], {}

    def insert(self, word: bytes) -> int:
        """The number of pieces of a word, which its terminal node stores."""
        if len(self.forward) > self.most_nodes:
            self.plant()
        children, forward, fewest, path = self.children, self.forward, self.fewest, [0]
        for end, byte in enumerate(word, 1):
            edge = path[-1] << 8 | byte
            node = children.get(edge)
            if node is None:
                node = children[edge] = len(forward)
                score, count = self.best(word, end, path)
                forward.append(score)
                fewest.append(count)
            path.append(node)
        return self.terminal.setdefault(path[-1], fewest[path[-1]])

    def best(self, word: bytes, end: int, path: list[int]) -> tuple[float, int]:
        """Forward score and number of pieces of the first `end` bytes of a word, from those of the nodes on its path."""
        scores, forward, best, fewest = self.scores, self.forward, -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            score = scores.get(word[start:end])
            if score is not None:
                score += forward[path[start]]
                if score > best or score == best and self.fewest[path[start]] + 1 < fewest:
                    best, fewest = score, self.fewest[path[start]] + 1
        return best, fewest

    def count_pieces(self, new: list[str]) -> Iterator[tuple[int, int]]:
        split = [[w.encode() for w in pretokens(piece)] for piece in new]
        counts = {w: self.insert(w) for w in {w for ws in split for w in ws}}
        return ((len(ws), sum(counts[w] for w in ws)) for ws in split)

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [pieces(text) for text in texts]
        known = self.cache.of({piece for parts in split for piece in parts})
        found = [[known[piece] for piece in parts] for parts in split]
        return [(sum(x[0] for x in parts), sum(x[1] for x in parts)) for parts in found]


def _counter(path: str) -> TrieCounter:
    return held(("trie", path), lambda: TrieCounter(zipf_scores(load_ranks(path))))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_pretokens and n_tokens."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts = _counter(path).count([text or "" for text in block.column("text").to_pylist()])
            yield pa.record_batch([block.column("doc_id"), pa.array([x[0] for x in counts], pa.int64()), pa.array([x[1] for x in counts], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op1_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs).withColumn("model", F.lit(MODEL))
