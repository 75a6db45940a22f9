"""Byte-level BPE encoding and decoding by DuckDB recursive queries over token-position rows.

Each Spark partition runs its own in-memory DuckDB. A word is a set of rows (word, position, token). One step joins
neighbouring rows with the merge table and contracts, in each word, the leftmost of the pairs with the smallest rank;
the recursion ends at the fixpoint, when no word has a pair left. Decoding joins ids with the vocabulary and puts the
bytes together by an aggregate ordered by position.

Words are encoded once for each worker: a bounded cache holds the ids of the pieces already met.

Nulls and empty texts have no ids and decode to no bytes. Texts of any length are encoded whole: they are read in
blocks of bounded size. Words of more than LONG_WORD bytes are first cut wherever no token of the vocabulary that stands
in the word goes over the cut, as nothing is contracted there. The rows of all steps of a recursion are held until it
ends, so parts that are still longer go through recursions of their own, of LONG_STEPS steps each, one after the other
until the fixpoint. There a step contracts every pair that has the smallest rank within the reach of a token (see
`_LONG`), so that the number of steps does not grow with the word. Repeated rows give repeated results, and an empty table
none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.pretokens import PieceCache, load_ranks, pieces, pretokens
from clauselens.llm.shared import BLOCK_BYTES, blocks, held, id_and_text

RANKS = "byte_bpe_50k.tiktoken"
LONG_WORD, LONG_STEPS = 256, 8

_STEPS = """
    WITH RECURSIVE steps AS (
        SELECT 0 AS step, place, token FROM symbols
        UNION ALL (
        WITH here AS MATERIALIZED (
            SELECT step, place, token, place >> 16 AS word, place & 65535 AS pos,
                   lead(token) OVER w AS following, lead(place) OVER w >> 16 AS next_word, lag(place) OVER w AS before
            FROM steps WINDOW w AS (ORDER BY place)),
        best AS (
            SELECT word, min(merged::BIGINT << 32 | pos) AS pick
            FROM here JOIN merges ON token = left_token AND following = right_token
            WHERE word = next_word GROUP BY word)
        SELECT step + 1 AS step, place, CASE WHEN pos = pick & 4294967295 THEN (pick >> 32)::INTEGER ELSE token END AS token
        FROM here JOIN best USING (word)
        WHERE before IS DISTINCT FROM word << 16 | (pick & 4294967295)))
    SELECT step, place, token FROM steps
"""
# A pair is contracted if no pair within `reach` bytes, the longest token that stands in the word, has a smaller rank, and
# none on its left has the same. Before its turn, another contraction could only take one of its tokens from it by making
# a token of at most `reach` bytes over one of them; the first contraction within that token is of a pair that stands
# there now, so its rank is not smaller, and the pair's turn is earlier. Pairs of the same rank are contracted together
# if no pair with the merged token has a smaller rank than it, as nothing comes between them; of those that share
# tokens every second from the left, unless it is still open what becomes of an equal pair that shares the first token.
_LONG = f"""
    WITH RECURSIVE steps AS (
        SELECT 0 AS step, word, pos, token FROM work
        UNION ALL (
        WITH here AS (
            SELECT *, row_number() OVER w AS i, lead(token) OVER w AS following
            FROM steps WHERE step < {LONG_STEPS} WINDOW w AS (PARTITION BY word ORDER BY pos)),
        beside AS (
            SELECT here.*, merged, safe, min(merged) OVER (PARTITION BY word) AS best,
                   min(merged) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN @REACH PRECEDING AND 1 PRECEDING) AS least_before,
                   coalesce(merged = min(merged) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN @REACH PRECEDING AND @REACH FOLLOWING), false) AS least
            FROM here LEFT JOIN merges ON token = left_token AND following = right_token),
        runs AS (
            SELECT *, coalesce(max(CASE WHEN NOT least THEN 2 * i + (merged IS NOT DISTINCT FROM next_merged)::INTEGER END) OVER (PARTITION BY word ORDER BY pos), 0) AS before_run
            FROM (SELECT *, lead(merged) OVER (PARTITION BY word ORDER BY pos) AS next_merged FROM beside WHERE best IS NOT NULL)),
        picked AS (
            SELECT *, least AND (least_before IS NULL OR merged < least_before OR safe AND before_run % 2 = 0 AND (i - before_run // 2) % 2 = 1) AS pick FROM runs)
        SELECT step + 1 AS step, word, pos, CASE WHEN pick THEN merged ELSE token END AS token FROM picked
        QUALIFY NOT coalesce(lag(pick) OVER (PARTITION BY word ORDER BY pos), false)))
    SELECT word, pos, token, step FROM steps QUALIFY step = max(step) OVER (PARTITION BY word)
"""
_DECODE = """
    SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS bytes
    FROM tokens JOIN vocabulary ON token = id GROUP BY doc
"""


class WordCoder:
    """A DuckDB session with the merge table and the vocabulary of a rank file."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], "i4")
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        undercut = {t for a, b, merged in pairs for t in (a, b) if merged < t}
        merges = pa.table(dict(zip(("left_token", "right_token", "merged"), np.array(pairs, "i4").T, strict=True)))
        merges = merges.append_column("safe", pa.array([merged not in undercut for _, _, merged in pairs]))
        vocabulary = pa.table({"id": np.array(list(ranks.values()), "i4"), "piece": [t.decode("latin-1") for t in ranks]})
        self.db = duckdb.connect(config={"threads": 1})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")
        self.cache = PieceCache(self.encode_pieces, 150_000)
        self.tokens, self.finder = ranks, None

    def parts(self, word: bytes) -> tuple[list[bytes], int]:
        """The word cut wherever no token in it goes over the cut, and the bytes of the longest token in it."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for token in self.tokens:
                if len(token) > 1:
                    self.finder.add_word(token.decode("latin-1"), len(token))
            self.finder.make_automaton()
        starts, longest = list(range(len(word))), 1  # the first byte of a token that ends at each byte
        for end, size in self.finder.iter(word.decode("latin-1")):
            longest = max(longest, size)
            starts[end] = min(starts[end], end - size + 1)
        first = np.minimum.accumulate(np.array(starts)[::-1])[::-1]
        cuts = [*np.flatnonzero(first == np.arange(len(word))).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])], longest

    def encode_long(self, word: bytes) -> bytes:
        parts, reach = self.parts(word)
        short = list({p for p in parts if len(p) <= LONG_WORD})
        ids = dict(zip(short, self.encode_words(short), strict=True))
        return b"".join([ids[p] if p in ids else self.encode_words([p], reach)[0] for p in parts])

    def encode_words(self, words: list[bytes], reach: int = 0) -> list[bytes]:
        """For each word its ids as little-endian unsigned 32-bit integers; `reach` is the longest token in a long word."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), "u1")
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(text)) - np.repeat(starts, sizes)
        if reach:
            self.db.register("symbols", pa.table({"word": word, "pos": pos, "token": self.byte_rank[text]}))
            found = self.fixpoint(reach).fetchnumpy()
            word, token = found["word"], found["token"]
        else:
            self.db.register("symbols", pa.table({"place": word << 16 | pos, "token": self.byte_rank[text]}))
            word, token = self.last_steps(self.db.execute(_STEPS).fetchnumpy(), len(words))
        self.db.unregister("symbols")
        ids = np.ascontiguousarray(token, "<u4").tobytes()
        ends = 4 * np.searchsorted(word, np.arange(len(words)), side="right")
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def last_steps(steps: dict[str, np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens, in order, of the last step that each word is in."""
        word, step = steps["place"] >> 16, steps["step"]
        last = np.zeros(n_words, step.dtype)
        np.maximum.at(last, word, step)
        kept = np.flatnonzero(step == last[word])
        kept = kept[np.argsort(steps["place"][kept], kind="stable")]
        return word[kept], steps["token"][kept]

    def fixpoint(self, reach: int) -> duckdb.DuckDBPyConnection:
        """The same contraction in recursions of LONG_STEPS steps; words that end within one leave the work table."""
        self.db.execute("CREATE OR REPLACE TEMP TABLE work AS FROM symbols")
        self.db.execute("CREATE OR REPLACE TEMP TABLE done AS FROM work LIMIT 0")
        while self.db.execute("SELECT count(*) FROM work").fetchone()[0]:
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE next AS {_LONG.replace('@REACH', str(reach))}")
            self.db.execute(f"INSERT INTO done SELECT word, pos, token FROM next WHERE step < {LONG_STEPS}")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE work AS SELECT word, pos, token FROM next WHERE step = {LONG_STEPS}")
        return self.db.execute("SELECT word, token FROM done ORDER BY word, pos")

    def encode_pieces(self, new: list[str]) -> Iterator[bytes]:
        split = [pretokens(piece) for piece in new]
        ids = {w: self.cache.get(w) for ws in split for w in ws}
        words = [(w, w.encode()) for w, known in ids.items() if known is None]
        short = [w for w in words if len(w[1]) <= LONG_WORD]
        ids.update(zip((w for w, _ in short), self.encode_words([w for _, w in short]), strict=True))
        ids.update((w, self.encode_long(raw)) for w, raw in words if len(raw) > LONG_WORD)
        return (b"".join([ids[w] for w in ws]) for ws in split)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [pieces(text) for text in texts]
        ids = self.cache.of({piece for parts in split for piece in parts})
        return [b"".join([ids[piece] for piece in parts]) for parts in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        sizes = [len(x) // 4 for x in ids]
        token = np.frombuffer(b"".join(ids), "<u4").astype("i4")
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids)), sizes), "pos": np.arange(len(token)), "token": token}))
        found = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("tokens")
        return [found.get(i, "").encode("latin-1") for i in range(len(ids))]


def _coder(path: str) -> WordCoder:
    return held(("bpe", path), lambda: WordCoder(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens and ids (little-endian unsigned 32-bit integers as binary)."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids = _coder(path).encode([text or "" for text in block.column("text").to_pylist()])
            yield pa.record_batch([block.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for, to rows of `encode`."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "ids"):
            decoded = _coder(path).decode([x or b"" for x in block.column("ids").to_pylist()])
            yield pa.record_batch([*block.columns, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """What `decode` makes of `encode`, in one Python worker for each task, so that its memory is needed once."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for block in blocks(batches, limit=BLOCK_BYTES // 4):
            ids = coder.encode([text or "" for text in block.column("text").to_pylist()])
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.record_batch([block.column("doc_id"), n, pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op3_byte_bpe(docs: DataFrame) -> DataFrame:
    """Per document the digests of its ids and of the bytes decoded from them."""
    return encode_decode(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
