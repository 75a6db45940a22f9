"""Token ids of documents as length-delimited binary records, with an offset index for shuffled reads.

A set of files is a folder of shards in ascending doc_id order:

    part-00000.records   records, one after the other: the length of the payload (8 bytes), the masked CRC-32C of these
                         8 bytes, the payload, the masked CRC-32C of the payload; the framing that TFRecord readers know
    part-00000.index     the offset of each record, then the end of the last (8 bytes each)

All numbers are little-endian. A payload is doc_id (8 bytes), the number of ids (4), the bytes of an id (2 or 4, the
smallest that holds the vocabulary; the top bit is set if doc_id is null), the ids, and zeros up to a multiple of 4.

Special strings of the tokenizer stand for their ids wherever a text has them, as the library reads them; the parts
between are encoded each for itself.

Null and empty texts give a record with the end id alone. Rows with one doc_id are kept, ordered by a hash of their
text. The shards are cut by ranges of (doc_id, hash), so that not even a repeated doc_id makes a large shard, and a
lost executor's shard is written again under its own name. There are as many shards as spark.sql.shuffle.partitions, or
as the input has partitions if these are more, so that their size does not grow with the input. An empty table gives no records; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.crc32c import crc32c, masked
from clauselens.llm.pretokens import PieceCache
from clauselens.llm.shared import blocks, held, id_and_text, shared_folder

TOKENIZER, END_ID = "word_bpe_49k.json", 2
NULL_ID = 1 << 31


#: The characters that stand for the bytes 0 to 255 in a byte-level vocabulary: printable ones for themselves, the
#: others, in order, the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = dict(zip([*sorted(_PRINTABLE), *(b for b in range(256) if b not in _PRINTABLE)], [*sorted(_PRINTABLE), *range(256, 256 + 256 - len(_PRINTABLE))], strict=True))


class WordTokenizer:
    """A byte-level tokenizer that drops white space and so treats the parts between spaces one by one.

    Parts go through the library's normalizer, its splitting pattern and its model. Equal parts and words go once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        stored = json.loads(tokenizer.to_str())
        split, byte_level = stored["pre_tokenizer"]["pretokenizers"]
        if (split["behavior"], split["invert"], byte_level["type"], byte_level["add_prefix_space"]) != ("Removed", True, "ByteLevel", False):
            raise ValueError("a tokenizer with words found by a pattern and mapped to byte characters is needed")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.normalize, self.tokenize = tokenizer.normalizer.normalize_str, tokenizer.model.tokenize
        special = {t["content"]: t for t in stored["added_tokens"]}
        if any(" " in text or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for text, t in special.items()):
            raise ValueError("special strings that take in what is around them are not supported")
        # Of special strings that begin at one place the longest counts.
        self.special = re.compile("(" + "|".join(re.escape(text) for text in sorted(special, key=len, reverse=True)) + ")")
        self.mark = os.path.commonprefix([*special]) if special else "\0no special string\0"  # what they all begin with
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special_ids = {text: t["id"].to_bytes(self.width, "little") for text, t in special.items()}
        self.words, self.cache = PieceCache(self.encode_words, 400_000), PieceCache(self.encode_pieces, 400_000)

    def encode_words(self, new: list[str]) -> Iterator[bytes]:
        pack = struct.Struct(f"<{'H' if self.width == 2 else 'I'}").pack
        for word in new:
            word = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
            yield b"".join([pack(token.id) for token in self.tokenize(word)])

    def encode_pieces(self, new: list[str]) -> Iterator[bytes]:
        if not any(self.mark in piece for piece in new):
            return self.encode_plain(new)
        parts = [self.special.split(piece) for piece in new]
        plain = list({part for split in parts for part in split[::2]})
        ids = dict(zip(plain, self.encode_plain(plain), strict=True))
        # Every second part is a special string.
        return (b"".join([self.special_ids[part] if k % 2 else ids[part] for k, part in enumerate(split)]) for split in parts)

    def encode_plain(self, new: list[str]) -> Iterator[bytes]:
        lower = [piece.lower() if piece.isascii() else self.normalize(piece) for piece in new]
        split = [[piece] if piece.isalpha() else self.find(piece) for piece in lower]
        known = self.words.of({word for words in split for word in words})
        return (b"".join([known[word] for word in words]) for words in split)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, `width` bytes each."""
        split = [text.split(" ") for text in texts]
        known = self.cache.of({piece for parts in split for piece in parts})
        return [b"".join([known[piece] for piece in parts]) for parts in split]


def _tokenizer(path: str) -> WordTokenizer:
    return held(("words", path), lambda: WordTokenizer(path))


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Framed records and the number of bytes of each."""
    sizes = np.array([len(p) for p in payloads], "<u8")
    heads = masked(crc32c(sizes.view("<u4"), np.full(len(sizes), 2)))
    tails = masked(crc32c(np.frombuffer(b"".join(payloads), "<u4"), sizes // 4))
    head = np.empty(len(sizes), [("size", "<u8"), ("crc", "<u4")])
    head["size"], head["crc"] = sizes, heads
    h, t = head.tobytes(), tails.astype("<u4").tobytes()
    return b"".join(x for i, p in enumerate(payloads) for x in (h[12 * i : 12 * i + 12], p, t[4 * i : 4 * i + 4])), sizes.astype("i8") + 16


def unframe(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of the records that start at `offsets` (and the end of the last); raises on a wrong checksum."""
    payloads = [data[a + 12 : b - 4] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    again, _ = frame(payloads)
    if again != data:
        raise ValueError("a record's length or checksum is wrong")
    return payloads


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID, shards: int | None = None) -> list[dict]:
    """Writes the files and returns the manifest: for each shard its number, records and ids.

    The manifest has a row for each file, so that the driver can hold it.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    shards = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = _tokenizer(path), TaskContext.get()
        shard, offsets, ids = task.partitionId(), [np.zeros(1, "i8")], 0
        fs, at = pa.fs.FileSystem.from_uri(folder)
        name, mine = f"{at}/part-{shard:05d}", f"{at}/attempt-{task.taskAttemptId()}"
        end = b"" if end_id is None else end_id.to_bytes(coder.width, "little")
        with fs.open_output_stream(f"{mine}.records") as out:
            for block in blocks(batches):
                payloads = []
                for doc_id, x in zip(block.column("doc_id").to_pylist(), coder.encode([t or "" for t in block.column("text").to_pylist()]), strict=True):
                    x += end
                    n = len(x) // coder.width
                    ids += n
                    head = (doc_id or 0).to_bytes(8, "little", signed=True) + n.to_bytes(4, "little") + (coder.width | (NULL_ID if doc_id is None else 0)).to_bytes(4, "little")
                    payloads.append(head + x + bytes(-len(x) % 4))
                data, sizes = frame(payloads)
                out.write(data)
                offsets.append(np.cumsum(sizes) + offsets[-1][-1])
        with fs.open_output_stream(f"{mine}.index") as out:
            out.write((index := np.concatenate(offsets)).astype("<i8").tobytes())
        for kind in ("records", "index"):
            fs.move(f"{mine}.{kind}", f"{name}.{kind}")
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(index) - 1], pa.int64()), pa.array([ids], pa.int64())], ["shard", "records", "ids"])

    fs, at = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    text = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    done = text.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return [r.asDict() for r in sorted(done.mapInArrow(run, "shard int, records long, ids long").collect())]


def read(spark, folder: str, manifest: list[dict], block_bytes: int = 8 << 20) -> DataFrame:
    """Per record: doc_id, start (ids before it), n_tokens and ids (little-endian unsigned 32-bit integers)."""
    starts = np.cumsum([0, *(m["ids"] for m in manifest)]).tolist()
    shards = spark.createDataFrame([(m["shard"], s) for m, s in zip(manifest, starts, strict=False)], "shard int, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(folder)
        for shard, start in ((s, t) for b in batches for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            with fs.open_input_file(f"{at}/part-{shard:05d}.index") as file:
                offsets = np.frombuffer(file.read(), "<i8")
            with fs.open_input_file(f"{at}/part-{shard:05d}.records") as file:
                i = 0
                while i < len(offsets) - 1:
                    k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1)
                    file.seek(int(offsets[i]))
                    rows = []
                    for p in unframe(file.read(int(offsets[k] - offsets[i])), offsets[i : k + 1] - offsets[i]):
                        n, width = int.from_bytes(p[8:12], "little"), int.from_bytes(p[12:16], "little")
                        doc_id = None if width & NULL_ID else int.from_bytes(p[:8], "little", signed=True)
                        rows.append((doc_id, start, n, np.frombuffer(p, f"<u{width & 7}", n, 16).astype("<u4").tobytes()))
                        start += n
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])
                    i = k

    return shards.repartition(max(1, len(manifest)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(docs: DataFrame) -> DataFrame:
    """Per document, from the files read back: where its ids start, how many there are and their checksum."""
    folder = shared_folder(docs.sparkSession)
    manifest = write(docs, folder)
    return read(docs.sparkSession, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
