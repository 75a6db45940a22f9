"""The Merkle manifest, cross-tokenizer alignment and line dedup against brute force, with odd tables."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauselens.llm import alignment, bpe, line_dedup, merkle
from clauselens.llm.pretokens import load_ranks, pieces, pretokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, rows int, `a.b` int"
TEXTS = ["one\ntwo\nthree", None, "", "\n", "  A line \n a LINE\t\nother", "漢字 é\nÉ ü\n\n x", "x" * 3000 + "\n" + "y z " * 500, "same text", "same text", " lead  and   trail ", "tab\tand\r\nreturn\n "]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    out = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"text {i}\n{rng.random()}\ncommon line", [None, "en", "de"][i % 3], [None, "a", "b", "é", "z,"][min(rng.randrange(9), 4)], rng.choice([None, 3, i]), "t", 1, 2, 3) for i in range(90)]
    return [*out, out[5], out[5], (None, "no id\nat all", "en", "a", 5, "t", 1, 2, 3), (None, None, None, None, None, None, None, None, None), (7, "other text of 7", "en", "lone source", 1, "t", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, run):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + run])) for i in range(0, len(levels[-1]), run)])
    return levels


def path(levels, i, run):
    out = []
    for level in levels[:-1]:
        first = i // run * run
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + run])))
        i //= run
    return out


def manifest_by_hand(data, run):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in data]
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in {r[1] for r in rows}}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([leaf(r) for r in trees[s]], run) for s in names}
    top = climb([levels[s][-1][0] for s in names], run)
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            beside = path(levels[s], i, run) + path(top, k, run)
            node = leaf((*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r)
            for left, right in beside:
                node = digest(left + node + right)
            out.append((r[0], leaf(r), levels[s][-1][0], top[-1][0], digest("".join(a + b for a, b in beside)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_merkle(docs, data):
    assert sorted(map(tuple, merkle.op11_merkle_manifest(docs).collect()), key=repr) == manifest_by_hand(data, 3)


@pytest.mark.parametrize(("run", "depth"), [(3, 1), (2, 2)])
def test_merkle_of_many_stages(docs, data, run, depth):
    """Blocks of three and four leaves, so that trees and the tree of sources go through several stages."""
    found = merkle.manifest(docs, F.col("text"), run=run, depth=depth).select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof"), merkle.fold(F.col("changed"), F.col("path")).alias("folded"))
    assert sorted(((*r[:5], r[3] == r[5]) for r in found.collect()), key=repr) == [(*r[:5], True) for r in manifest_by_hand(data, run)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_merkle_of_one_source(spark, n):
    data = [(i, f"t{i}", "en", "s", 1) for i in range(n)]
    found = merkle.op11_merkle_manifest(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(map(tuple, found.collect()), key=repr) == manifest_by_hand(data, 3)


def lines_by_hand(texts, least_docs, least_chars=1):
    """For each text the lines that stay and the number of all lines."""
    split = [(t or "").split("\n") for t in texts]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    keyed = [[line.strip(" \t\n\v\f\r").translate(upper) for line in lines] for lines in split]
    held = Counter(k for keys in keyed for k in set(keys) if len(k) >= least_chars)
    return [("\n".join(x for x, k in zip(lines, keys, strict=True) if held[k] < least_docs), len(lines)) for lines, keys in zip(split, keyed, strict=True)]


@pytest.mark.parametrize(("least_docs", "least_chars", "batches"), [(10, 1, 4), (2, 1, 3), (2, 3, 1), (1, 1, 5)])
def test_line_dedup(docs, data, least_docs, least_chars, batches):
    found = sorted((r.doc_id, r.text, r.n_lines, r.n_lines - r.n_dropped) for r in line_dedup.dedup_lines(docs.na.fill({"doc_id": -1}), least_docs, least_chars, batches).collect())
    kept = lines_by_hand([r[1] for r in data], least_docs, least_chars)
    wanted = [(r[0] if r[0] is not None else -1, text, n) for r, (text, n) in zip(data, kept, strict=True)]
    assert [f[:3] for f in found] == sorted(wanted)
    assert sum(f[2] - f[3] for f in found) > 0


def test_line_dedup_digests(docs, data):
    found = Counter(map(tuple, line_dedup.op13_line_dedup(docs).collect()))
    kept = lines_by_hand([r[1] for r in data], 10)
    assert Counter((d, n, k) for d, n, _, k in found.elements()) == Counter((r[0], n, digest(text)) for r, (text, n) in zip(data, kept, strict=True))
    assert sum(n_dropped for _, _, n_dropped, _ in found.elements()) > 20


def test_line_runs(spark):
    """Levels fill like the digits of the number of batches; counts add up, and settled keys are not counted again."""
    rng, runs, true = random.Random(1), line_dedup.LineRuns(spark, 10), Counter()
    for n in range(1, 6):
        batch = {f"{rng.randrange(30):02d}".encode(): rng.randrange(1, 12) for _ in range(20)}
        true.update(batch)
        runs.add(spark.createDataFrame(list(batch.items()), "key binary, n long"))
        assert [len(level) for level in runs.levels] == [int(d) for d in reversed(f"{n:b}")]
    plan = spark.table(runs.levels[0][0]).join(spark.table(runs.levels[2][0]).hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    assert {bytes(r.key) for r in runs.frequent().collect()} == {k for k, n in true.items() if n >= 10}


def alignment_by_hand(texts):
    """What the contract says, from whole texts encoded by the libraries."""
    a_coder, b_coder = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))
    a_coder.encode_special_tokens = True
    names = {i: t for t, i in a_coder.get_vocab().items()}
    chars = alignment.byte_level()
    docs = []
    for text in texts:
        a, b = (a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)) if text else ([], [])
        a_bytes = [bytes(chars[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((0, 0, []))
            continue
        groups, i, j = [], 0, 0
        while i < len(a):
            held, size_a, size_b = ([a[i]], [b[j]]), len(a_bytes[i]), len(b_bytes[j])
            while size_a != size_b:
                if size_a < size_b:
                    i += 1
                    held[0].append(a[i])
                    size_a += len(a_bytes[i])
                else:
                    j += 1
                    held[1].append(b[j])
                    size_b += len(b_bytes[j])
            groups.append(held)
            i, j = i + 1, j + 1
        docs.append((len(a), len(b), groups))
    links = [[(x, y) for ga, gb in groups for x in ga for y in gb] for _, _, groups in docs]
    n = Counter(pair for found in links for pair in set(found))
    best = Counter()
    for (x, _), count in n.items():
        best[x] = max(best[x], count)
    text_of = [";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups) for _, _, groups in docs]
    return [(d[0], d[1], len(d[2]), len(found), sum(n[p] == best[p[0]] for p in found), sum(n[p] for p in found), digest(t) if t else "") for d, found, t in zip(docs, links, text_of, strict=True)], n


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "▁", "x\n ", "x\n\n  y ", " x", "  x", "\n", "　漢字 かな", "naïve café 🙂🙂 ok", "tokenization of untokenizable tokens", "\x1c \x1c a\x1cb", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3,
    "can't won't I'll  they've", "1234567 89 0.5", "\t\tif (x) {\r\n\t\t\treturn;\r\n", "a \n b", "é ​ zero", "x" * 5000, "the and the and", "İstanbul ğüş ", " ", "   ", "a  ", "﻿bom", "\x00 nul",
]


@pytest.mark.parametrize("head", [alignment.HEAD, 5, 0])
def test_alignment(spark, docs, data, head):
    rng = random.Random(5)
    fuzz = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "é", "tion", "漢", ".", "　", "1", "'s"]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*ODD, *fuzz, *(r[1] for r in data), "again", "again"])]
    wanted, n = alignment_by_hand([t for _, t in rows])
    found, pairs = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), head=head)
    assert [tuple(r)[1:] for r in sorted(found.collect())] == wanted
    held = {(r.a, r.b): r for r in pairs.collect()}
    assert {k: r.n for k, r in held.items()} == n
    assert all(r.is_best == (r.n == max(x.n for x in held.values() if x.a == r.a)) for r in list(held.values())[:100])


def test_alignment_of_repeated_rows(docs, data):
    wanted, _ = alignment_by_hand([r[1] for r in data])
    assert Counter(map(tuple, alignment.op12_cross_tokenizer(docs).collect())) == Counter((r[0], *w) for r, w in zip(data, wanted, strict=True))


def test_twins_have_the_same_bytes():
    v = alignment.Vocabularies(public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))
    assert all(v.b_bytes[b] == a for a, b in zip(v.a_bytes, v.same, strict=True) if b >= 0) and (v.same >= 0).sum() > 10_000
    assert v.b.id_to_piece(int(v.same[v.a.token_to_id("A")])) == "A"


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_odd_columns(spark, stage):
    words = ["river", "stone", "under", "bright", "window", "letter", "carry", "people", "often", "small", "garden", "winter", "quiet", "along", "summer"]
    rng = random.Random(stage)
    rows = [(i, " ".join(rng.sample(words, 12)), "en", f"src{i % 3}", 80, i, "x", [i], None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` string, `mix. x` array<int>, `text.lower` string")
    name, run = corpus_pipeline.STAGES[stage]
    kept = run(spark, docs, "")
    assert kept.columns == docs.columns, name
    assert all(r["a.b"] == r.doc_id and r["mix. x"] == [r.doc_id] for r in kept.collect())


@pytest.mark.parametrize("alphabet", ["ab", "aab", "theraing", "0123456789", "=-", "éaß漢", "abcdefghijklmnopqrstuvwxyz"])
def test_bpe_of_long_words(alphabet):
    """Words of up to 20,000 characters, encoded like the library does, in about linear time."""
    ranks = load_ranks(public_tokenizers.path(bpe.RANKS))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.WordCoder(public_tokenizers.path(bpe.RANKS)), random.Random(7)
    for n in (257, 600, 3000, 20_000):
        word = "".join(rng.choice(alphabet) for _ in range(n))
        began = time.time()
        assert np.frombuffer(coder.encode([word])[0], "<u4").tolist() == encoding.encode_ordinary(word)
        assert time.time() - began < 20


def test_bpe_of_a_megabyte_without_spaces():
    ranks = load_ranks(public_tokenizers.path(bpe.RANKS))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = base64.b64encode(random.Random(9).randbytes(750_000)).decode()
    began = time.time()
    assert np.frombuffer(bpe.WordCoder(public_tokenizers.path(bpe.RANKS)).encode([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)
    assert time.time() - began < 60


@pytest.mark.parametrize("text", ["x\n ", "a \n ", "  \n", "x ", "x　 ", "\t ", " \n "])
def test_pieces_at_the_end(text):
    assert [w for p in pieces(text) for w in pretokens(p)] == regex.findall(public_tokenizers.PATTERN, text)
