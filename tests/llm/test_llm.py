"""The operators on a small table with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauselens.llm import bpe, crc32c, jaccard, language_id, license_scan, mixing, quality, queries, sharding, simhash, tiff_media, token_counts, token_files
from clauselens.llm.pretokens import load_ranks, pieces, pretokens

LONG = "der lange Text geht weiter und weiter. " * 4000
TEXTS = [
    "The first of the texts is in English, and it is as plain as the next one.", "Le chat est sur la table et il dort dans la maison.", None, "", "   a   b\n\n c \t d ",
    "a" * 700, LONG, "漢字かな交じり文 ğüş İstanbul's it's  don't\r\n!!", "Released under the MIT License.", "x The first of the texts is in English, and it is as plain as the next one.",
    "This work is licensed under the GNU General Public License, version 3.\nend", "12345 ½ ²³ 99", "a  b   c    d", "The first of the texts is in English, and it is as plain as the next one.", "trail   ", "é É Ç",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, shard int, print long"


@pytest.fixture(scope="module")
def data():
    out = [(i, t, "fr" if i == 1 else "de" if i == 6 else None if i == 3 else "en", f"src{i % 3}" if i != 5 else None, len(t or ""), 1, 2, 3) for i, t in enumerate(TEXTS)]
    return [*out, out[0], (None, "no id at all", "en", "src1", 12, 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pieces_keep_pretokens():
    import regex

    for text in TEXTS:
        assert [w for p in pieces(text or "") for w in pretokens(p)] == regex.findall(public_tokenizers.PATTERN, text or "")


def test_token_counts(docs, ranks):
    scores = token_counts.zipf_scores(ranks)

    def best(word):
        forward = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            forward.append(max((forward[s][0] + scores[word[s:end]], forward[s][1] - 1) for s in range(end) if word[s:end] in scores and end - s <= 128))
        return -forward[-1][1]

    for row in token_counts.op1_token_counts(docs).collect():
        text = "no id at all" if row.doc_id is None else TEXTS[row.doc_id] or ""
        words = [w for p in pieces(text) for w in pretokens(p)]
        assert (row.n_pretokens, row.n_tokens) == (len(words), sum(best(w.encode()) for w in words))


def test_trie_nodes_and_terminals(ranks):
    counter = token_counts.TrieCounter(token_counts.zipf_scores(ranks))
    assert [counter.insert(w) for w in (b"tokenize", b"tokens", b"tokenize", b"zz" * 300)] == [token_counts.TrieCounter(counter.scores, 1).insert(w) for w in (b"tokenize", b"tokens", b"tokenize", b"zz" * 300)]
    assert len(counter.forward) == 1 + len("tokenize") + len("s") + 600 and len(counter.terminal) == 3


def test_token_files(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    found = sorted(token_files.op2_token_files(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 0, 0, *range(1, len(TEXTS))]
    start = 0
    for r in found:
        ids = tokenizer.encode("no id at all" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x<|startoftext|>y <|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "é<|endoftext|>\u0301 e\u0301", "<|endoftext|>" * 3000])
def test_special_strings(text):
    path = public_tokenizers.path(token_files.TOKENIZER)
    ids = np.frombuffer(token_files.WordTokenizer(path).encode([text])[0], "<u2").tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_records_notice_damage():
    assert crc32c.crc32c(np.zeros(8, "<u4"), np.array([8]))[0] == 0x8A9136AA
    data, sizes = token_files.frame([b"abcd", b"efghijkl" * 300])
    offsets = np.array([0, *np.cumsum(sizes)])
    assert token_files.unframe(data, offsets) == [b"abcd", b"efghijkl" * 300]
    with pytest.raises(ValueError):
        token_files.unframe(data[:20] + b"?" + data[21:], offsets)


def test_bpe(docs, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.op3_byte_bpe(docs).collect():
        text = "no id at all" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    split = bpe.decode(bpe.encode(docs)).collect()
    assert all(bytes(r.decoded).decode() == (TEXTS[r.doc_id] or "") for r in split if r.doc_id is not None)


def test_bpe_long_word(ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.WordCoder(public_tokenizers.path(bpe.RANKS)), np.random.default_rng(1)
    for alphabet in ("ab", "theraing ".strip(), "éaß漢"):
        word = "".join(rng.choice(list(alphabet), 900))
        assert list(np.frombuffer(coder.encode([word])[0], "<u4")) == encoding.encode_ordinary(word)


def test_tiff(docs):
    for r in tiff_media.op4_tiff_media(docs).collect():
        text = ("no id at all" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = text + b"\xff" * ((-len(text)) % 576 if text else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def pack_lzw(data):
    """An encoder by the format's rule: codes grow from 9 to 12 bits, one early, and the table is cleared when it is full."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    table, before, width = {bytes([b]): b for b in range(256)}, b"", 9
    put(256, 9)
    for b in data:
        now = before + bytes([b])
        if now in table:
            before = now
            continue
        put(table[before], width)
        table[now] = len(table) + 2
        width = min(12, (len(table) + 2).bit_length())
        if len(table) + 2 >= 4094:
            put(256, width)
            table, width = {bytes([b]): b for b in range(256)}, 9
        before = bytes([b])
    put(table[before], width)
    put(257, min(12, (len(table) + 3).bit_length()))
    return bytes(out) + bytes([held << (8 - bits) & 255])


def pack_bits(data):
    out, i = bytearray(), 0
    while i < len(data):
        run = next((k for k in range(1, min(128, len(data) - i)) if data[i + k] != data[i]), min(128, len(data) - i))
        if run > 2:
            out += bytes([257 - run, data[i]])
        else:
            run = min(3, len(data) - i)
            out += bytes([run - 1]) + data[i : i + run]
        i += run
    return bytes(out)


PACK = {tiff_media.NONE: bytes, tiff_media.LZW: pack_lzw, tiff_media.DEFLATE: zlib.compress, tiff_media.OLD_DEFLATE: zlib.compress, tiff_media.PACKBITS: pack_bits}


def tiff_by_hand(images, order, compression, tile, predictor):
    """A file of one directory for each image (height, width, samples), in strips of 5 rows or tiles of 16 by 16."""
    out, link = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 0)), 4
    for image in images:
        height, width, samples = image.shape
        across, down = (16, 16) if tile else (width, 5)
        parts = []
        for top in range(0, height, down):
            for left in range(0, width, across):
                part = image[top : top + down, left : left + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                parts.append(PACK[compression](np.ascontiguousarray(part).tobytes()))
        offsets = [len(out) + sum(map(len, parts[:k])) for k in range(len(parts))]
        out += b"".join(parts)
        places = ("tile_offsets", "tile_counts") if tile else ("offsets", "counts")
        fields = {"width": [width], "height": [height], "bits": [8] * samples, "compression": [compression], "samples": [samples], places[0]: offsets, places[1]: [*map(len, parts)], "predictor": [predictor]}
        fields |= {"tile_width": [16], "tile_height": [16]} if tile else {"rows_per_strip": [5]}
        rows = []
        for name, values in sorted(fields.items(), key=lambda f: tiff_media.TAGS[f[0]]):
            kind = 4 if name in places else 3
            data = struct.pack(f"{order}{len(values)}{'I' if kind == 4 else 'H'}", *values)
            if len(data) > 4:
                place = len(out)
                out += data
                data = struct.pack(f"{order}I", place)
            rows.append(struct.pack(f"{order}HHI", tiff_media.TAGS[name], kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(rows)) + b"".join(rows)
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [False, True])
@pytest.mark.parametrize("compression", sorted(PACK))
def test_tiff_layouts(order, tile, compression):
    rng = np.random.default_rng(2)
    for samples, predictor in ((1, 1), (1, 2), (3, 1), (3, 2)):
        images = [rng.integers(0, top, shape, "u1") for top, shape in ((256, (37, 70, samples)), (3, (16, 16, samples)), (256, (1, 1, samples)))]
        found = list(tiff_media.pages(tiff_by_hand(images, order, compression, tile, predictor)))
        assert all(np.array_equal(f, image[:, :, 0] if samples == 1 else image) for f, image in zip(found, images, strict=True))


def test_lzw_of_all_widths():
    data = np.random.default_rng(8).integers(0, 40, 30_000, "u1").tobytes()
    assert tiff_media.unpack_lzw(pack_lzw(data)) == data and tiff_media.unpack_bits(pack_bits(data + b"\0" * 700)) == data + b"\0" * 700


def test_tiff_media_and_features(docs):
    """The stored form reads back with its own digest, pages in order, and equal texts make equal rows."""
    rows = tiff_media.op4_tiff_media(docs).collect()
    for r in rows:
        text = ("no id at all" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = text + b"\xff" * ((-len(text)) % 576 if text else 576)
        media = tiff_media.tiff(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert b"".join(p.tobytes() for p in tiff_media.pages(media)) == payload
        counts = Counter(b >> 4 for b in payload)
        assert r.feature == ",".join(str(counts[k] * 10_000 // len(payload)) for k in range(16))
    assert len({tuple(r) for r in rows if r.doc_id == 0}) == 1


def test_tiff_codecs():
    assert tiff_media.unpack_bits(bytes([2, 65, 66, 67, 254, 68, 128, 0, 69])) == b"ABCDDDE"
    codes, width, packed, bits = [256, 65, 66, 258, 260, 257], 9, 0, 0
    for code in codes:
        packed, bits = packed << width | code, bits + width
    assert tiff_media.unpack_lzw((packed << (-bits % 8)).to_bytes((bits + 7) // 8, "big")) == b"ABABABA"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    prints = [brute_print(t) for t in TEXTS]
    group = list(range(len(TEXTS)))
    for _ in group:
        group = [min(group[j] for j in range(len(TEXTS)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(TEXTS))]
    for r in simhash.op5_simhash(docs).collect():
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", group[r.doc_id])


def test_simhash_links_in_cut_shards(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    items = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in (0, 1, 2, 3) for _ in range(40)})
    ours = simhash.components(simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in items], "print long"), shard=8))
    head = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            low = min((head[b] for b in items if (a ^ b).bit_count() <= 2), key=simhash._signed)
            if low != head[a]:
                head[a], changed = low, True
    found = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in ours.collect()}
    assert {x: found.get(x, x) for x in items} == head


def test_license_scan(docs):
    found = {(r.doc_id, r.license): r.containment for r in license_scan.op6_license_scan(docs).collect()}
    assert found == {(8, "MIT"): 1.0, (10, "GPL-3.0"): 1.0}


def rendered(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, (int, float)) else x for x in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("more", [False, True])
def test_same_as_sql(spark, data, tmp_path, name, more):
    """On the smallest input, and on that with nulls, ties, repeated rows, long texts and clashing columns."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if more:
        notice = license_scan.TEMPLATES["MIT-notice"].replace("charge", "cost")
        texts = [(2000, f"{LONG} {notice} {notice}", "en", "x", 1, 1, 1, 1), (2001, notice.upper(), "en", "x", 1, 1, 1, 1)]
        rows = rows.unionByName(spark.createDataFrame([*data, *texts, texts[0]], SCHEMA), allowMissingColumns=True)
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        theirs = db.sql(queries.ORACLE_SQL[name])
        columns = sorted(theirs.columns)
        theirs = theirs.project(", ".join(columns)).fetchall()
    ours = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(ours.columns) == columns and rendered(ours.select(*columns).collect()) == rendered(theirs)


def test_bands_recall(spark):
    """Windows of LONG shingles that share so many that their likeness is 0.45 or more meet in a band."""
    rng, found = np.random.default_rng(7), []
    for _ in range(60):
        shared = int(rng.integers(5, 9))
        own, other = (rng.integers(-(2**63), 2**63, license_scan.LONG).tolist() for _ in range(2))
        found.append((own, [*own[:shared], *other[shared:]]))
    table = spark.createDataFrame(found, "a array<long>, b array<long>").select(*(license_scan.bands(F.col(c), license_scan.LONG).alias(c) for c in "ab"))
    met = [bool(set(r.a) & set(r.b)) for r in table.collect()]
    assert sum(met) >= 0.9 * len(met)
    with pytest.raises(ValueError, match="few"):
        license_scan.scan(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), {"few": "only three words"})


def test_language_id(spark):
    def rows(name):
        return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")

    truth = {r.doc_id: (r.lang, r.text) for r in rows("documents").collect()}
    found = language_id.op7_language_id(rows("documents")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == truth[r.doc_id][0] for r in found if r.held_out]
    assert sum(held) / len(held) >= 0.95


def test_language_id_cases(spark, docs, data):
    """Nulls, no letters, long texts, repeated rows, ties and clashing columns; no labels; more languages than are learned."""
    table = docs.withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "held_out": F.lit(None)})
    found = language_id.op7_language_id(table).collect()
    assert len(found) == len(data)
    for r in found:
        text = "no id at all" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and (r.lang_pred != "und" or r.score == 0)
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 0}) == 1 and sum(r.doc_id == 0 for r in found) == 2
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.op7_language_id(unlabelled).collect()} == {("und", 0.0)}
    same = spark.createDataFrame([(i, "abc abc", lang) for i in range(40) for lang in ("zz", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.op7_language_id(same).collect()} == {"aa"}
    assert language_id.train(docs, most_langs=1).langs == ["en"]


def test_code_lengths():
    grams = np.unique(language_id.packed([b"abab"], 2)[0], return_counts=True)
    tree = language_id.ContextTree(grams[0].astype("i8"), grams[1], 1)
    key = lambda a, b: np.array([ord(a) << 8 | ord(b)])
    assert tree.bits(key("a", "b"))[0] == pytest.approx(-np.log2(2 / 3))
    assert tree.bits(key("a", "a"))[0] == pytest.approx(-np.log2(1 / 3) - np.log2(2 / 6))
    assert tree.bits(key("z", "z"))[0] == pytest.approx(-np.log2(2 / 6) + 8)


def shares_by_hand(budget, children):
    """Shares of children (name, weight, capacity): the common rate rises until the budget is spent or all are full."""
    shares, left, open_ = {}, budget, [c for c in children if c[1] > 0]
    while full := [c for c in open_ if c[2] * sum(x[1] for x in open_) <= c[1] * left]:
        least = min(full, key=lambda c: (Fraction(c[2], c[1]), c[0]))
        shares[least[0]], left = least[2], left - least[2]
        open_.remove(least)
    total = sum(x[1] for x in open_)
    return {c[0]: 0 for c in children} | shares | {c[0]: min(c[2], c[1] * left // total) for c in open_}


def mix_by_hand(rows, fraction, weights, epochs, seed):
    """Copies of each row (doc_id, tokens, domain, lang, source), with the tree as nested loops."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[2:], []).append(r)

    def weight(depth, name):
        return weights.get(mixing.LEVELS[depth], {}).get(name, 1)

    capacity = {leaf: epochs * sum(r[1] for r in own) * all(weight(d, leaf[d]) > 0 for d in range(3)) for leaf, own in leaves.items()}
    total = sum(r[1] for r in rows) * fraction[0] // fraction[1]
    budgets = {(): total}
    for depth in range(3):
        for parent in [p for p in budgets if len(p) == depth]:
            names = sorted({leaf[depth] for leaf in leaves if leaf[:depth] == parent})
            children = [(n, weight(depth, n), sum(c for leaf, c in capacity.items() if leaf[: depth + 1] == (*parent, n))) for n in names]
            budgets |= {(*parent, n): s for n, s in shares_by_hand(budgets[parent], children).items()}
    state = {}
    for leaf, own in leaves.items():
        tokens = sum(r[1] for r in own)
        whole, rest = divmod(budgets[leaf], tokens) if tokens else (0, 0)
        order = sorted({i for i, *_ in own}, key=lambda i: (int(hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()[:15], 16), -1 if i is None else i))
        spent, taken, following = 0, set(), None
        for i in order:
            n = sum(r[1] for r in own if r[0] == i)
            if spent + n > rest:
                following = (n, i) if whole < epochs and whole * tokens + rest < capacity[leaf] else None
                break
            spent += n
            taken.add(i)
        state[leaf] = [whole, taken if tokens else set(), whole * tokens + spent, following]
    for depth in (2, 1, 0):
        for parent in {leaf[:depth] for leaf in leaves}:
            own = [leaf for leaf in leaves if leaf[:depth] == parent]
            left = (sum(budgets[leaf] for leaf in own) if depth else min(total, sum(capacity.values()))) - sum(state[leaf][2] for leaf in own)
            for leaf in sorted((x for x in own if state[x][3]), key=lambda x: (state[x][3][0], x)):
                n, i = state[leaf][3]
                if n > left:
                    break
                left -= n
                state[leaf][1].add(i)
                state[leaf][2:] = [state[leaf][2] + n, None]
    return [state[r[2:]][0] + (r[0] in state[r[2:]][1]) for r in rows], min(total, sum(capacity.values())) - sum(s[2] for s in state.values()), [s[3][0] for s in state.values() if s[3]]


@pytest.mark.parametrize(("fraction", "weights"), [((1, 2), mixing.WEIGHTS), ((5, 2), {"source": {"src0": 4}, "lang": {"fr": 7}}), ((1, 3), {"domain": {"domain1": 0}, "lang": {"de": 0, "en": 3}}), ((9, 1), {"source": {"src1": 0}}), ((1, 2), {"domain": {f"domain{d}": 0 for d in ("", 0, 1, 2, 3)}})])
def test_mixing_against_brute_force(spark, fraction, weights):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None, "en", "src0"), (901, "", None, None), (902, "x" * 90_000, "fr", "src1"), (None, "no id", "en", "src0"), (None, "no id", "en", "src0"), rows[0], rows[0], (903, "tie", "xx", "web"), (904, "tie", "xx", "web")]
    table = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, lang string, source string, n int, _h int, domain string")
    found = mixing.mix(table, fraction, weights).collect()
    given = [(r.doc_id, r.mix.tokens, r.mix.domain, r.mix.lang, r.mix.source) for r in found]
    sizes = sorted((len((t or "").encode()) + 3) // 4 for _, t, _, _ in rows)
    assert sorted(g[1] for g in given) == sizes and all(g[3] == (r.lang or "") and g[4] == (r.source or "") for g, r in zip(given, found, strict=True))
    copies, unspent, following = mix_by_hand(given, fraction, weights, mixing.EPOCHS, mixing.SEED)
    assert [r.mix.copies for r in found] == copies
    assert 0 <= unspent < min(following, default=1)
    assert mixing.mixed(table, fraction=fraction, weights=weights).count() == sum(copies)


def kneser_ney_by_hand(texts, order):
    """Probability functions by order of the modified Kneser-Ney model of `texts`, from the definition, with dictionaries."""
    counts = Counter(t[i : i + order] for t in (b"\n" * (order - 1) + x for x in texts) for i in range(len(t) - order + 1))
    out = {0: lambda gram: 1 / 256}
    levels = {order: counts}
    for o in range(order - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    for o in range(1, order + 1):
        c, n = levels[o], [sum(v == k for v in levels[o].values()) for k in (1, 2, 3, 4)]
        d = [0, 0.5, 0.75, 0.9]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]
        total, mass = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3)]

        def p(gram, c=c, d=d, total=total, mass=mass, below=out[o - 1]):
            h = gram[:-1]
            return below(gram[1:]) if not total[h] else (c[gram] - d[min(c[gram], 3)]) / total[h] + mass[h] / total[h] * below(gram[1:])

        out[o] = p
    return out


def test_kneser_ney_by_hand(spark):
    texts = ([b"the cat and the hat and that", b"the hen, the hen and the end", b"a cat"], [b"that hat then", b"the cat and a bat"])
    counts = [Counter((b"\n\n" + t)[i : i + 3] for t in half for i in range(len(t))) for half in texts]
    grams = {*counts[0], *counts[1], *(b"th" + bytes([k]) for k in range(256)), *(b"zz" + bytes([k]) for k in range(256))}
    table = spark.createDataFrame([("en", int.from_bytes(g), counts[0][g], counts[1][g]) for g in grams], "lang string, gram long, c0 long, c1 long")
    found = {r.gram.to_bytes(3): r for r in quality.probabilities(table, 3, 2).collect()}
    assert set(found) == grams
    for half in (0, 1):
        by_hand = kneser_ney_by_hand(texts[half], 3)
        assert all(found[g][f"p{half}"] == pytest.approx(by_hand[3](g)) and found[g][f"q{half}"] == pytest.approx(by_hand[2](g[1:])) for g in grams)
        for context in (b"th", b"zz"):
            assert sum(found[context + bytes([k])][f"p{half}"] for k in range(256)) == pytest.approx(1)


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = len({i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)})
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_base_rules(docs):
    for r in quality.op9_quality_rules(docs).collect():
        assert tuple(r[c] for c in BASE) == base_by_hand("no id at all" if r.doc_id is None else TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_against_brute_force(spark):
    """All documents of the smallest input, with nulls, copies and noise, by dictionaries; the model broadcast and joined."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "\n\n ", "xx"), (1003, rows[0][1], rows[0][2]), (None, rows[1][1], None), (1004, "qz" * 400 + " a b c d e f g h i j k", "en")]
    langs = Counter(lang or "" for _, _, lang in rows)
    pool = [lang if lang and langs[lang] >= quality.LEAST_DOCS else "" for _, _, lang in rows]
    data = [(text or "").encode() for _, text, _ in rows]
    half = [xxhash.xxh64_intdigest(x, 42) & 1 if text is not None else 0 for x, (_, text, _) in zip(data, rows)]
    figures = []
    models = {(p, h): kneser_ney_by_hand([x for x, q, k in zip(data, pool, half) if (q, k) == (p, h)], quality.ORDER) for p in set(pool) for h in (0, 1)}
    for x, p, h in zip(data, pool, half):
        model, padded, units = models[p, 1 - h], b"\n" * (quality.ORDER - 1) + x, [0, 0]
        for i in range(len(x)):
            gram = padded[i : i + quality.ORDER]
            units[0] += round(-math.log2(model[quality.ORDER](gram)) * quality.UNIT)
            units[1] += round(-math.log2(model[quality.LOW](gram[-quality.LOW :])) * quality.UNIT)
        figures.append([int(1000 * u / quality.UNIT / max(len(x), 1) + 0.5) for u in units])
    base = [base_by_hand(text) for _, text, _ in rows]
    kept = []
    for p, b, f in zip(pool, base, figures):
        own = [g for q, c, g in zip(pool, base, figures) if q == p and not c[5]]
        inside = not b[5]
        for k in (0, 1) if inside else ():
            low, mid, high = np.quantile([g[k] for g in own], [0.25, 0.5, 0.75])
            inside &= abs(f[k] - mid) <= max(quality.BAND * (high - low), quality.MARGIN) + quality.SHORT / max(b[0], 10)
        kept.append(bool(inside))
    expected = sorted(map(repr, ((i, *b, *f, k) for (i, _, _), b, f, k in zip(rows, base, figures, kept))))
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, n_words int, half string")
    for most in (quality.BROADCAST_GRAMS, 0):
        found = quality.judge(table, broadcast_grams=most).select("doc_id", *BASE, "thousandths", "low_thousandths", "kept").collect()
        assert sorted(repr(tuple(r)) for r in found) == expected
    assert 0 < sum(kept) < len(kept) and not kept[-1]
    good = quality.keep_good(table)
    assert good.columns == table.columns and sorted(repr(r.doc_id) for r in good.collect()) == sorted(repr(r[0]) for r, k in zip(rows, kept) if k)


def test_sharding(docs, data):
    out = sharding.op10_sharding(docs).collect()
    assert len(out) == len(data)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    text = {i: t for i, t, *_ in data}
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, zlib.crc32((text[r.doc_id] or "").encode())) for r in out)


def test_slots_of_a_crowded_key(spark):
    rows = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN id ELSE 7 END AS size", "id % 5 AS crc", "CAST(id % 2 AS INT) AS shard")
    out = sharding.number(rows, "shard", "doc_id", ["size", "crc"], range_rows=16).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(450))
    assert Counter((r.doc_id, r.size, r.crc) for r in out) == Counter((r.doc_id, r.size, r.crc) for r in rows.collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < docs.select("doc_id").distinct().count() <= 200


def test_pipeline_stages_by_hand(spark, tmp_path):
    """run() on nulls, empty and long texts, repeated rows, unlike texts under one doc_id, copies, and clashing columns."""
    import corpus_pipeline

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    copied = next(r for r in given if len(r.text.split()) > 60 and not base_by_hand(r.text)[-1])
    near = copied.text.split()
    near[30] = "and"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in given]
    rows += [(None, None, "en", "src0"), (5000, "", "en", None), (None, copied.text, "en", "src0"), (5001, " ".join(near), copied.lang, "src1"), rows[3], rows[3], (rows[5][0], f"{rows[6][1]} and more", rows[6][2], "src1"), (5002, LONG * 3, "de", "src2")]
    wide = "doc_id long, text string, lang string, source string, _row int, _tokens string, _h long, print long, text_key string, kept int, mix int"
    table = spark.createDataFrame([(*r, 1, "t", 2, 3, "k", 4, 5) for r in rows], wide)
    table.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    judged = quality.judge(table).select("doc_id", "kept").collect()
    docs = corpus_pipeline.quality_rules(spark, table, "")
    assert docs.columns == table.columns and docs.count() == sum(r.kept for r in judged)
    docs = docs.cache()
    model = language_id.train(docs)
    named = corpus_pipeline.language(spark, docs, "")
    langs, scores, rates = model.predict([r.text for r in docs.collect()])
    assert named.columns == table.columns and named.count() == sum(x != "und" and s >= 0.5 and b <= 6 for x, s, b in zip(langs, scores, rates, strict=True))
    kept = [tuple(r)[:4] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    keys = {i: t for i, t in enumerate(sorted({r[1] or "" for r in rows}))}
    head, near_pairs = linked_by_force(keys)
    of_text, classes = {t: head[i] for i, t in keys.items()}, {}
    for r in rows:
        classes.setdefault(of_text[r[1] or ""], []).append(r)
    assert near_pairs and len(kept) == len(classes) and len({of_text[r[1] or ""] for r in kept}) == len(classes)
    for r in kept:
        ids = [x[0] for x in classes[of_text[r[1] or ""]] if x[0] is not None]
        assert r in rows and r[0] == min(ids, default=None)
    mixed = corpus_pipeline.mixing_to_weights(spark, table, "")
    copies = mixing.mix(table.drop("mix"), (9, 10), mixing.WEIGHTS).agg(F.sum("mix.copies")).first()[0]
    assert mixed.columns == table.columns and mixed.count() == copies
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows} and all(r.n_tokens > 0 for r in out)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def linked_by_force(texts):
    """Smallest id of the class of each text: 5-word Jaccard of 0.8 or more, or fingerprints within 2 bits."""
    sets = {i: set(simhash.shingle_texts(t, 5)) for i, t in texts.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    ids, head = sorted(texts), {i: i for i in texts}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    near = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            jaccard = bool(x) and bool(y) and 5 * len(x) >= 4 * len(y) and 5 * len(y) >= 4 * len(x) and 5 * len(x & y) >= 4 * len(x | y)
            if jaccard or (prints[a] ^ prints[b]).bit_count() <= 2:
                near.append((a, b)) if jaccard and x != y else None
                low, high = sorted((find(a), find(b)))
                head[high] = low
    return {i: find(i) for i in ids}, near


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    head, near = linked_by_force({r.doc_id: r.text for r in docs.collect()})
    assert len(near) >= 12
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == head


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_crowds_of_near_copies(spark, monkeypatch, rounds):
    """Copies with some words changed, far enough from each other that many do not hold against any one of them."""
    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = {}
    for base in range(3):
        plain = rng.choice(words, 90).tolist()
        for _ in range(45):
            copy = [*plain, *rng.choice(words, 12)] if base == 2 and rng.random() < 0.5 else list(plain)
            for k in rng.integers(0, 90, rng.integers(0, 7)):
                copy[k] = str(rng.choice(words))
            texts[len(texts)] = " ".join(copy)
    for _ in range(40):
        texts[len(texts)] = " ".join([*rng.choice(words, 60), *words[:20]])
    head, near = linked_by_force(texts)
    found = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert len(near) > 100 and {r.doc_id: r.component_id for r in found.collect()} == head
