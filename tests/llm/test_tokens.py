"""Byte-level BPE, the Merkle manifest and the token alignment, each beside a plain version of its definition."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolecall.llm import chunks, queries, token_alignment
from rolecall.llm.byte_bpe import ByteBpe, decode_bytes, encode_bytes, read_ranks
from rolecall.llm.merkle import merkle_manifest
from rolecall.llm.token_alignment import rate_links, token_pairs

SF_DIR = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ALPHABET = [
    "a", "b", "e", " ", "  ", "\n", "\t", "é", "à", "日", "本", "1", "23", "'s", "'", "!", "...", "the", "ing", "\x00", "▁", "<|endoftext|>", "</s>", "<0x41>",
    "qx", "A", "ab" * 40, "a" * 200, "\xa0", " ", "　", "!" * 90, " " * 130, "xqzjk" * 30, "🙂", "\x1c", "à la", " fox",
]


def wild_texts(n, seed, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def documents(spark, sf_dir=SF_DIR):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Byte-level BPE


def test_words_of_all_kinds_encode_as_the_library_does(encoding):
    rng = random.Random(5)
    long = ["a" * 5_000, "ab" * 3_000, "".join(rng.choices("abcdeinrst", k=1_500)), "".join(rng.choices("abAZqxjkzé日本", k=4_000)), "!?" * 900 + " " * 999]
    texts = [*wild_texts(500, 1), *long, ""]
    bpe = ByteBpe(RANKS, public_tokenizers.PATTERN)
    ids, counts = bpe.encode([t.encode() for t in texts])
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [encoding.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids, counts).to_pylist() == [t.encode() for t in texts]


def test_pieces_of_every_code_point_fall_where_the_library_cuts_them(encoding):
    texts = [f"x{chr(c)} y {chr(c)}{chr(c)} z{chr(c)}1{chr(c)} {chr(c)}" for c in [*range(0x3100), *range(0xFE00, 0x10000)] if not 0xD800 <= c < 0xE000]
    ids, counts = ByteBpe(RANKS, public_tokenizers.PATTERN).encode([t.encode() for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [encoding.encode_ordinary(t) for t in texts]


def test_rare_chunks_that_leave_the_table_change_nothing(encoding, monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 60)
    monkeypatch.setattr(chunks.KeyedLists.trim, "__defaults__", (20,))
    monkeypatch.setattr(chunks, "KEPT", 20)
    bpe = ByteBpe(RANKS, public_tokenizers.PATTERN)
    for seed in range(12):
        texts = wild_texts(6, seed)
        ids, counts = bpe.encode([t.encode() for t in texts])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [encoding.encode_ordinary(t) for t in texts]
    assert len(bpe.chunks.keys) < 400


def test_query_equals_the_library_and_decodes_to_the_text(spark, encoding):
    texts = {r.doc_id: r.text or "" for r in documents(spark).select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_bpe(spark, SF_DIR).collect()}
    want = {}
    for doc, text in texts.items():
        ids = encoding.encode_ordinary(text)
        want[doc] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    assert got == want


def test_odd_rows_long_texts_and_empty_tables(spark, encoding):
    long = " ".join(random.Random(2).choices(wild_texts(300, 9), k=20_000))
    rows = [(1, None, 5), (2, "", 5), (None, "no id here", 5), (3, "twice", 5), (3, "twice", 5), (4, long, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(2)
    of = RANKS, public_tokenizers.PATTERN
    found = decode_bytes(encode_bytes(frame, *of), *of).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found) == Counter((d, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for d, t, _ in rows)
    assert decode_bytes(encode_bytes(frame.limit(0), *of), *of).count() == 0
    ids = spark.createDataFrame([(1, [0, 1]), (2, [99_999]), (3, None), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in decode_bytes(ids, *of).collect()} == {1: b"!\"", 2: None, 3: b"", 4: b""}


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path_of(levels, place):
    for level in levels[:-1]:
        start = place // 16 * 16
        run = level[start : start + 16]
        yield run[: place - start], run[place - start + 1 :]
        place //= 16


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text) as (doc_id, leaf, subroot, root, proof, folded, verified)."""
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(row, text):
        return digest(*map(field, (*row[:4], text)))

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = tree_of([leaf(r, r[4]) for r in groups[name]])
    top = tree_of([trees[n][-1][0] for n in names])
    found = []
    for k, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            path = [*path_of(trees[name], i), *path_of(top, k)]
            node = leaf(row, text)
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(s for left, right in path for s in (*left, *right)))
            found.append((row[0], leaf(row, row[4]), trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return found


def manifest(frame, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle_manifest(frame, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", tampered, {"text": lowered}, **options)


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_equals_its_definition(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_merkle_manifest(spark, SF_DIR).collect()) == Counter(plain_manifest(rows))


@pytest.mark.parametrize("levels", [1, 2])
def test_many_passes_hot_groups_and_odd_rows(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["hot", "hot", "é", "z", None, ""]), "en", i, f"Text {i} Ä") for i in range(1_200)]
    rows += [(5_000 + i, f"single{i}", None, None, "A lone LEAF") for i in range(40)] + [(None, "hot", "en", 3, "No Id")] * 3 + [(7, "hot", "en", None, None)] + [(8, "z", "de", 8, "Same")] * 20
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, branch string").repartition(7)
    found = manifest(frame, levels=levels, siblings=True).collect()
    assert Counter(tuple(r[c] for c in RESULT) for r in found) == Counter(plain_manifest(rows))
    for r in found[::37]:
        assert digest(*(s.left + s.right for s in r.siblings)) == r.proof_sha256
        node = r.leaf
        for s in r.siblings:
            node = digest(s.left, node, s.right)
        assert node == r.root


def test_manifest_of_one_row_and_of_none(spark):
    frame = spark.createDataFrame([(1, None, None, None, "Only")], "doc_id long, source string, lang string, n_chars long, text string")
    [row] = manifest(frame).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("") and row.verified == (zlib.crc32(b"1") % 5 != 0)
    assert manifest(frame.limit(0)).count() == 0


def test_a_very_long_text_is_one_leaf(spark):
    rows = [(1, "a", "en", 1, "Word " * 400_000), (2, "a", "en", 1, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(tuple(r[c] for c in RESULT) for r in manifest(frame).collect()) == Counter(plain_manifest(rows))


# Token alignment


def plain_bytes():
    byte, spare = {}, 0
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 173 or 174 <= b:
            byte[chr(b)] = b
        else:
            byte[chr(256 + spare)], spare = b, spare + 1
    return byte


def plain_alignment(rows):
    """(doc_id, result columns) of every row, and the counts of all pairs; whole texts, encoded at once."""
    a, b, byte = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH), plain_bytes()
    a.encode_special_tokens = True

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    counts, made = Counter(), []
    for doc, text in rows:
        ours, theirs = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelled = [[bytes(byte[c] for c in a.id_to_token(i)) for i in ours], [of_b(i) for i in theirs]]
        if text and any(b"".join(s) != (" " + text).encode() for s in spelled):
            ours, theirs, spelled = [], [], [[], []]
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        groups, both = [([], [])], set(ends[0]) & set(ends[1])
        at = {e: n for n, e in enumerate(sorted(both))}
        groups = [([], []) for _ in both]
        for side, ids in enumerate((ours, theirs)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[at[min(x for x in both if x >= e)] if e not in at else at[e]][side].append(i)
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        made.append((doc, len(ours), len(theirs), links, hashlib.sha256(text_of.encode()).hexdigest() if ours else ""))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(doc, n_a, n_b, len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for doc, n_a, n_b, links, sha in made], counts


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(frame):
    return Counter(tuple(r[c] for c in ALIGNED) for r in rate_links(frame, A_PATH, B_PATH).collect())


@pytest.mark.parametrize("head", [1_000_000, 15])
def test_alignment_equals_its_definition_on_wild_texts(spark, monkeypatch, head):
    monkeypatch.setattr(token_alignment, "HEAD", head)
    texts = wild_texts(150, 4, [x for x in ALPHABET if x != "▁"])
    rows = [*enumerate(texts), (900, "x▁y z"), (901, None), (902, " "), (903, "foo "), (904, ""), (905, "a" * 3_000), (None, "no id"), (906, "twice or more"), (906, "twice or more")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pair long").repartition(3)
    want, counts = plain_alignment(rows)
    assert aligned(frame) == Counter(want)
    assert {(r.a_id, r.b_id): r.n for r in token_pairs(frame, A_PATH, B_PATH).collect()} == dict(counts)


def test_alignment_query_equals_its_definition(spark):
    docs = documents(spark).select("doc_id", "text").filter("doc_id % 4 = 0")
    assert aligned(docs) == Counter(plain_alignment([tuple(r) for r in docs.collect()])[0])
    assert queries.op13_token_alignment(spark, SF_DIR).count() == documents(spark).count()


def test_alignment_of_a_long_text_and_of_no_rows(spark):
    rows = [(1, " ".join(wild_texts(900, 8, ["the ", "ing", "foxes", " ", "é", "12", "!\n", "Ångström", "日本"])))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert aligned(frame) == Counter(plain_alignment(rows)[0])
    assert rate_links(frame.limit(0), A_PATH, B_PATH).count() == 0
