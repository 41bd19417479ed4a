"""Neighbour search, tool-call linking, scoring, packing and the pipeline."""

import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecall.llm import queries
from rolecall.llm.ann_search import Tree, chi_square_quantile, nearest_neighbours
from rolecall.llm.chat_format import argument_errors, call_levels, link_tool_calls
from rolecall.llm.lm_score import END, ORDER, SYMBOLS, Trie, _symbols, score_documents
from rolecall.llm.packing import END_ID, pack_binary, piece_lengths


def nearest(rows, every, k):
    out = {}
    for q, x in rows:
        if q % every == 0:
            found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), v) for v, y in rows if v != q)
            out[q] = found[:k]
    return out


def test_recall_against_brute_force(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {}
    for r in queries.op7_ann_search(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    vectors, ids = np.array([x for _, x in rows]), np.array([v for v, _ in rows])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        best = ids[np.lexsort((ids, distance))[:10]]
        hits += len(set(best.tolist()) & set(got[q]))
        total += 10
        assert sorted(r for r, _ in got[q].values()) == list(range(1, 11))
        for v, (_, score) in got[q].items():
            assert abs(score - distance[ids == v][0]) < 1e-12
    assert hits >= 0.95 * total


def test_small_tables_are_searched_exactly_with_ties_copies_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)] + [(40 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(30)]
    bad = [(200, None), (300, [0.0] * 6), (400, [float("nan")] * 6), (500, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (600, [float("inf")] * 6), (700, []), (800, [1.0, 2.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows + bad + rows[:3]], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in nearest_neighbours(frame, every=10, k=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = nearest(rows, 10, 5)
    assert {q: [v for _, v in x] for q, x in got.items()} == {q: [v for _, v in x] for q, x in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))
    assert nearest_neighbours(frame.limit(0)).count() == 0
    assert nearest_neighbours(frame.filter("vec_id = 10"), every=10).count() == 0
    assert len(nearest_neighbours(frame.filter("vec_id IN (10, 11, 12)"), every=10).collect()) == 2


def test_chi_square_quantile_and_tree():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    points = np.random.default_rng(1).standard_normal((3000, 4))
    tree = Tree(points, 30)
    leaf = tree.leaf(points)
    assert np.bincount(leaf).max() < 120
    for q in points[:20]:
        near = set(leaf[((points - q) ** 2).sum(axis=1) <= 0.8**2].tolist())
        assert near <= set(tree.reached(q, 0.8))
    assert set(Tree(np.ones((50, 2)), 8).leaf(np.ones((5, 2))).tolist()).__len__() == 1


SCHEMAS = {"add": {"x": {"type": "integer", "required": True, "minimum": 0}, "s": {"type": "string", "enum": ["a", "b"]}, "f": {"type": "number", "maximum": 2}}}


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("add", '{"x": 1}', ""), ("add", '{"x": -1, "s": "c", "f": 2.5}', "f: over 2, s: not allowed, x: under 0"), ("add", "{}", "x: missing"), ("add", '{"x": null}', "x: missing"),
        ("add", '{"x": "1"}', "x: not integer"), ("add", "[1]", "arguments are not an object"), ("add", "{", "arguments are not JSON"), ("add", None, "arguments are not JSON"),
        ("sub", "{}", "unknown tool"), (None, "{}", "unknown tool"), ("add", '{"x": 3, "f": 1, "s": "a", "more": true}', ""), ("add", '{"x": true}', "x: not integer"),
    ],
)
def test_argument_errors(spark, name, arguments, errors):
    frame = spark.createDataFrame([(name, arguments)], "name string, arguments string")
    assert frame.select(argument_errors(F.col("name"), F.col("arguments"), SCHEMAS)).first()[0] == errors


def test_levels_of_chains_and_circles(spark):
    rows = [("c", f"n{i}", f"n{i - 1}" if i else None) for i in range(37)] + [("c", "a", "b"), ("c", "b", "a"), ("c", "d", "a"), ("c", "e", "gone"), ("d", "n5", "n4")]
    got = {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in call_levels(spark.createDataFrame(rows, "conv_id string, call_id string, after string")).collect()}
    assert all(got["c", f"n{i}"] == (i, False) for i in range(37))
    assert [got["c", x] for x in "abde"] == [(None, True)] * 3 + [(0, False)]
    assert got["d", "n5"] == (0, False)


def test_linking(spark):
    calls = [
        (1, 0, "a", "add", '{ "x" : 1, "f":1}', None), (1, 2, "b", "add", '{"f": 1, "x": 2}', "a"), (1, 5, "a", "add", "{}", None), (1, 0, None, "add", "x", None),
        (2, 0, "a", "sub", "oops", "a"), (2, 0, "a", "sub", "oops", "a"), (None, 0, "a", "add", '{"x":1}', None),
    ]
    results = [(1, 1, "a", "one"), (1, 9, "a", "late"), (3, 1, "a", "lost"), (1, 1, None, "no id"), (1, 1, "a", "one")]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id, r.call_turn, r.result_turn): r for r in link_tool_calls(calls.withColumn("status", F.lit("x")), results, SCHEMAS).collect()}
    assert {k: (r.status, r.level, r.cyclic, r.copies) for k, r in got.items()} == {
        (1, "a", 0, 1): ("linked", 0, False, 1), (1, "b", 2, None): ("unanswered", 1, False, 1), (1, "a", 5, None): ("duplicate call", None, False, 1),
        (1, None, 0, None): ("unanswered", None, False, 1), (2, "a", 0, None): ("unanswered", None, True, 2), (None, "a", 0, None): ("unanswered", None, False, 1),
        (1, "a", None, 9): ("duplicate result", None, False, 1), (3, "a", None, 1): ("orphan", None, False, 1), (1, None, None, 1): ("orphan", None, False, 1),
    }
    assert got[1, "a", 0, 1].json == '{"arguments":{"f":1,"x":1},"call_id":"a","content":"one","conv_id":1,"name":"add","status":"linked"}'
    assert json.loads(got[2, "a", 0, None].json)["arguments"] == "oops"
    assert got[1, None, 0, None].errors == "arguments are not JSON"
    assert link_tool_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_chat_query_makes_no_python_plan(spark):
    plan = queries.op8_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def ppm(counts, text):
    """log10 probability by the definition: longest context first, escapes, exclusion."""
    total = 0.0
    symbols = [*text, END]
    for at, symbol in enumerate(symbols):
        context = tuple(([END] * ORDER + symbols)[at : at + ORDER])
        p, excluded, done = 1.0, set(), False
        for depth in range(ORDER, -1, -1):
            seen = {s: n for s, n in counts[depth].get(context[ORDER - depth :], {}).items() if s not in excluded}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if symbol in seen:
                p, done = p * seen[symbol] / whole, True
                break
            p *= len(seen) / whole
            excluded |= set(seen)
        if not done:
            p /= SYMBOLS - len(excluded)
        total += math.log10(p)
    return total


def test_scores_equal_the_definition(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcÉ \n", k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "zzz", "Abc abc", "ab ab ab"]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(texts)] + [(None, "abc", None), (2, texts[2], False)]
    got = score_documents(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, hold boolean, score double"), F.col("hold")).collect()
    train = [t or "" for _, t, h in rows if not h]

    def tokens(t):
        return ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + [None]

    words = Counter(w for t in train for w in tokens(t))
    n, v = sum(words.values()), len(words)
    counts = [{} for _ in range(ORDER + 1)]
    for t in train:
        symbols = [END] * ORDER + [*t.encode(), END]
        for at in range(ORDER, len(symbols)):
            for depth in range(ORDER + 1):
                counts[depth].setdefault(tuple(symbols[at - depth : at]), Counter())[symbols[at]] += 1
    key = {}
    for d, t, h in rows:
        toks = tokens(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in toks)
        key.setdefault(d, []).append((bool(h), len(toks), sum(words[w] > 0 for w in toks), base, ppm(counts, (t or "").encode())))
    assert len(got) == len(rows)
    for r in got:
        held, n_tokens, known, base, score = key[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-5)


def test_rare_words_meet_their_counts_in_a_join(spark, monkeypatch):
    from rolecall.llm import lm_score

    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(30)), i % 4 == 0) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hold boolean")
    want = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in score_documents(frame, F.col("hold")).collect()}
    monkeypatch.setattr(lm_score, "HEAD", 3)
    assert {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in score_documents(frame, F.col("hold")).collect()} == want


def test_deep_contexts_and_rare_grams_are_scored(spark, monkeypatch):
    from rolecall.llm import lm_score

    rows = [(i, t, False) for i, t in enumerate(["aqbcd1", "xqbcd2", "aqbcd1", "xqbcd2", "é"])] + [(10, "aqbcd1", True), (11, "aqbcd2", True), (12, "new \U0001f600 text", True), (13, None, True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hold boolean")
    want = {r.doc_id: r.score for r in score_documents(frame, F.col("hold")).collect()}
    assert want[10] > want[11] + 0.25  # only contexts of five bytes tell the two apart
    context, symbol, _ = _symbols([t.encode() for _, t, held in rows if not held])
    nodes, counts = np.unique(context * SYMBOLS + symbol, return_counts=True)
    trie = Trie(nodes, counts.astype(float))
    place = {c: i for i, c in enumerate(trie.contexts)}
    context, symbol, _ = _symbols([b"aqbcd1"])
    assert want[10] == pytest.approx(sum(trie.rows[place[int(c)], s] for c, s in zip(context, symbol, strict=True)), rel=1e-12)
    monkeypatch.setattr(lm_score, "HEAD_GRAMS", 3)
    monkeypatch.setattr(lm_score, "HELD_GRAMS", 4)
    got = {r.doc_id: r.score for r in score_documents(frame, F.col("hold")).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_scoring_without_training_rows(spark):
    frame = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, hold boolean")
    r = score_documents(frame, F.col("hold")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.base_score == pytest.approx(0) and r.score == pytest.approx(-4 * math.log10(SYMBOLS))
    assert score_documents(frame.limit(0), F.col("hold")).count() == 0


def test_a_context_s_probabilities_sum_to_one():
    context, symbol, _ = _symbols([b"abracadabra", b"abc", b""])
    nodes, counts = np.unique(context * SYMBOLS + symbol, return_counts=True)
    trie = Trie(nodes.astype(np.int64), counts.astype(float))
    assert np.allclose((10.0 ** trie.rows.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(3)
    texts = [None, "", " \n ", "Hello, World! it's 123", "naïve café İstanbul ΣΑΣ ﬁ 𝔘𝔫𝔦", "á éx ́y", "x y z\x1cw\x85v", "<|endoftext|>a <|startoftext|>", "日本語 テスト 한국어", "🙂🙃" * 9, "word " * 5000]
    texts += ["".join(chr(rng.choice([*range(32, 127), 10, 9, 0xE9, 0x301, 0x3B1, 0x1F600])) for _ in range(rng.randint(0, 300))) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (3, texts[3], 1)]
    got = pack_binary(spark.createDataFrame(rows, "doc_id long, text string, length int"), queries.tokenizer_path(), 256).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    whole = {}
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0 and len(r.ids) == 4 * r.length and 2**r.bucket == r.length
        whole.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, np.frombuffer(r.ids, "<u4").tolist())
    for i, t, _ in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID]
        pieces = whole[i, len(want)]
        assert sum((pieces[s] for s in sorted(pieces)), []) == want
        assert sorted(pieces) == np.cumsum([0, *[len(pieces[s]) for s in sorted(pieces)]])[:-1].tolist()


@pytest.mark.parametrize(("remembered", "kept"), [(400, 50), (60, 20)])
def test_the_word_table_is_bounded_and_changes_nothing(monkeypatch, remembered, kept):
    from tokenizers import Tokenizer

    from rolecall.llm import words

    monkeypatch.setattr(words, "REMEMBERED", remembered)
    monkeypatch.setattr(words, "KEPT", kept)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "é.", "A,", f"w{rng.randrange(400)}", "x" * rng.randint(1, 6) + "Ü"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    codec, tokenizer = words.WordCodec(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for at in range(0, 60, 5):
        ids, counts = codec.encode([t.encode() for t in texts[at : at + 5]])
        edges = np.cumsum([0, *counts])
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 5]]
        assert len(codec.keys) <= remembered


def test_piece_lengths():
    lengths, number = piece_lengths(np.array([1, 2048, 2047, 5000]), 2048)
    assert number.tolist() == [1, 1, 11, 2 + bin(5000 - 4096).count("1")]
    assert lengths.sum() == 1 + 2048 + 2047 + 5000
    with pytest.raises(ValueError):
        pack_binary(None, "x", 1000)


def test_packing_query_digest(spark):
    for r in queries.op10_packing(spark, "/root/testdata/sf0.001").limit(5).collect():
        assert 0 <= r.ids_crc32 < 2**32
    ids = pack_binary(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), queries.tokenizer_path()).withColumn("crc", F.crc32("ids")).first()
    assert ids.crc == zlib.crc32(bytes(ids.ids))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    english = [" ".join(rng.choices(["the", "of", "and", *[f"word{j}" for j in range(500)]], k=80)) for _ in range(30)]
    item = " ".join(rng.choices([f"bench{j}" for j in range(300)], k=30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(english)]
    rows += [(100, english[0], "en", "s", 1), (101, english[1].replace("the", "THE"), None, "s", 1), (102, "12345 !!", "en", "s", 8), (103, None, None, None, None)]
    rows += [(104, english[2] + " " + item + " " + english[3][:40], "en", "s", 2), (105, "my password = abcdefghijklmnop1 ok " + english[4][:90], "en", "s", 3), (None, "no id but words here", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {102, 103}
    kept = steps["jaccard_join"](spark, spark.createDataFrame(kept.collect(), docs.schema), str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d in {r[0] for r in rows} - {100, 101, 102, 103})
    kept = steps["decontamination"](spark, spark.createDataFrame(kept.collect(), docs.schema), str(tmp_path))
    assert kept.filter("doc_id = 104").count() == 0 and kept.count() == 32
    kept = steps["secret_scan"](spark, spark.createDataFrame(kept.collect(), docs.schema), str(tmp_path))
    found = kept.filter("doc_id = 105").first()
    assert found.text.startswith("my [assign] ok ") and found.n_chars == len(found.text) and kept.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 32


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_full_leaves_are_searched_in_parts(spark, monkeypatch):
    from rolecall.llm import ann_search

    monkeypatch.setattr(ann_search, "LEAF", 4)
    monkeypatch.setattr(ann_search, "SAMPLE", 40)
    monkeypatch.setattr(ann_search, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = nearest(rows, 20, 4)
    hits = sum(len(set(got[q]) & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(x) == 4 for x in got.values())
