"""Secret scan and its trigram queries, decontamination and language identification."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolecall.llm import queries
from rolecall.llm.decontamination import ANSWERED, BITS, COMMON, COPIED, PARAPHRASED, STEP, TELLING, common_subsequence, find_leaks, words_of
from rolecall.llm.language_id import families, fit_languages, identify_languages
from rolecall.llm.secret_scan import RULES, candidate_rules, redacted, scan_secrets
from rolecall.llm.trigrams import trigram_query


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(holds(p, text) for p in query[1])


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_the_trigram_query(rule):
    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(rule.pattern, fullmatch=True))
    def check(text):
        assert holds(trigram_query(rule.pattern), text.lower())

    check()


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("abcd", ["xabcdx"], ["abc", "bcd"]),
        ("ab(c|d)ef", ["abcef", "abdef"], ["abxef"]),
        ("(foo|bar)+baz", ["foobaz", "barfoobaz"], ["foo", "baz"]),
        ("abc[0-9]*def", ["abc12def", "abcdef"], ["abc", "def"]),
        ("a?bcd", ["bcd"], ["abc"]),
        ("(abc)?", ["", "x"], []),
        ("(ab|xyz)", ["ab"], []),
        ("x{2,}yz", ["xxyz"], ["yzz"]),
    ],
)
def test_trigram_queries(pattern, yes, no):
    query = trigram_query(pattern)
    assert all(holds(query, t) for t in yes)
    assert not any(holds(query, t) for t in no) or query is True


def spans_of(text):
    found = []
    for rank, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or "", re.A):  # letters of either case are ASCII letters
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


SECRETS = [
    "password: token: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "PASSWD = 'aaaa_bbbb_cccc' api_key:\"0123456789abcdef01\"", "ſecret=abcdefghijklmnop",
    "é😀 Api_Key= ABCDEFGHIJKL é AKIA" + "B" * 14 + " AKIA" + "C" * 13, "akia" + "b" * 20, "AKIAAKIA" + "9" * 12 + "x", "0123456789abcde f0123456789abcdef0", "deadbeef" * 40,
    "ghp_" + "a" * 36, "xoxb-1234567890-abc", "AIza" + "b" * 35, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".ccccc", "-----BEGIN RSA PRIVATE KEY-----", "secret\t=abcdefghijklmnop",
    "apikey:" + "a=" * 40, "token:abcdefghijkl", "token:abcdefghijk", "", None, " ", "password=abcdefghijkl" * 3, "\n".join(["secret = abcdefghijklm"] * 30),
]


def test_spans_equal_python(spark):
    rng = random.Random(1)
    texts = SECRETS + [" ".join(rng.choices([t for t in SECRETS if t], k=rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, SECRETS[0], "x"), (None, SECRETS[5], "x"), (3, SECRETS[1], "x"), (3, SECRETS[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = scan_secrets(docs).selectExpr("doc_id", "text", "transform(spans, s -> concat_ws(':', s.kind, cast(s.start AS string), cast(s.end AS string))) AS spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.spans == spans_of(r.text), r.text
    wide = scan_secrets(docs, broadcast_rows=2).groupBy().agg(F.sum(F.size("spans"))).first()[0]
    assert wide == sum(len(r.spans) for r in got)
    assert scan_secrets(docs.limit(0)).count() == 0


def test_candidates_come_from_the_index(spark):
    docs = spark.createDataFrame(list(enumerate(["a password here", "pass the word", "AKIA", "no", None])), "doc_id long, text string")
    assert {(r.doc_id, tuple(r.rules)) for r in candidate_rules(docs).collect()} == {(0, ("assign",)), (2, ("access",))}


def test_redaction(spark):
    rows = [(1, "a token=" + "abcdef0123456789" * 2 + " é AKIA" + "Z" * 16 + "!"), (2, "clean"), (3, None)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("text")).collect()
    assert dict(map(tuple, got)) == {1: "a [assign] é [access]!", 2: "clean", 3: None}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, SECRETS[2]), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, str(tmp_path)).collect()}
    base = ",".join(s for s in spans_of(SECRETS[2]) if s.split(":")[0] in ("assign", "access", "hex"))
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (got[1].n_assign, got[2].n_assign, got[2].spans) == (2, 0, "")


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("size", [1, 5, 62, 63, 64, 130, 200])
def test_common_subsequence_equals_dynamic_programming(size):
    rng = np.random.default_rng(size)
    item = rng.integers(1, 12, size).astype(np.uint64)
    texts = rng.integers(0, 15, (20, 90)).astype(np.uint64)
    assert common_subsequence(item, texts).tolist() == [subsequence(item.tolist(), t.tolist()) for t in texts]


def test_words_are_split_at_punctuation():
    words, counts = words_of([b"The, END... of", b"", b" -- ", "é a".encode(), b"the end"])
    assert counts.tolist() == [3, 0, 0, 2, 2]
    assert words[:2].tolist() == words[-2:].tolist()


def prose(rng, words):
    return " ".join(rng.choice(["the", "of", f"w{rng.randrange(3000)}", f"w{rng.randrange(3000)}", f"w{rng.randrange(3000)}"]) for _ in range(words))


def test_leaks_and_paraphrases_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(15, 58)) + ". " + prose(rng, 5) + ".") for i in range(30)]
    items += [(100, prose(rng, 150) + "."), (101, None), (102, ""), (103, "?!"), (None, "a b c")]
    docs, want = [], set()
    for d in range(400):
        parts = [prose(rng, rng.randint(0, 80)), prose(rng, rng.randint(0, 300))]
        if d % 8 == 0:
            i, text = items[rng.randrange(31)]
            words = text.split()
            if d % 16 == 0:  # a paraphrase: some words differ, the answer stays
                for _ in range(len(words) // 6):
                    words[rng.randrange(len(words) - 6)] = f"p{rng.randrange(10**6)}"
            parts.insert(1, " ".join(words).upper() if d % 24 == 0 else " ".join(words))
            want.add((d, i))
        docs.append((d, " ".join(parts), 0.5))
    docs += [(900, None, 0.1), (901, "", 0.1), (902, "the", 0.2), (None, items[0][1], 0.1), (None, "other", 0.1), (1, docs[1][1], 0.5)]
    want.add((None, 0))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, lcs_share double"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want
    assert len(found) >= 0.95 * len(want)
    assert len(got) == len(found)


def leaks_by_brute_force(docs, pairs):
    """Every passage's surroundings held against the item, for pairs of a document and (item, text)."""
    words = {d: words_of([t.encode()])[0] for d, t in docs}
    steps = [np.unique(w[a : a + STEP] >> (32 - BITS)) for w in words.values() for a in range(0, len(w), STEP)]
    common = np.bincount(np.concatenate(steps), minlength=1 << BITS) > COMMON * len(steps)
    found = {}
    for d, (i, text) in pairs:
        whole, answer = (words_of([x.encode()])[0] for x in (text, re.split(r"(?<=[.!?])\s+", text.strip())[-1]))
        told = lambda w: w[~common[w >> (32 - BITS)]]
        pick = told if len(told(whole)) >= TELLING else lambda w: w
        reach, w = len(whole) + STEP, words[d]
        around = [pick(w[max(0, a - reach) : a + 2 * STEP + reach]) for a in range(0, max(1, -(-len(w) // STEP) - 1) * STEP, STEP)]
        rows = np.array([np.pad(x, (0, 2 * reach + 2 * STEP - len(x))) for x in around])
        share = common_subsequence(pick(whole), rows) / len(pick(whole))
        kept = common_subsequence(pick(answer), rows) / len(pick(answer)) if len(pick(answer)) else np.zeros(len(rows))
        leak = (share >= COPIED) | ((share >= PARAPHRASED) & (kept >= ANSWERED))
        if leak.any():
            found[d, i] = round(share[leak].max(), 9)
    return found


def test_planted_items_are_found_wherever_the_subsequence_is_long_enough(spark):
    rng = random.Random(12)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL").orderBy("doc_id").select("text").collect()
    docs = [(d, r.text) for d, r in enumerate(rows)]
    pool = sorted(spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect())
    items = [(i, " ".join(r.text.split()[-5 - i % 11 :] if i % 2 else r.text.split())) for i, r in enumerate(pool)]
    pairs = []
    for i, text in items:
        words = text.split()
        tail = len(re.split(r"(?<=[.!?])\s+", text)[-1].split())  # the answer stays
        for share in (0.6, 0.8, 1.0):
            copy = list(words)
            for k in rng.sample(range(len(words) - tail), min(len(words) - tail, int((1 - share) * len(words)))):
                copy[k] = f"p{rng.randrange(10**6)}"
            host = rng.choice(docs[: len(rows)])[1].split()[:80]
            at = rng.randrange(len(host) + 1)
            pairs.append((len(docs), (i, text)))
            docs.append((len(docs), " ".join([*host[:at], *copy, *host[at:]])))
    want = leaks_by_brute_force(docs, pairs)
    leaks = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): round(r.lcs_share, 9) for r in leaks}
    assert len(want) > 400
    assert {k: got.get(k) for k in want} == want


def test_a_paraphrase_is_found_by_an_answer_of_common_words(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"u{i}x{k}" for k in range(20)) + ". " + ("The of the in of." if i % 2 else "The " + f"v{i}.")) for i in range(20)]
    docs = [(1000 + d, prose(rng, 60) + " in" * 20) for d in range(100)]
    for i, text in items:
        words, answer = text.split()[:20], text.split()[20:]
        words[3:9] = [f"p{i}x{k}" for k in range(6)]
        docs += [(i, " ".join([*words, *answer])), (100 + i, " ".join([*words, "no", "such"]))]  # with the answer, and without
    docs = [(d, " ".join(["in", t, *["in the of"] * 2])) if d >= 1000 else (d, t) for d, t in docs]
    got = {(r.doc_id, r.item_id): r.answer_share for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i): 1.0 for i, _ in items}


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b c")]), ([(1, "a b c")], []), ([(1, None)], [(1, "a")]), ([(1, "a b")], [(1, None)])])
def test_leaks_of_empty_tables(spark, docs, items):
    assert find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_families_join_the_most_alike():
    means = np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0.1], [0, 0.9, 0]])
    assert sorted(families(means, 2)) == [[0, 1], [2, 3]]


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "le chat est la", "fr", 0.5), (2, "der hund ist da", "de", 0.5), (3, None, "de", 0.5), (4, "12 34 !?", None, 0.5), (5, "la", None, 0.5), (None, "der " * 20000, None, 0.5), (5, "la", None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = identify_languages(docs, fit_languages(docs)).collect()
    assert [r.lang_pred for r in got] == ["fr", "de", "und", "und", "fr", "de", "fr"]
    assert [r.score for r in got][2:4] == [0.0, 0.0]
    none = docs.filter("lang = 'xx'")
    assert fit_languages(none) is None
    assert {r.lang_pred for r in identify_languages(docs, None).collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in identify_languages(docs.filter("doc_id = 1"), fit_languages(docs.filter("doc_id = 1"))).collect()} == {("fr", 1.0)}
    assert identify_languages(docs.limit(0), fit_languages(docs)).count() == 0
