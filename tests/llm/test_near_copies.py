"""The Jaccard join, sentence spans and byte repeats against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rolecall.llm.jaccard_join import jaccard_components
from rolecall.llm.sentence_dedup import LONG, RUN, WORDS, remove_repeated_spans, sentences
from rolecall.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d, _ in sets}


def near_copies(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups=25, others=40):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 20, 80, 200])))
        texts += [near_copies(rng, base, rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randint(1, 6))]
    base = " ".join(rng.choices(vocabulary, k=150))
    texts += [near_copies(rng, base, rng.choice([0, 1, 2, 3, 4])) for _ in range(60)]
    texts += [" ".join([*rng.choices(vocabulary, k=rng.randint(1, 60)), shared, *rng.choices(vocabulary, k=20)]) for _ in range(others)]
    texts += ["", "  \t ", None, None, "one", "one", "One", "a b c d e", "a b c d e", "a b  c\nd E", texts[0].upper(), texts[5]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(corpus(seed))]
    got = jaccard_components(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    want = components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(shingles(t)), want[d]) for d, t in rows}
    assert len(got) == len(rows)


def test_missing_ids_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (2, text + " "), (None, text), (3, None), (3, "x"), (9, "x")]
    got = sorted(map(str, jaccard_components(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)).drop("n_shingles").collect()))
    assert got == sorted(f"Row(doc_id={d}, component_id={c})" for d, c in [(1, 1), (1, 1), (2, 1), (None, None), (3, 3), (3, 3), (9, 3)])
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def bytes_kept(rows, length):
    """doc_id order, then a hash of the text where ids repeat; rows equal in both are one."""
    seen, out = set(), {}
    for key, data in rows:
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(window)
        out[key] = covered
    return out


@pytest.mark.parametrize("length", [40, 100])
def test_byte_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    letters = "abcdé \n"
    passages = ["".join(rng.choices(letters, k=k)) for k in (length - 12, length, length + 1, 2 * length, 500)]
    texts = ["".join(rng.choice([rng.choice(passages), "".join(rng.choices(letters, k=rng.randint(1, 90)))]) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    texts += ["ab" * 200, "ab" * 300, "x" * 1000, "x" * 99, "x" * 100, None, "", texts[3], texts[4] + "q"]
    rows = list(enumerate(texts))
    want = bytes_kept([(d, (t or "").encode()) for d, t in rows], length)
    got = remove_repeats(spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id long, text string, spans string"), length).collect()
    assert len(got) == len(rows)
    for r in got:
        covered, data = want[r.doc_id], (texts[r.doc_id] or "").encode()
        assert bytes(r.kept) == bytes(b for b, c in zip(data, covered, strict=True) if not c)
        assert r.n_bytes == len(data)
        assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer(b"\1+", bytes(covered))]


def test_byte_repeats_of_rows_that_share_an_id(spark):
    text = "".join(random.Random(5).choices("abcdef", k=300))
    rows = [(4, text), (4, text), (None, text), (2, "short"), (2, "short"), (None, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in got) == [("2", 5, 5), ("2", 5, 5), ("4", 300, 300), ("4", 300, 300), ("None", 0, 0), ("None", 300, 0)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_longer_than_a_step_is_walked_whole(spark, monkeypatch):
    from rolecall.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "STEP", 1000)
    text = "".join(random.Random(6).choices("abcdefgh", k=5000))
    step = list(substring_dedup._sampled(100, 3)(iter([spark.createDataFrame([(1, 0, text)], "a long, b long, c string").toArrow().to_batches()[0]])))
    windows = sum(more + 1 for b in step for blob in b.column("c5").to_pylist() for more in blob)
    assert windows == 5000 - 99


def spans_kept(rows):
    seen, removed = set(), {}
    for key, text in rows:
        name, words, _, _, count = sentences([text.encode()])
        gone = set()
        for at in range(len(name)):
            end = at + RUN
            while end <= len(name) and words[at:end].sum() < WORDS:
                end += 1
            if end <= len(name):
                span = tuple(name[at:end])
                if span in seen:
                    gone |= set(range(at, end))
                seen.add(span)
        removed[key] = (len(name), len(gone))
    return removed


def test_sentence_spans_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 14))).capitalize() + rng.choice(".!?") for _ in range(7)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(150)]
    want = spans_kept(rows)
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in remove_repeated_spans(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")).collect()}
    assert got == want
    assert sum(n for _, n in want.values()) > 50


def test_repeated_passages_go_and_other_text_stays(spark):
    rng = random.Random(8)

    def prose(words):
        return " ".join(f"x{rng.randrange(10**9)}" + ("." if rng.random() < 0.15 else "") for _ in range(words))

    passage, single = prose(70) + ".", " ".join(f"y{rng.randrange(10**9)}" for _ in range(60)) + "."
    rows = [(i, "\n".join([prose(40) + ".", p, prose(30) + "."])) for i, p in enumerate([passage, passage, single, single, "z."])]
    got = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame([*rows, (9, None), (None, "")], "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[2].text == rows[2][1] and got[4].text == rows[4][1]
    assert passage not in got[1].text and got[1].text.startswith(rows[1][1].split("\n")[0])
    assert got[3].n_removed >= 3 and len(got[3].text) < len(rows[3][1]) - 300
    assert got[9].text == "" and got[None].n_sentences == 0
    assert len(sentences([("w " * (LONG * 4)).encode()])[0]) >= 1
    assert remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("stops", [(24, 48), (18, 36, 54), (17, 34), (25,), (), (3, 27, 51), range(1, 54, 4)], ids=str)
def test_any_fifty_shared_words_hold_a_span_wherever_they_stand(spark, stops):
    rng = random.Random(len(stops))
    word = lambda: f"x{rng.randrange(10**9)}"
    rows, shared = [], []
    for i in range(60):
        passage = [word() + ("." if k + 1 in stops else "") for k in range(50 + i % 5)]
        for k in range(2):  # i % 3: behind a sentence's end in both, in one, in neither; an unfinished tail
            head, tail = ([word() for _ in range(rng.randint(1, 40))] for _ in range(2))
            head[-1] += "." if i % 3 > k else ""
            rows.append((2 * i + k, " ".join([*head, *passage, *tail]) + "."))
        shared.append({w.strip(".") for w in passage})
    got = {r.doc_id: r.text for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, words in enumerate(shared):
        assert got[2 * i] == rows[2 * i][1]
        kept = [w.strip(".") for w in got[2 * i + 1].split()]
        own = [w.strip(".") for w in rows[2 * i + 1][1].split() if w.strip(".") not in words]
        assert [w for w in kept if w not in words] == own  # nothing else goes
        assert len(kept) - len(own) <= len(words) - WORDS  # a whole span at least has gone


def test_kept_digest_is_of_the_bytes_left(spark):
    got = remove_repeats(spark.createDataFrame([(1, "é" * 80)], "doc_id long, text string")).select(F.sha2("kept", 256).alias("h")).first()
    data = ("é" * 80).encode()
    covered = bytes_kept([(1, data)], 100)[1]
    assert got.h == hashlib.sha256(bytes(b for b, c in zip(data, covered, strict=True) if not c)).hexdigest()
