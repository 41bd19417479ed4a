"""Language identification in two steps: the family first, then the language within it.

Texts are profiles of hashed byte trigrams. Languages whose mean profiles are most
alike form families (average linkage, about as many families as the root of the
number of languages). One linear support vector machine for each pair of families,
and for each pair of languages of a family, votes by its margins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import small_batches, text_values

#: Hashed features.
FEATURES = 2048
#: Labelled rows each language's machines are fitted on, at most; chosen by a hash of doc_id.
PER_LANGUAGE = 600
#: Passes over the sample and strength of the machines' margin term.
PASSES, PENALTY = 30, 1e-4
#: Texts whose profiles are held at once.
ROWS = 512
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def _profiles(texts: list[str]) -> np.ndarray:
    """Unit vectors of damped trigram counts of whole texts; case and blanks' kind do not matter."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", np.uint8).astype(np.uint32)
        if len(data) < 3:
            continue
        grams = (data[:-2] * np.uint32(0x01000193) ^ data[1:-1]) * np.uint32(0x01000193) ^ data[2:]
        out[i] = np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    np.sqrt(out, out=out)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def families(means: np.ndarray, wanted: int) -> list[list[int]]:
    """Average-linkage groups of rows by inner product, until `wanted` are left."""
    alike = means @ means.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > wanted:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine (last weight: bias) by averaged subgradient steps over shuffled rows."""
    rng = np.random.default_rng(0)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight, mean, steps = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for turn in range(PASSES):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            steps += 1
            rate = 1 / (PENALTY * (steps + 1 / PENALTY))
            wrong = y[part] * (x[part] @ weight) < 1
            weight *= 1 - rate * PENALTY
            weight += rate * (x[part][wrong] * (y[part] * share[part])[wrong, None]).sum(axis=0) / len(part)
            if turn >= PASSES // 2:
                mean += weight
    return (mean / max(1, steps - steps * (PASSES // 2) // PASSES)).astype(np.float32)


def _pairs(x: np.ndarray, label: np.ndarray, classes: list) -> dict[tuple[int, int], np.ndarray]:
    out = {}
    for a, b in combinations(range(len(classes)), 2):
        use = np.isin(label, [a, b])
        out[a, b] = fit_machine(x[use], np.where(label[use] == a, 1.0, -1.0))
    return out


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, label: np.ndarray):
        self.languages = languages
        means = np.stack([x[label == i].mean(axis=0) for i in range(len(languages))])
        means = means - means.mean(axis=0) if len(languages) > 2 else means
        self.families = families(means, max(1, round(math.sqrt(len(languages)))))
        of = np.zeros(len(languages), np.int64)
        for f, members in enumerate(self.families):
            of[members] = f
        self.between = _pairs(x, of[label], self.families)
        self.within = [_pairs(x[np.isin(label, m)], np.searchsorted(m, label[np.isin(label, m)]), m) for m in self.families]

    @staticmethod
    def _vote(x: np.ndarray, machines: dict, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """(class, score): the class whose weakest pairwise probability is the largest, and that probability."""
        weakest = np.ones((len(x), classes))
        for (a, b), weight in machines.items():
            p = 1 / (1 + np.exp(-4 * np.clip(x @ weight[:-1] + weight[-1], -8, 8)))
            weakest[:, a] = np.minimum(weakest[:, a], p)
            weakest[:, b] = np.minimum(weakest[:, b], 1 - p)
        best = weakest.argmax(axis=1)
        return best, weakest[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self._vote(x, self.between, len(self.families))
        language = np.zeros(len(x), np.int64)
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if len(at):
                inner, p = self._vote(x[at], self.within[f], len(members))
                language[at] = np.array(members)[inner]
                sure[at] *= p
        return language, sure


def fit_languages(labelled: DataFrame) -> Model | None:
    """A model from (doc_id, text, lang) rows; null languages, and texts without letters, teach nothing."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.length("text")).alias("_order"))
    rows = rows.filter("lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    pick = Window.partitionBy("lang").orderBy("_order", "text")
    sample = rows.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= PER_LANGUAGE).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _profiles(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    found = sample.mapInArrow(features, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if not len(found):
        return None
    languages, label = np.unique(found["lang"].to_numpy(str), return_inverse=True)
    return Model(languages.tolist(), np.stack([np.frombuffer(x, np.float32) for x in found["x"]]), label)


def identify_languages(documents: DataFrame, model: Model | None) -> DataFrame:
    """`documents` with lang_pred and score (0 to 1); columns of these names are replaced.

    Reads the whole text and nothing else. A text that is null or has no letter, and
    any text if there is no model, is `und` with score 0. A lone learned language is
    certain. Repeated rows get equal answers.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    rows = documents.select(*columns)
    at = [c.lower() for c in columns].index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [t.decode() for t in text_values(part.column(at))]
                known = np.array([bool(_LETTER.search(t)) for t in texts], bool) & (model is not None)
                lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if known.any():
                    best, sure = model.predict(_profiles([t for t, k in zip(texts, known, strict=True) if k]))
                    lang[known] = np.array(model.languages, object)[best]
                    score[known] = sure
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(predict, f"{fields}, lang_pred string, score double")
