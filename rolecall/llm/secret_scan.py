"""Secret scans through a trigram index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query. The index holds a
posting (document, trigram) for every mandatory trigram that a text contains;
postings are intersected per document, and only candidates are verified with
the regular expression. A rule without mandatory trigrams reads every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import staged
from rolecall.llm.trigrams import trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: A cheaper pattern that every text with a kept match contains.
    probe: str | None = None


# The three base kinds, then formats published by the issuers of the keys.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, probe=r"[0-9a-f]{16}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def _holds(query, held: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_holds(p, held) for p in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, end, rank, kind>> of the rule's kept matches, ends exclusive, in code points.

    The pieces between matches and the matches alternate, so running lengths give the places.
    """
    lengths = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.arrays_zip(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["whole"]).alias("size"), F.length(m["part"]).alias("part")),
    )
    empty = F.expr("cast(array() AS array<struct<start: int, end: int, rank: int, kind: string>>)")
    walked = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.coalesce(m["size"], F.lit(0))).alias("at"),
            F.when(
                m["part"] >= rule.least,
                F.concat(acc["found"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["size"]).alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind")))),
            ).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(rule.probe or rule.pattern), walked).otherwise(empty)


def candidate_rules(documents: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): of each document that some trigram query lets through, the kinds it may hold."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*(trigrams_of(q) for q in queries.values())))
    folded = F.lower("text")
    postings = documents.select("doc_id", F.explode(F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(folded, g))).alias("gram"))
    held = postings.groupBy("doc_id").agg(F.collect_set("gram").alias("held"))
    kinds = [F.when(_holds(q, F.col("held")), F.lit(k)) for k, q in queries.items() if q is not True]
    return held.select("doc_id", F.array_compact(F.array(*kinds)).alias("rules")).filter(F.size("rules") > 0)


def scan_secrets(documents: DataFrame, rules=RULES, broadcast_rows: int = 200_000) -> DataFrame:
    """The documents' rows with `spans`: array<struct<start, end, rank, kind>> by start, then rule order.

    Reads doc_id and text; every column is kept (a column named spans is replaced).
    A null text is empty. Rows that share a doc_id, or have none, share candidates
    and are verified each on its own text. At most `broadcast_rows` candidates are
    broadcast, more are joined by a shuffle.
    """
    rows = documents.drop("spans")
    keys = rows.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    wanted = staged(candidate_rules(keys, rules), "candidates").select(F.col("doc_id").alias("_doc"), F.col("rules").alias("_rules"))
    if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rule, rank)
        if trigram_query(rule.pattern) is not True:
            spans = F.when(F.array_contains("_rules", rule.kind), spans)
        found.append(F.coalesce(spans, F.expr("cast(array() AS array<struct<start: int, end: int, rank: int, kind: string>>)")))
    matched = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return matched.withColumn("spans", F.array_sort(F.concat(*found))).drop("_doc", "_rules")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch of touching or overlapping spans replaced by its first kind in brackets."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] < acc["at"],
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")),
        ).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)
