"""Search-box suggestions: the vocabulary of active listings, and completing terms against it.

Terms are completed in bulk. Every way a term can match needs each of its words
to start a word of the name, so names are indexed by the beginnings of their
words and a term is looked up by its longest word: an equi-join, with the finer
tests on what it finds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.functions.text import constant, normalize_text, squeeze
from rolecall.functions.vocabulary import CITY_ALIASES, CITY_NAMES, PLACE_WORDS, REMOTE_ALIASES, SUGGEST_TITLE_WORDS
from rolecall.operators.filters import is_active

LIMIT = 8
# At most this many of a kind in one list; the others are bounded by LIMIT.
KIND_CAP = {"company": 3, "skill": 3}
KIND_ORDER = {"company": 0, "city": 0, "remote": 1, "title": 1, "skill": 2}

_SEPARATOR = r"(?:\s+[-–—|/]\s+|\s*,\s*)"
_PLACE = r"\b(?:" + "|".join(re.sub(r"[-\s]", r"[-\\s]?", w.lower()) for w in PLACE_WORDS) + r")\b"
# A title up to the first separator whose next part names a place.
_BEFORE_PLACE = rf"(?i)^(.*?){_SEPARATOR}(?:(?!{_SEPARATOR}).)*?{_PLACE}.*$"


def clean_title(title: Column) -> Column:
    """A title as suggested: bracketed notes dropped, a trailing place cut off."""
    text = F.trim(squeeze(F.regexp_replace(title, r"\s*[(\[{][^)\]}]*[)\]}]\s*", " ")))
    kept = F.regexp_replace(text, _BEFORE_PLACE, "$1")
    return F.regexp_replace(kept, r"[\s,\-–—|/:]+$", "")


def _spell_out(key: Column) -> Column:
    full = constant(SUGGEST_TITLE_WORDS, "map<string,string>")
    bare = F.transform(F.split(key, " "), lambda w: F.regexp_replace(w, r"\.$", ""))
    return F.array_join(F.transform(bare, lambda w: F.coalesce(full[w], w)), " ")


def suggest_title_key(title: Column) -> Column:
    """The key titles merge on: normalised, abbreviations spelled out."""
    return _spell_out(normalize_text(clean_title(title)))


def _merge_spellings(named: DataFrame) -> DataFrame:
    """kind, key, label, count from (kind, key, spelling): all uses counted, shown as spelled most often."""
    spelled = named.filter(F.length("key") > 0).groupBy("kind", "key", "spelling").agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy("kind", "key").agg(
        F.min_by("spelling", F.struct((-F.col("n")).alias("n"), F.lower("spelling").alias("l"), "spelling")).alias("label"),
        F.sum("n").alias("count"),
    )


def keyword_vocabulary(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """kind, label, key, count, slug of titles, companies and skills; a key belongs to the
    company of that name, else to the title, else to the skill."""
    active = jobs.filter(is_active())
    titles = active.select(
        F.lit("title").alias("kind"), suggest_title_key(F.col("title")).alias("key"), clean_title(F.col("title")).alias("spelling")
    )
    skills = active.select(F.explode(F.array_distinct("tags")).alias("tag")).select(
        F.lit("skill").alias("kind"), normalize_text(F.col("tag")).alias("key"), F.trim("tag").alias("spelling")
    )
    words = _merge_spellings(titles.unionByName(skills)).withColumn("slug", F.lit(None).cast("string"))
    roles = active.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    firms = (
        companies.join(roles, "id")
        .select(F.lit("company").alias("kind"), normalize_text(F.col("name")).alias("key"), F.col("name").alias("label"), "count", "slug")
        .filter(F.length("key") > 0)
    )
    order = constant(KIND_ORDER, "map<string,int>")
    return (
        words.unionByName(firms)
        .groupBy("key")
        .agg(F.min_by(F.struct("kind", "label", "count", "slug"), F.struct(order[F.col("kind")].alias("o"), "slug")).alias("e"))
        .select("e.kind", "e.label", "key", "e.count", "e.slug")
    )


def place_vocabulary(jobs: DataFrame, cities: list[str] = CITY_NAMES) -> DataFrame:
    """kind, label, key, count, alt of the cities active roles are in, and of remote work.

    At most one row per listed city, so the table stays as small as the list.
    """
    active = jobs.filter(is_active())
    listed = constant(cities, "array<string>")
    named = F.concat(
        F.filter(listed, lambda c: F.contains(F.col("location"), c)),
        F.when(F.col("remote") == "REMOTE", F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>")),
    )
    counted = active.select(F.explode(named).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    aliases = constant({**CITY_ALIASES, "Remote": REMOTE_ALIASES}, "map<string,array<string>>")
    key = normalize_text(F.col("label"))
    alt = F.filter(
        F.transform(
            F.coalesce(aliases[F.col("label")], F.array().cast("array<string>")),
            lambda a: F.struct(normalize_text(a).alias("key"), a.alias("name")),
        ),
        lambda a: a["key"] != key,
    )
    kind = F.when(F.col("label") == "Remote", "remote").otherwise("city")
    return counted.select(kind.alias("kind"), "label", key.alias("key"), "count", alt.alias("alt"))


def match_tier(key: Column, term: Column) -> Column:
    """-1 the same, 0 the key starts with the term, 1 a later word does, 2 each word of the
    term starts some word, null no match."""
    words = F.split(term, " ")
    scattered = F.forall(words, lambda w: F.exists(F.split(key, " "), lambda k: F.startswith(k, w)))
    return (
        F.when(key == term, -1)
        .when(F.startswith(key, term), 0)
        .when(F.contains(key, F.concat(F.lit(" "), term)), 1)
        .when((F.size(words) > 1) & scattered, 2)
    )


def _find(label: Column, typed: Column) -> Column:
    at = F.regexp_instr(label, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), typed, F.lit(r"\E")))
    start = F.when(F.startswith(label, typed), 0).when(at > 0, at)
    return F.when(F.length(typed) > 0, F.struct(start.alias("start"), (start + F.length(typed)).alias("end")))


def highlight_range(label: Column, typed: Column) -> Column:
    """struct(start, end) of the typed text in the label, else of its first word."""
    term, shown = F.lower(F.trim(typed)), F.lower(label)
    whole = _find(shown, term)
    first = _find(shown, F.regexp_extract(term, r"^\S+", 0))
    return F.when(whole["start"].isNotNull(), whole).when(first["start"].isNotNull(), first)


def _beginnings(key: Column) -> Column:
    """Every distinct beginning of every word of a key."""
    starts = F.transform(
        F.filter(F.split(key, " "), lambda w: F.length(w) > 0),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n)),
    )
    return F.array_distinct(F.flatten(starts))


def _phrases(name: Column) -> Column:
    """Every text that finds a name by its beginning or by that of a later word, with its tier."""
    words = F.split(name, " ")

    def from_word(word: Column, i: Column) -> Column:
        rest = F.array_join(F.slice(words, i + 1, F.size(words)), " ")
        tier = lambda n: F.when(i > 0, 1).when(n == F.length(rest), -1).otherwise(0)
        return F.transform(F.sequence(F.lit(1), F.length(rest)), lambda n: F.struct(F.substring(rest, F.lit(1), n).alias("probe"), tier(n).alias("tier")))

    return F.flatten(F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.length(x["w"]) > 0), lambda x: from_word(x["w"], x["i"])))


def _rank() -> list[Column]:
    order = constant(KIND_ORDER, "map<string,int>")
    return [F.desc("count"), order[F.col("kind")], F.length("label"), F.lower("label"), F.col("label")]


def _entries(hits: DataFrame, by: str) -> DataFrame:
    """One row per entry and `by`: its best tier; the key itself wins a tie with an alias."""
    shown = [c for c in hits.columns if c not in (by, "name", "alias", "tier")]
    best = hits.groupBy(by, *shown).agg(F.min(F.struct("tier", F.coalesce("alias", F.lit("")).alias("alias"))).alias("_h"))
    return best.select(by, *shown, F.col("_h.tier").alias("tier"), F.col("_h.alias").alias("alias"))


def _index(names: DataFrame, limit: int) -> DataFrame:
    """For every text that may be typed its `limit` best entries of each kind and tier; no other can be shown for it."""
    found = _entries(names.select("*", F.inline(_phrases(F.col("name")))), "probe")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("probe", "kind", "tier").orderBy(*_rank())))
    return ranked.filter(F.col("_r") <= limit).drop("_r")


def _best(hits: DataFrame, limit: int) -> DataFrame:
    caps = constant(KIND_CAP, "map<string,int>")
    within = Window.partitionBy("term", "kind").orderBy("tier", *_rank())
    overall = Window.partitionBy("term").orderBy("tier", *_rank())
    return (
        hits.withColumn("_k", F.row_number().over(within))
        .filter(F.col("_k") <= limit)
        .filter(F.col("_k") <= F.coalesce(caps[F.col("kind")], F.lit(limit)))
        .withColumn("pos", F.row_number().over(overall))
        .filter(F.col("pos") <= limit)
        .drop("_k")
    )


def _completions(asked: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(term, pos, entry) of every different term; `names` are entries with `name` and `alias` (null for the key).

    A term meets at most `limit` entries of a kind and tier under its own text. Only
    terms of several words that do not fill their list that way look for entries
    that hold their words apart, in the list of their longest word.
    """
    terms = asked.filter(F.length("term") > 0).select("term").distinct()
    whole = terms.join(_index(names, limit).withColumnRenamed("probe", "term"), "term")
    full = _best(whole, limit).filter(F.col("pos") == limit).select("term")
    words = F.transform(F.split("term", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    several = terms.filter(F.col("term").contains(" ")).join(full, "term", "left_anti").withColumn("probe", F.array_max(words)["w"])
    apart = several.join(names.withColumn("probe", F.explode(_beginnings(F.col("name")))), "probe").drop("probe")
    apart = apart.withColumn("tier", match_tier(F.col("name"), F.col("term"))).filter("tier IS NOT NULL")
    # An entry met both ways keeps its better tier.
    return _best(_entries(whole.withColumn("name", F.lit(None).cast("string")).unionByName(apart), "term"), limit)


def suggest_keywords(vocabulary: DataFrame, terms: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Best completions of (term_id, typed) in the keyword box; an empty term has none."""
    asked = terms.select("term_id", "typed", suggest_title_key(F.col("typed")).alias("term"))
    names = vocabulary.select("kind", "label", "count", "slug", F.col("key").alias("name"), F.lit(None).cast("string").alias("alias"))
    found = asked.join(_completions(asked, names, limit), "term")
    return found.select("term_id", "pos", "kind", "label", "slug", highlight_range(F.col("label"), F.col("typed")).alias("mark"))


def suggest_places(vocabulary: DataFrame, terms: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Best completions in the place box; an empty term lists the busiest places."""
    asked = terms.select("term_id", "typed", normalize_text(F.col("typed")).alias("term"))
    own = F.array(F.struct(F.col("key").alias("key"), F.lit(None).cast("string").alias("name")))
    names = vocabulary.select("*", F.explode(F.concat(own, "alt")).alias("_n")).select(
        "kind", "label", "count", F.col("_n.key").alias("name"), F.col("_n.name").alias("alias")
    )
    matched = asked.join(_completions(asked, names, limit), "term")
    alias = F.when(F.col("alias") != "", F.col("alias"))
    mark = F.when(alias.isNull(), highlight_range(F.col("label"), F.col("typed")))
    shown = matched.select("term_id", "pos", "kind", "label", alias.alias("alias"), mark.alias("mark"))
    # Vocabulary rows are at most the city list and one more: gathered into one row of `limit` places.
    top = vocabulary.withColumn("pos", F.row_number().over(Window.orderBy(*_rank()))).filter(F.col("pos") <= limit)
    everywhere = top.agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "label"))).alias("places")).withColumn("_k", F.lit(0))
    blank = asked.filter(F.length("term") == 0).select("term_id", F.lit(0).alias("_k"))
    idle = blank.join(F.broadcast(everywhere), "_k").select("term_id", F.inline("places"))
    return shown.unionByName(idle, allowMissingColumns=True)


def city_aliases(spark) -> DataFrame:
    """(city, alias) rows of the fixed alias table."""
    rows = [(city, alias) for city, names in {**CITY_ALIASES, "Remote": REMOTE_ALIASES}.items() for alias in names]
    return spark.createDataFrame(rows, "city string, alias string")
