"""Triples from text by verb patterns, text variants, chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: verb phrases in order of precedence and their relations
VERB_PATTERNS = [
    ("attended", "attended"), ("gave a talk", "gave_talk"), ("gave a speech", "gave_talk"), ("spoke at", "gave_talk"),
    ("painted", "painted"), ("organized", "organized"), ("volunteered at", "volunteered_at"), ("volunteered for", "volunteered_for"),
    ("signed up for", "enrolled_in"), ("started transitioning", "started"), ("started working", "started_work"), ("started a new", "started"),
    ("adopted a", "adopted"), ("adopted an", "adopted"), ("is researching", "researched"), ("researched", "researched"),
    ("is planning to", "planning"), ("planning to", "planning"), ("is considering", "considering"), ("considering a career in", "considering_career"),
    ("explore career options in", "exploring_career"), ("ran a charity", "participated_in"), ("ran a marathon", "participated_in"), ("went to", "visited"),
    ("visited", "visited"), ("moved to", "moved_to"), ("traveled to", "traveled_to"), ("studied", "studied"),
    ("read", "read"), ("wrote", "wrote"), ("joined", "joined"), ("cooked", "cooked"),
    ("baked", "baked"), ("built", "built"), ("created", "created"), ("donated", "donated"),
    ("volunteered", "volunteered"), ("watched", "watched"), ("listened to", "listened_to"), ("played", "played"),
    ("swimming with", "went_swimming"), ("going camping", "going_camping"), ("going hiking", "going_hiking"), ("going to the beach", "going_to_beach"),
    ("is taking a", "taking"), ("took a", "taking"), ("took her", "took_to"), ("is learning", "learning"),
    ("learned", "learned"), ("attended a workshop", "attended_workshop"), ("attended a conference", "attended_conference"), ("opened up about", "shared_about"),
    ("shared about", "shared_about"), ("talked about", "discussed"), ("discussed", "discussed"), ("looking into", "researching"),
    ("working on", "working_on"), ("signed up", "enrolled_in"), ("made a", "made"), ("bought a", "bought"),
    ("bought an", "bought"), ("received", "received"), ("won", "won"), ("hosted", "hosted"),
    ("celebrated", "celebrated"), ("chose an", "chose"), ("chose a", "chose"), ("collects", "collects"), ("collected", "collected"),
]

# fixed values: words that are no part of an object
OBJECT_STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into through during "
    "is was are were been being have has had do does did will would could should may "
    "might can shall this that these those it its her his their my our your she he "
    "they we you me him us them not no just very really so too also now then "
    "here there some any much many more most other each every all both few still already "
    "yet even only own same last next first new old good great big small long right "
    "different recently currently always never often because while since after before when where "
    "which who whom what how if as like"
).split()

# fixed values: words by which an object is typed, types in order of precedence
OBJECT_TYPES = {
    "event": "group meeting party wedding event workshop conference race marathon parade festival celebration talk speech presentation seminar session".split(),
    "location": "beach park school hospital office store shop restaurant cafe library museum gym pool lake mountain river forest garden home house city town country street road".split(),
    "activity": "swimming hiking camping running cooking baking painting drawing writing reading singing dancing yoga meditation exercise workout class course lesson training practice therapy".split(),
    "person": "mom dad mother father sister brother daughter son friend partner husband wife kid child doctor teacher therapist counselor".split(),
    "organization": "agency organization company school university college institute center foundation charity church community club team".split(),
}


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def object_type(column: Column) -> Column:
    """The first type of which a word is contained in the object, else ``object``."""
    return F.coalesce(*[F.when(F.exists(_list(words), lambda w: F.contains(column, w)), F.lit(kind)) for kind, words in OBJECT_TYPES.items()], F.lit("object"))


def pattern_triples(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` with ``relation``, ``object`` and ``object_type``; rows without text give none.

    The first verb phrase of the list that the text contains decides the
    relation; the object is made of the next four words that are no stopwords,
    or is the relation if there are none. Without any phrase the relation is
    ``has_memory`` and the object the first five such words, or ``memory``.
    """
    low = F.lower(F.col(text))
    patterns = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in VERB_PATTERNS])
    hit = F.try_element_at(F.filter(patterns, lambda x: F.contains(low, x["p"])), F.lit(1))
    rows = df.where(F.col(text).isNotNull()).withColumn("_hit", hit)
    # lower-casing may change the length of a text, so the rest is cut from the lower-case one
    rest = F.when(F.col("_hit").isNull(), low).otherwise(F.substring(low, F.instr(low, F.col("_hit.p")) + F.length("_hit.p"), F.length(low)))
    words = F.filter(F.regexp_extract_all(rest, F.lit("([a-z]+)"), 1), lambda w: ~w.isin(*OBJECT_STOPWORDS))
    rows = rows.withColumn("_w", words).withColumn("relation", F.coalesce(F.col("_hit.r"), F.lit("has_memory")))
    made = F.array_join(F.slice("_w", 1, F.when(F.col("_hit").isNull(), 5).otherwise(4)), "_")
    rows = rows.withColumn("object", F.when(F.size("_w") > 0, made).when(F.col("_hit").isNull(), F.lit("memory")).otherwise(F.col("relation")))
    return rows.drop("_hit", "_w").withColumn("object_type", object_type(F.col("object")))


def variants(df: DataFrame, raw: str, fields: list[str]) -> DataFrame:
    """Each row in every combination of ``raw`` with the ``fields``: ``variant`` (its number, bit i for field i) and ``text``.

    A field that is null adds no line.
    """
    number = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(fields) - 1))).alias("variant")
    lines = [F.when(F.col("variant").bitwiseAND(1 << i) != 0, F.concat(F.lit(f"{name}: "), F.col(name))) for i, name in enumerate(fields)]
    return df.select("*", number).withColumn("text", F.concat_ws("\n", F.col(raw), *lines))


def chat_turns(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, turn, speaker, said)`` from lines such as ``[09:00] Ann: It works.``; other lines are no turns."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("turn", "_line")
    form = r"^\[\d\d:\d\d\] ([^:]+): (.*)$"
    return df.select(ident, lines).where(F.col("_line").rlike(form)).select(ident, "turn", F.regexp_extract("_line", form, 1).alias("speaker"), F.regexp_extract("_line", form, 2).alias("said"))


def neighbour_turns(turns: DataFrame, ident: str) -> DataFrame:
    """Turns with the speaker of the turn just before and just after, null where that number is no turn."""
    side = lambda step, name: turns.select(ident, (F.col("turn") - step).alias("turn"), F.col("speaker").alias(name))
    return turns.join(side(-1, "previous_speaker"), [ident, "turn"], "left").join(side(1, "next_speaker"), [ident, "turn"], "left")


def best_overlap(facts: DataFrame, turns: DataFrame, ident: str, words: str) -> DataFrame:
    """For each fact the turn of the same ``ident`` with which it shares most words, the first of equals; none without a shared word.

    ``facts(ident, fact, words)``, ``turns(ident, turn, words)``, with arrays of words.
    """
    left = facts.select(ident, "fact", F.explode(F.array_distinct(words)).alias("_w"))
    right = turns.select(ident, "turn", F.explode(F.array_distinct(words)).alias("_w"))
    shared = left.join(right, [ident, "_w"]).groupBy(ident, "fact", "turn").agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy(ident, "fact").agg(F.max(F.struct("shared", (-F.col("turn")).alias("_t"))).alias("_b")).select(ident, "fact", (-F.col("_b._t")).alias("turn"), F.col("_b.shared").alias("shared"))
