"""Evidence of edges and questions, and the memories that it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import salted_join

# ids: ``D3:12`` is turn 12 of session 3, ``conv-26_D3_12`` the memory made from it


def with_underscore(turn: Column) -> Column:
    """``D3:12`` as ``D3_12``; anything else with its colons replaced alike."""
    return F.regexp_replace(F.trim(turn), ":", "_")


def with_colon(turn: Column) -> Column:
    """``D3_12`` as ``D3:12``; anything else as it is."""
    return F.regexp_replace(F.trim(turn), r"^(D\d+)_(\d+)$", "$1:$2")


def session_name(text: Column) -> Column:
    """``session_3`` of any text with a number, such as ``3`` or ``S03``; a text without one as it is, null as empty."""
    text = F.trim(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(text.startswith("session_") | (number == ""), text).otherwise(F.concat(F.lit("session_"), number.cast("decimal(38,0)").cast("string")))


def sample_of_question(ident: Column) -> Column:
    """``conv-26`` of ``conv-26_qa_0001``; null where the id has no such form."""
    return F.nullif(F.regexp_extract(ident, r"^(.+)_qa_\d+$", 1), F.lit(""))


def sample_of_memory(ident: Column) -> Column:
    """``conv-26`` of ``conv-26_D3_12`` or ``conv-26_D3:12``; null where the id has no such form."""
    return F.nullif(F.regexp_extract(ident, r"^(.+)_D\d+[_:]\d+$", 1), F.lit(""))


def by_scope_and_turn(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges with every memory of their scope and turn: ``edges(scope, turn, ...)``, ``memories(scope, turn, memory_id)``.

    An edge of a turn with several memories comes out once for each, one
    without any not at all; null scopes and turns meet nothing. Repeated
    memories are one.
    """
    return salted_join(edges, memories.select("scope", "turn", "memory_id").distinct(), ["scope", "turn"], F.struct(*edges.columns), "inner")


def first_match(references: DataFrame, memories: DataFrame) -> DataFrame:
    """The one memory of each of ``references(sample, turn)``: ``(sample, turn, memory_id, how)``.

    ``memories(sample, turn, memory_id)``, turns with an underscore. A memory
    of the same sample and turn (``exact``), else any whose id contains the
    turn, as ``D1_1`` is contained in ``x_D1_12`` (``contained``), else null
    (``none``); of several the first by id. The containment is an equi-join:
    each id is listed under the beginnings of its turn number, at most as many
    as that has digits.
    """
    asked = references.select("sample", "turn").where("turn is not null").distinct()
    known = memories.where("memory_id is not null")
    exact = known.groupBy("sample", "turn").agg(F.min("memory_id").alias("_exact"))
    form = r"(D\d+_)(\d+)"
    digits = F.regexp_extract("memory_id", form + "$", 2)
    starts = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda n: F.concat(F.regexp_extract("memory_id", form + "$", 1), F.substring(digits, F.lit(1), n)))
    under = known.where(F.col("memory_id").rlike(form + "$")).select("memory_id", F.explode(starts).alias("turn")).groupBy("turn").agg(F.min("memory_id").alias("_within"))
    rows = asked.join(exact, ["sample", "turn"], "left").join(under, "turn", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_within").isNotNull(), "contained").otherwise("none")
    return rows.select("sample", "turn", F.coalesce("_exact", "_within").alias("memory_id"), how.alias("how"))


def with_suffix(memories: DataFrame, turns: DataFrame) -> DataFrame:
    """Those of ``memories(memory_id, ...)`` whose id ends with one of ``turns(turn)`` of whatever sample; a semi join on the id's own end."""
    ends = memories.withColumn("_turn", F.regexp_extract("memory_id", r"(D\d+_\d+)$", 1))
    return ends.join(turns.select(F.col("turn").alias("_turn")).distinct(), "_turn", "left_semi").drop("_turn")


def questions_with_turns(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """``questions(question_id, sample, turn)`` with ``turns(sample, turn, memory_id)``: all questions stay, ``matched`` says whether there is a turn."""
    known = turns.where("memory_id is not null").groupBy("sample", "turn").agg(F.min("memory_id").alias("memory_id"))
    rows = questions.select("question_id", "sample", "turn").join(known, ["sample", "turn"], "left")
    return rows.select("question_id", "sample", "turn", "memory_id", F.col("memory_id").isNotNull().alias("matched"))


def aliases(memories: DataFrame) -> DataFrame:
    """Every spelling of the ids of ``memories(memory_id)``: ``(alias, memory_id)``, one memory for each alias, the last by id.

    Besides the id itself with colon and underscore, an id of the form
    ``conv-26_D3_12`` is known with its session as ``conv-26_session_3_D3:12``.
    """
    ident = F.col("memory_id")
    sample = sample_of_memory(ident)
    turn = F.regexp_extract(ident, r"(D\d+)[_:](\d+)$", 1), F.regexp_extract(ident, r"(D\d+)[_:](\d+)$", 2)
    session = session_name(turn[0])
    spelled = [ident, F.regexp_replace(ident, ":", "_")]
    for mark in ("_", ":"):
        spelled += [F.concat(sample, F.lit("_"), turn[0], F.lit(mark), turn[1]), F.concat(sample, F.lit("_"), session, F.lit("_"), turn[0], F.lit(mark), turn[1])]
    rows = memories.where("memory_id <> ''").select("memory_id", F.explode(F.array(*spelled)).alias("alias")).where("alias is not null")
    return rows.groupBy("alias").agg(F.max("memory_id").alias("memory_id"))


def resolve(references: DataFrame, memories: DataFrame) -> DataFrame:
    """``references(reference)`` with the memory they name, null where they name none: as an id itself, then as an alias."""
    ids = memories.where("memory_id <> ''").select(F.col("memory_id").alias("_id"), F.col("memory_id").alias("reference")).distinct()
    known = aliases(memories).select(F.col("alias").alias("reference"), F.col("memory_id").alias("_by_alias"))
    rows = references.select(F.trim("reference").alias("reference")).distinct().join(ids, "reference", "left").join(known, "reference", "left")
    return rows.select("reference", F.coalesce("_id", "_by_alias").alias("memory_id"))


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in the order of the input's files and rows; null keys are a key. Reduced before the shuffle."""
    columns = [c for c in df.columns if c not in keys]
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_at").alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_of_each(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in an order; Spark cuts each partition to ``k`` a group before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
