"""Tokens, answers and enrichment lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words left out of token comparison
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between through "
    "during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all both each few "
    "more most other some such no nor not only own same so than too very s t "
    "can will just don should now d ll m o re ve y ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won "
    "wouldn also would could should may might shall"
).split()

# fixed values: words that mark a question or an edge as temporal
TEMPORAL_WORDS = "when before after first last later earlier recently yesterday today tomorrow date time week month year day ago since until".split()

# fixed values: number words that the relaxed comparison writes as digits
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()

# fixed values: phrases of an answer that abstains
ABSTENTIONS = [
    "cannot answer", "can not answer", "cannot determine", "can not determine",
    "not enough information", "insufficient information", "not mentioned",
    "no information", "not provided", "unknown", "no evidence",
]

_NO_STRINGS = "array<string>"


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of at least two characters without stopwords; null gives none."""
    split = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(split, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def terms(text: Column) -> Column:
    """Words of at least two letters or digits without stopwords, then pairs of neighbours among them."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    words = F.filter(words, lambda t: ~t.isin(*STOPWORDS))

    def with_pairs(w: Column) -> Column:
        n = F.size(w)
        pairs = F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast(_NO_STRINGS))
        return F.concat(w, pairs)

    # within a list of one, so that the words are found once, not at each use
    return F.transform(F.array(words), with_pairs)[0]


def is_entity_like(token: Column) -> Column:
    """At least three characters, not all digits, no stopword."""
    return (F.length(token) >= 3) & ~token.rlike("^[0-9]+$") & ~token.isin(*STOPWORDS)


def is_temporal(words: Column) -> Column:
    """Whether any of the words is temporal."""
    return F.arrays_overlap(words, _list(TEMPORAL_WORDS))


def strict_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b(a|an|the)\b", " "), r"\s+", " "))


def relaxed_answer(text: Column) -> Column:
    """The strict form with number words as digits."""
    numbers = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(str(i)))])
    return F.array_join(F.transform(F.split(strict_answer(text), " "), lambda t: F.coalesce(F.try_element_at(numbers, t), t)), " ")


def abstains(text: Column) -> Column:
    """Whether the answer says that it can't be given."""
    relaxed = relaxed_answer(text)
    out = F.lit(False)
    for phrase in ABSTENTIONS:
        out = out | F.contains(relaxed, F.lit(phrase))
    return out


def enrichment(text: Column, name: str) -> Column:
    """The rest of the first line ``name: ...`` of an enriched text, null without one."""
    line = F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return F.when(line != "", line)


def raw_part(text: Column) -> Column:
    """An enriched text up to its first enrichment line."""
    return F.regexp_replace(text, r"(?s)\n(Entities|Relations|Keywords|Triples):.*$", "")


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences, split after a full stop, exclamation or question mark and space, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def clean_id(text: Column) -> Column:
    """The first eight words, lower case, joined by underscores."""
    return F.array_join(F.slice(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != ""), 1, 8), "_")


def iso_date(text: Column) -> Column:
    """``1:56 pm on 8 May, 2023`` as ``2023-05-08``; else the year named; else null."""
    months = "January February March April May June July August September October November December".split()
    number = F.create_map(*[x for i, m in enumerate(months, 1) for x in (F.lit(m.lower()), F.lit(f"{i:02d}"))])
    form = r"(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})"
    month = F.try_element_at(number, F.lower(F.regexp_extract(text, form, 2)))
    full = F.concat_ws("-", F.regexp_extract(text, form, 3), month, F.lpad(F.regexp_extract(text, form, 1), 2, "0"))
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(month.isNotNull(), full).when(year != "", year)


def evidence_ids(text: Column) -> Column:
    """Ids such as ``D1:3`` in a text, without leading zeros and spaces."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(D\s*:?\s*\d+\s*:\s*\d+)"), 1)
    number = lambda x, i: F.regexp_extract(x, r"D\s*:?\s*(\d+)\s*:\s*(\d+)", i).cast("int").cast("string")
    return F.transform(found, lambda x: F.concat(F.lit("D"), number(x, 1), F.lit(":"), number(x, 2)))


def split_ids(text: Column) -> Column:
    """Ids of a list written as JSON or parted by semicolons, commas or bars; blanks are dropped, the first of equals stays."""
    listed = F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.split(text, "[;,|]"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array().cast(_NO_STRINGS)), lambda x: F.trim(x)), lambda x: x != ""))
