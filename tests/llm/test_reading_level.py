import random

from graphloom.llm.reading_level import LEVELS, labelled, prose_sentences, reading_levels
from graphloom.sources.tables import table

EASY = ["The {a} was big and red.", "We put the {a} by the {b}.", "It was a warm day, so the {a} sat on the {b}.", "I like my {a} and your {b}."]
MEDIUM = ["When the {a} returned from the market, they repaired the {b} before the evening meal.", "According to the teacher, the {a} should be collected by the visitor once a month."]
HARD = ["The theoretical {a} underlying institutional arrangements necessarily presupposes an epistemological {b}, irrespective of operational constraints.", "Notwithstanding methodological limitations, the {a} exemplifies multidimensional heterogeneity that the {b} circumscribes."]
NOUNS = "cat dog pen map box lake road tree cup song ring bird".split()


def text(level, n=12):
    forms = (EASY, MEDIUM, HARD)[level]
    return " ".join(random.choice(forms).format(a=random.choice(NOUNS), b=random.choice(NOUNS)) for _ in range(n))


def corpus(spark):
    random.seed(9)
    docs = [(i, text(i % 3, 16), i % 3) for i in range(90)]
    ratings = [(i, r, LEVELS[level].upper() if r == 1 else f" {LEVELS[level]}") for i, _, level in docs[:60] for r in (1, 2)] + [(0, 3, "hard"), (0, 3, "hard"), (1, 4, "odd"), (None, 1, "easy")]
    return docs, spark.createDataFrame([(*r, 0) for r in ratings], "doc_id long, rater_id int, level string, fold int")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, level string")


def test_held_out_levels_and_what_is_no_prose(spark):
    docs, ratings = corpus(spark)
    extra = [(200, None), (201, ""), (202, "  \n"), (203, text(2, 2)), (204, "\n".join("2025-01-01T00:00:00Z INFO the materializer seq=1 lag_ms=3 of the log" for _ in range(30))), (205, "\n".join("person:a --part_of--> project:the" for _ in range(60))), (206, "\n".join("the,1,2,of" for _ in range(99))), (207, "Der Index war älter als der Eintrag und deshalb fehlte er in der Liste. " * 20)]
    layouts = [(300, "<div><p>" + "</p>\n<p>".join(text(0, 16).split(". ")) + "</p></div>"), (301, "\n".join(f"[09:{i:02d}] Ann: {s}" for i, s in enumerate(text(2, 8).split(". ")))), (302, text(1, 16).upper()), (303, "- " + "\n- ".join(text(0, 16).split(". "))), (304, text(2, 400))]
    got = {r.doc_id: r.level for r in reading_levels(frame(spark, [(i, t) for i, t, _ in docs] + extra + layouts), ratings).collect()}
    assert not any(i in got for i, _ in extra)
    assert {i: got[i] for i, _ in layouts} == {300: "easy", 301: "hard", 302: "medium", 303: "easy", 304: "hard"}
    held_out = [(i, LEVELS[level]) for i, _, level in docs[60:]]
    assert sum(got[i] == level for i, level in held_out) / len(held_out) == 1


def test_without_ratings_or_documents(spark):
    docs, ratings = corpus(spark)
    df = frame(spark, [(i, t) for i, t, _ in docs])
    assert reading_levels(df, ratings.limit(0)).collect() == []
    assert reading_levels(df.limit(0), ratings).collect() == []
    one = spark.createDataFrame([(0, 1, "easy"), (3, 1, "easy")], "doc_id long, rater_id int, level string")
    assert {r.level for r in reading_levels(df, one).collect()} == {"easy"}


def test_votes(spark):
    rows = [(1, 1, "easy"), (1, 2, "hard"), (1, 3, "hard"), (2, 1, "easy"), (2, 2, "medium"), (3, 1, None)]
    got = {(r.doc_id, r.level) for r in labelled(spark.createDataFrame(rows, "doc_id long, rater_id int, level string")).collect()}
    assert got == {(1, 2)}


def test_sentences():
    assert prose_sentences("# Head\n[09:01] Ann: It works. Does it?\n- one two\n> quoted\n3. third\nsee https://x.y/z") == ["it works", "does it?", "one two", "quoted", "third"]


def test_agreement_with_raters(spark, sf):
    folder = sf.replace("0.001", "0.01")
    ratings = table(spark, folder, "reading_labels")
    levels = reading_levels(table(spark, folder, "documents"), ratings)
    truth = labelled(ratings)
    both = levels.join(truth.withColumnRenamed("level", "truth"), "doc_id").collect()
    assert len(both) == truth.count()
    assert sum(LEVELS[r.truth] == r.level for r in both) / len(both) > 0.85
