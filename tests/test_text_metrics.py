import statistics

import pytest
from pyspark.sql import functions as F

from lodestone.operators import text_metrics as T
from lodestone.plans import registry  # noqa: F401

# texts with their sentences and numbers of words, worked out by hand
WORKED = [
    ("One two. Three four five! Six?", ["One two.", "Three four five!", "Six?"], 6),
    ("Wait... no. Yes (really.) Done", ["Wait... no.", "Yes (really.)", "Done"], 5),
    ('He said "Go." Then left.', ['He said "Go."', "Then left."], 5),
    ("No break.here 3.5 is it. 4 more", ["No break.here 3.5 is it.", "4 more"], 9),
    ("Price $! Next thing. okay", ["Price $! Next thing.", "okay"], 4),
    ("Price $          ! Next thing.", ["Price $          ! Next thing."], 3),
    ("So..." + '"' * 40 + " Next one.", ["So..." + '"' * 40 + " Next one."], 3),
    ("So... \n\n And on. Good", ["So... \n\n And on.", "Good"], 4),
    ("A.\nB.\n\nCc dd.", ["Cc dd."], 4),
    ("Été fini. À bientôt. (So.) *Bold* end.", ["Été fini.", "À bientôt.", "(So.)", "*Bold* end."], 4),
    ("lower after. end. and “quoted.” then", ["lower after.", "end.", "and “quoted.”", "then"], 6),
    ("well-known x_1 caf\u00e9 -a- b", ["well-known x_1 caf\u00e9 -a- b"], 4),
    ("   ", [], 0),
    ("", [], 0),
]


@pytest.mark.parametrize(("text", "want", "n_words"), WORKED)
def test_worked_texts(spark, text, want, n_words):
    row = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s"), F.size(T.words(F.col("t"))).alias("n")).first()
    assert (row.s, row.n) == (want, n_words)


def test_measures(spark):
    rows = [(1, "One two. Three four five six! Seven: eight; nine — ten."), (2, None), (3, "word")]
    found = {r.doc_id: r for r in T.prose_metrics(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    lengths = [2, 4, 4]
    one = found[1]
    assert (one.words, one.sentences, one.colons_semicolons, one.em_dashes) == (10, 3, 2, 1)
    assert abs(one.mean_sentence_length - statistics.mean(lengths)) < 1e-5 and abs(one.sentence_length_std - statistics.stdev(lengths)) < 1e-5
    assert (found[2].words, found[2].sentences, found[2].burstiness_cv) == (0, 0, 0.0)
    assert (found[3].words, found[3].sentences, found[3].sentence_length_std) == (1, 1, 0.0)


def test_sketches_merge(spark):
    from oracle import DATA

    from lodestone.plans.catalogue import queries

    true = spark.read.parquet(f"{DATA}/sf0.01/events.parquet").select("user_id").distinct().count()
    assert abs(queries()["sketch_union"](spark, f"{DATA}/sf0.01").first().users - true) <= 0.02 * true
