import random

import numpy as np

from lodestone.llm import grammar, toxicity


def labels(symbols):
    return [grammar.LABELS[k] for _, k in grammar.GRAMMAR.labels(symbols)]


def test_grammar():
    assert labels("oioo") == ["I-plain"]
    assert labels("yoi") == ["D-plain"]
    assert labels("iooy") == ["I-plain", "D-plain"]
    assert labels("yooooi") == ["I-plain"]
    assert labels("tooy") == ["B-plain", "T-plain"]
    assert labels("noi") == ["I-negated"]
    assert labels("nooooi") == ["I-plain"]
    assert labels("ryooi") == ["D-reported"]
    assert labels("ooyo") == []


def brute_force(symbols, reach=3):
    """The labels by definition, from distances."""
    found = []
    for i, s in enumerate(symbols):
        back = lambda kind: min((i - j for j in range(i) if symbols[j] == kind), default=99)
        kind = ""
        if s in "it":
            aimed = back("y") <= reach
            kind = {"i": "ID", "t": "BT"}[s][aimed]
        elif s == "y":
            kind = "T" if back("t") <= reach else "D" if back("i") <= reach else ""
        if kind:
            mode = "reported" if "r" in symbols[: i + 1] else "negated" if back("n") <= reach else "plain"
            found.append(f"{kind}-{mode}")
    return found


def test_composition_equals_the_definition():
    rng = random.Random(1)
    for _ in range(2000):
        symbols = "".join(rng.choice(grammar.SYMBOLS) for _ in range(rng.randrange(0, 12)))
        assert labels(symbols) == brute_force(symbols), symbols


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    rows, truth = [], {}
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["grobz", "vulmo"]) + rng.choice(plain))
        rows.append((i, " ".join(words) + "."))
        truth[i] = int(toxic)
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "x"), (9001, "")], "doc_id long, text string")
    tags = spark.createDataFrame([*truth.items(), (3, None), (None, 1), (8, 0), (77777, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, tags)).toPandas()
    assert len(found) == 904
    out = found[found.held_out & found.doc_id.lt(900)]
    right = [truth[int(d)] == p for d, p in zip(out.doc_id, out.predicted)]
    assert np.mean(right) > 0.97
    empty = found[found.text.isna() | found.text.eq("")]
    assert len(empty) == 3 and empty.score.nunique() == 1 and empty.predicted.eq(0).all()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "You are an idiot. You idiot."), (2, "Lovely.")], "doc_id long, text string")
    tags = spark.createDataFrame([], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, tags)).collect()}
    assert found == {1: 1, 2: 0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), tags)).collect() == []


def said(text, learned=None, threats=frozenset()):
    lexicon = toxicity.Lexicon(learned or {}, threats)
    x = lexicon.features(toxicity.tokens(text))
    return {grammar.LABELS[k] for k in np.flatnonzero(x)}


def test_clauses():
    assert said("You idiot.") == {"D-plain"}
    assert said('He said: "You idiot."') == said("He said you idiot") == {"D-reported"}
    assert said('She wrote, “Go away. You idiot. You moron!” Then it rained.') == {"D-reported"}
    assert said('She wrote "nice". You idiot.') == {"D-plain"}
    assert said("Today: you idiot") == {"D-plain"}
    assert said("You isn\u2019t stupid") == said("You isn't stupid") == {"D-negated"}
    # one event a word: aimed when its target follows, whatever comes after
    assert said("idiot, I mean you you") == {"D-plain"}
    assert np.isclose(toxicity.Lexicon({}).features(toxicity.tokens("idiot you")).sum(), np.log1p(toxicity.SEED_WEIGHT))
    assert said("i will zork you", {"zork": 4.0}, frozenset({"zork"})) == {"T-plain"}


def test_learned_threats(spark):
    rows = [(i, f"I will zork you soon number{i}.") for i in range(40)] + [(100 + i, f"You are such a grubble word{i}.") for i in range(40)]
    rows += [(200 + i, f"The weather is fine today and you can go out {i}.") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(d, int(d < 200)) for d, _ in rows], "doc_id long, toxic int"))
    assert "zork" in model.threats and "grubble" in model.entries and "grubble" not in model.threats


def test_very_long_text(spark):
    text = "Nice words go on. " * 60_000 + "You idiot. " * 3
    docs = spark.createDataFrame([(1, text), (2, "Nice words go on.")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()}
    assert found[1] > found[2]
