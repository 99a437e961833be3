import random

from pyspark.sql import functions as F

from lodestone.llm import line_dedup as ld

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least=5):
    seen = {}
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen.setdefault(k, set()).add(doc_id)
    for ids in seen.values():
        ids.discard(None)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x, d=doc_id: d is not None and len(key(x)) >= 40 and len(seen[key(x)]) >= least and d != max(seen[key(x)])
        kept = [x for x in lines if not gone(x)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé XYZ") for _ in range(n)).strip() for n in (39, 40, 41, 60, 90, 200)] + ["Ä" * 45, "ä" * 45, "Q" * 50]
    vary = lambda s: rng.choice([s, s.upper() if s.isascii() else s, f"  {s}\t", f"{s}\r"])
    rows = [(i, "\n".join(vary(rng.choice(pool)) if rng.random() < 0.5 else f"line {rng.random()}" for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, f"{'Q' * 50}\nx"), (7, "Q" * 50), (103, f"{'q' * 50}\n{'Q' * 50}\nend")] + rows[:9] + rows[:3]


def test_equals_brute_force(spark, tmp_path):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
        docs.repartition(7).write.parquet(f"{tmp_path}/{seed}")
        for given in (docs, spark.read.parquet(f"{tmp_path}/{seed}")):
            found = ld.drop_repeated_lines(given).select("doc_id", "text", "n_lines", "n_dropped", "key").collect()
            assert sorted((tuple(r)[:4] for r in found), key=str) == brute(rows)
            assert {r["key"] for r in found} == {"clash"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.drop_repeated_lines(docs).collect() == []


def test_rows_that_repeat(spark):
    """Repeated rows are one document: it takes five ids to lose a line, and places count once a row."""
    line = "x" * 45
    run = lambda rows: sorted(tuple(r) for r in ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped").collect())
    assert run([(1, line)] * 3 + [(i, line) for i in range(2, 6)]) == [(1, 1, 1)] * 3 + [(2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 0)]
    assert run([(1, line)] * 3 + [(2, line)] * 2) == [(1, 1, 0)] * 3 + [(2, 1, 0)] * 2


def test_very_long_text(spark):
    lines = [f"{'long line ' * 5}{i % 700}" for i in range(30_000)]
    rows = [(i, "\n".join(lines[i:])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ld.drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_levels_keep_totals(spark):
    runs = ld.LineRuns(spark, fanout=2)
    line = lambda i: "x" * 40 + str(i)
    for batch in range(5):
        docs = spark.createDataFrame([(10 * batch + d, "\n".join(line(i) for i in range(batch + 1))) for d in range(2)], "doc_id long, text string")
        runs.add(ld.keyed(docs, 40))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # each run has the lines that were new when it was added
    assert [run.filter("fresh").count() for run in runs.tables()] == [1, 4]
    found = runs.totals().agg(F.sum("n_docs"), F.max("last_doc"), F.count(F.lit(1))).first()
    assert tuple(found) == (2 * (5 + 4 + 3 + 2 + 1), 41, 5)


def test_runs_are_not_shuffled(spark):
    runs = ld.LineRuns(spark, fanout=9)
    for batch in range(3):
        docs = spark.createDataFrame([(10 * batch + d, "y" * 40 + str(d % (batch + 1))) for d in range(9)], "doc_id long, text string")
        runs.add(ld.keyed(docs, 40))
    assert len(runs.tables()) == 3
    for made in (runs.totals(), runs.marked(runs.tables()[0].drop("fresh"))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_one_file_makes_several_runs(spark, tmp_path, monkeypatch):
    seen, add = [], ld.LineRuns.add
    monkeypatch.setattr(ld.LineRuns, "add", lambda self, lines: (add(self, lines), seen.append([len(level) for level in self.levels]))[0])
    rows = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    found = ld.drop_repeated_lines(spark.read.parquet(f"{tmp_path}/one")).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert seen == [[1], [0, 1], [1, 1]]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ld.drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
