"""The stage runner and the stages from image to solution: F5."""

import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE
from gridspark.operators import pipeline as PL
from gridspark.operators import recognizers as R
from gridspark.session import scratch

SOLVED = "534678912672195348198342567859761423426853791713924856961537284287419635345286179"
CALLS = []


def add(name, needs, gives, expr, refuse=None, **more):
    def work(df):
        CALLS.append(name)
        out = df.withColumn(gives.split()[0], F.expr(expr))
        return out if refuse is None else out.withColumn("refused", F.expr(refuse))

    return PL.Stage(name, work, needs, gives, **more)


def three(last="b + 1"):
    return [
        add("one", "id bigint", "a bigint", "id * 2", "CASE WHEN id % 5 = 0 THEN 'fifth' END"),
        add("two", "a bigint", "b bigint", "a + id", "CASE WHEN id % 3 = 0 THEN 'third' END"),
        add("three", "a bigint, b bigint", "c bigint", last),
    ]


def results(run):
    return (sorted(map(tuple, run.kept.collect())), sorted(map(tuple, run.refused.collect())),
            [tuple(r)[1:] for r in run.accounts.orderBy("number").collect()])


def test_every_row_is_accounted_for(spark):
    kept, refused, accounts = results(PL.run_pipeline(spark.range(30), three(), "id"))
    assert kept == [(i, 2 * i, 3 * i, 3 * i + 1) for i in range(30) if i % 5 and i % 3]
    assert refused == sorted([(i, "one", "fifth") for i in range(0, 30, 5)] + [(i, "two", "third") for i in range(30) if i % 5 and i % 3 == 0])
    assert accounts == [("one", 30, 24, 6), ("two", 24, 16, 8), ("three", 16, 16, 0)]
    run = PL.run_pipeline(spark.range(30), three(), "id")
    assert run.outcomes("id").count() == 30 and run.outcomes("id").where("stage IS NULL").count() == 16


def test_a_killed_run_resumes_behind_its_last_stage(spark):
    place, whole = scratch(spark, "test"), results(PL.run_pipeline(spark.range(30), three(), "id"))
    with pytest.raises(Exception):
        PL.run_pipeline(spark.range(30), three("CAST(raise_error('killed') AS BIGINT)"), "id", place).kept.collect()
    CALLS.clear()
    run = PL.run_pipeline(spark.range(30), three(), "id", place)
    assert run.resumed == ["one", "two"] and CALLS == ["three"] and results(run) == whole
    CALLS.clear()
    assert results(PL.run_pipeline(spark.range(30), three(), "id", place)) == whole and CALLS == []


def test_a_changed_stage_and_all_behind_it_run_again(spark):
    place = scratch(spark, "test")
    PL.run_pipeline(spark.range(30), three(), "id", place)
    changed = three()
    changed[1] = add("two", "a bigint", "b bigint", "a - id", version="2")
    run = PL.run_pipeline(spark.range(30), changed, "id", place)
    assert run.resumed == ["one"]
    assert sorted(map(tuple, run.kept.collect())) == [(i, 2 * i, i, i + 1) for i in range(30) if i % 5]


@pytest.mark.parametrize("stages, said", [
    ([add("one", "nothing bigint", "a bigint", "id")], "needs nothing"),
    ([add("one", "id int", "a bigint", "id")], "needs id int"),
    ([add("one", "id bigint", "id bigint", "id")], "exist already"),
    ([add("one", "", "a bigint", "id"), add("one", "", "b bigint", "id")], "repeat"),
    ([add("one", "id bigint", "a bigint", "CAST(id AS STRING)")], "owes a bigint"),
    ([PL.Stage("one", lambda df: df.where("id > 3"))], "got 10 rows and gave 6"),
    ([PL.Stage("one", lambda df: df.union(df))], "got 10 rows and gave 20"),
    ([PL.Stage("one", lambda df: df.selectExpr("id + 1 AS other"))], "owes id"),
])
def test_broken_contracts_are_refused(spark, stages, said):
    with pytest.raises(PL.ContractError, match=said):
        PL.run_pipeline(spark.range(10), stages, "id")
    with pytest.raises(PL.ContractError, match="refused"):
        PL.run_pipeline(spark.range(10).withColumn("refused", F.lit("x")), three(), "id")


def test_no_images(spark):
    run = PL.run_pipeline(spark.range(0), three(), "id")
    assert results(run) == ([], [], [("one", 0, 0, 0), ("two", 0, 0, 0), ("three", 0, 0, 0)])


def test_from_image_to_solution(spark):
    """Each way to fail, with a recogniser that reads the first value of a vector."""
    R.register_recognizer("first", lambda: lambda x: (x[:, 0].astype(int), x[:, 1]))
    vectors = spark.createDataFrame([(d, [float(d), 0.9]) for d in range(1, 10)], "glyph bigint, vec array<double>")
    box = [(10.0, 10.0), (400.0, 10.0), (400.0, 400.0), (10.0, 400.0)]
    corners = f"array({', '.join(f'named_struct(\"x\", {x}D, \"y\", {y}D)' for x, y in box)})"
    quads = spark.range(1, 9).selectExpr("id AS image_id", "concat('q', id) AS quad_id", f"{corners} AS corners", "390D * 390D AS area")
    no_end = SOLVED[:79] + "00"  # two blanks, made unsolvable below
    texts = {0: SAMPLE, 1: SAMPLE, 2: "55" + SAMPLE[2:], 3: SAMPLE[:12] + "0" * 69, 4: SOLVED, 5: SAMPLE[:80], 6: SAMPLE, 8: no_end}
    cells = {i: [int(c) or None for c in t] for i, t in texts.items()}
    cells[6][0] = 77
    cells[8] = [int(c) or None for c in "123456780000000009" + "0" * 63]
    cells[8][30:40] = [1, 2, 3, 4, 5, 6, None, None, None, None]
    drawn = spark.createDataFrame(list(cells.items()), "image_id bigint, glyphs array<bigint>")
    images = spark.range(9).withColumnRenamed("id", "image_id")
    run = PL.run_pipeline(images, [PL.locate(quads, 500, 500), PL.cells_of(drawn), PL.recognise(vectors, "glyph", "vec", "first"),
                                   PL.validate(), PL.solve()], "image_id")
    ends = {r.image_id: (r.stage, (r.reason or "").split(":")[0]) for r in run.outcomes("image_id").collect()}
    assert ends == {
        0: ("locate", "No grid was found"), 1: (None, ""), 2: ("validate", "Invalid puzzle"), 3: ("validate", "At least 17 clues are needed"),
        4: (None, ""), 5: ("cells", "The grid has not 81 cells"), 6: ("recognise", "A cell has no image"), 7: ("cells", "The grid has not 81 cells"),
        8: ends[8],
    }
    assert ends[8][0] in ("validate", "solve")
    assert {r.image_id: r.solution for r in run.kept.collect()} == {1: SOLVED, 4: SOLVED}
    confs = run.kept.where("image_id = 1").first().confs
    assert confs == [0.9 if c != "0" else 1.0 for c in SAMPLE]


@pytest.mark.parametrize("few", [100_000, 0])
def test_a_vector_is_read_once_however_many_cells_show_it(spark, monkeypatch, few):
    """Readings sent to the images, or joined to their cells: equal results; NULL is an empty cell, 77 has no vector, 9 has two."""
    R.register_recognizer("first", lambda: lambda x: (x[:, 0].astype(int), x[:, 1]))
    rows, recognize = [], R.recognize

    def counted(df, *more, **named):
        rows.append(df.count())
        return recognize(df, *more, **named)

    monkeypatch.setattr(R, "recognize", counted)
    monkeypatch.setattr(PL, "FEW_VECTORS", few, raising=False)
    known = [(d, [float(d), d / 10]) for d in range(1, 10)] + [(9, [9.0, 0.95]), (10, None), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(known, "glyph bigint, vec array<double>")
    cells = {i: [int(c) or None for c in SAMPLE] for i in range(6)}
    cells[4][0], cells[5] = 77, [None] * 80 + [10]
    images = spark.createDataFrame(list(cells.items()), "image_id bigint, glyphs array<bigint>").repartition(3)
    out = {r.image_id: r for r in PL.recognise(vectors, "glyph", "vec", "first").work(images).collect()}
    assert rows and max(rows) <= len(known)
    assert [out[i].refused for i in range(6)] == [None] * 4 + ["A cell has no image"] * 2
    assert out[2].digits == [int(c) for c in SAMPLE] and out[2].confs == [int(c) / 10 if c != "0" else 1.0 for c in SAMPLE]
    assert out[4].digits == [0, *out[2].digits[1:]] and out[5].digits == [0] * 81 and out[5].confs == [1.0] * 81
