"""Puzzle rules and the frontier solver: A1-A3, U2-U8, P19, F4, J17."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE
from gridspark.functions import puzzles as P
from gridspark.operators import solver as S
from gridspark.operators.tables import peer_join

HARD = "800000000003600000070090200050007000000045700000100030001000068008500010090000400"
# Two deadly rectangles blanked out of a full grid: two solutions.
SOLVED = "534678912672195348198342567859761423426853791713924856961537284287419635345286179"


def brute_count(text, limit=10**6):
    """All completions by plain backtracking."""
    grid = [int(ch) for ch in text]
    peers = P.PEERS

    def walk():
        best = None
        for i in range(81):
            if grid[i] == 0:
                options = set(range(1, 10)) - {grid[j] for j in peers[i]}
                if best is None or len(options) < len(best[1]):
                    best = (i, options)
        if best is None:
            return 1
        total = 0
        for d in best[1]:
            grid[best[0]] = d
            total += walk()
            grid[best[0]] = 0
            if total >= limit:
                break
        return total

    return walk()


def test_violations_text(spark, puzzle_rows):
    bad = "55" + SAMPLE[2:9] + "5" + SAMPLE[10:]
    df = puzzle_rows([bad, SAMPLE]).select("puzzle_id", P.violations(F.col("clues")).alias("v")).orderBy("puzzle_id")
    first, second = [r["v"] for r in df.collect()]
    assert second == []
    assert first == [
        "Row 1: duplicate 5 at columns 1 and 2", "Row 2: duplicate 5 at columns 1 and 6",
        "Col 1: duplicate 5 at rows 1 and 2",
        "Box (1,1): duplicate 5", "Box (1,1): duplicate 5",
    ]


def test_triple_cites_the_first(spark, puzzle_rows):
    text = "404040000" + "0" * 72
    v = puzzle_rows([text]).select(P.violations(F.col("clues")).alias("v")).first()["v"]
    assert v[:2] == ["Row 1: duplicate 4 at columns 1 and 3", "Row 1: duplicate 4 at columns 1 and 5"]
    assert v[2:] == ["Box (1,1): duplicate 4"]


def test_valid_and_solution(spark, puzzle_rows):
    swapped = SOLVED[1] + SOLVED[0] + SOLVED[2:]
    rows = puzzle_rows([SAMPLE, SOLVED, swapped, "0" * 81]).select(
        P.is_valid_grid(F.col("clues")).alias("valid"), P.is_solution(F.col("clues")).alias("done")
    ).collect()
    assert [(r.valid, r.done) for r in rows] == [(True, False), (True, True), (False, False), (True, False)]


def test_relabel_and_transpose_keep_validity(spark, puzzle_rows):
    digits = dict(zip("0123456789", "0938472615"))
    relabelled = "".join(digits[ch] for ch in SAMPLE)
    transposed = "".join(SAMPLE[9 * c + r] for r in range(9) for c in range(9))
    got = S.solution_count(puzzle_rows([SAMPLE, relabelled, transposed])).collect()
    assert {r["solutions"] for r in got} == {1} and all(r["is_unique"] for r in got)


def test_known_puzzles(spark, puzzle_rows):
    got = {r["puzzle_id"]: r for r in S.solve_batch(puzzle_rows([SAMPLE, HARD, SOLVED, SAMPLE])).collect()}
    assert got[0]["solution"] == SOLVED and got[2]["solution"] == SOLVED and got[3]["solution"] == SOLVED
    answer = got[1]["solution"]
    assert S.candidate_masks(S.to_array([answer]))[1][0] and "0" not in answer
    assert all(c in ("0", a) for c, a in zip(HARD, answer))


def test_contradiction_and_full_grid_with_repeats(spark, puzzle_rows):
    # Cell 8 of row 1 has no candidate left.
    dead = "123456780" + "000000009" + "0" * 63
    repeated = "5" * 81
    got = [r["solved"] for r in S.solve_batch(puzzle_rows([dead, repeated])).orderBy("puzzle_id").collect()]
    assert got == [False, False]


def test_empty_grid_is_solved_and_budget_is_reported(spark, puzzle_rows):
    df = puzzle_rows(["0" * 81, SAMPLE])
    free = {r["puzzle_id"]: r for r in S.solve_batch(df).collect()}
    assert free[0]["solved"] and S.candidate_masks(S.to_array([free[0]["solution"]]))[1][0]
    tight = {r["puzzle_id"]: r for r in S.solve_batch(df, steps=1, max_rounds=1).collect()}
    assert not tight[0]["solved"] and tight[0]["timed_out"]
    capped = {r["puzzle_id"]: r for r in S.solve_batch(df, steps=1, max_states=3).collect()}
    assert capped[0]["timed_out"] and capped[1]["solved"]


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_brute_force(spark, puzzle_rows, seed):
    rng = random.Random(seed)
    texts = []
    for blanks in (40, 48, 52, 55):
        cells = list(SOLVED)
        for i in rng.sample(range(81), blanks):
            cells[i] = "0"
        texts.append("".join(cells))
    got = S.solution_count(puzzle_rows(texts), steps=4).orderBy("puzzle_id").collect()
    assert [r["solutions"] for r in got] == [brute_count(t) for t in texts]
    assert all(r["complete"] for r in got)


def test_narrowing_never_loses_a_solution():
    rng = random.Random(5)
    for _ in range(50):
        cells = list(SOLVED)
        for i in rng.sample(range(81), rng.randint(10, 60)):
            cells[i] = "0"
        grids, masks, dead = S.narrow(S.to_array(["".join(cells)]))
        want = np.array([int(ch) for ch in SOLVED])
        assert not dead[0]
        if (grids[0] > 0).all() or brute_count("".join(cells), 2) == 1:
            assert ((grids[0] == 0) | (grids[0] == want)).all()


def test_candidates_singles_and_branch_cell(spark, puzzle_rows):
    df = puzzle_rows([SAMPLE])
    masks = S.with_candidates(df).first()["masks"]
    for i, ch in enumerate(SAMPLE):
        want = 0 if ch != "0" else sum(1 << (d - 1) for d in set(range(1, 10)) - {int(SAMPLE[j]) for j in P.PEERS[i]})
        assert masks[i] == want
    best = S.tightest_cells(df).first()
    counts = [(bin(m).count("1"), i) for i, m in enumerate(masks) if SAMPLE[i] == "0"]
    assert (best["n"], best["idx"]) == min(counts)
    filled = S.fill_naked_singles(df).first()
    assert filled["n"] == sum(1 for n, _ in counts if n == 1)
    full = S.tightest_cells(puzzle_rows([SOLVED])).first()
    assert (full["idx"], full["n"]) == (-1, -1)


def test_gate(spark, puzzle_rows):
    sparse = SAMPLE[:4] + "0" * 77
    got = {r["puzzle_id"]: r for r in S.solve_gate(puzzle_rows([SAMPLE, "55" + SAMPLE[2:], sparse])).collect()}
    assert got[0]["success"] and got[0]["solution"] == SOLVED
    assert got[1]["message"].startswith("Invalid puzzle: Row 1: duplicate 5 at columns 1 and 2;")
    assert not got[2]["success"] and "17" in got[2]["message"]


def test_units_and_peers(spark, puzzle_rows):
    df = puzzle_rows([SAMPLE])
    assert P.explode_units(df, "clues", "puzzle_id").count() == 243
    cells = df.select("puzzle_id", F.posexplode("clues").alias("idx", "digit"))
    peers = peer_join(cells, "puzzle_id")
    assert peers.count() == 81 * 20
    assert peers.groupBy("idx").count().filter("count <> 20").isEmpty()


HARD = "800000000003600000070090200050007000000045700000100030001000068008500010090000400"


def test_gate_and_batch_agree_on_a_spent_budget(puzzle_rows):
    """A search cut off by its budget is told apart from a puzzle without a solution."""
    rows = puzzle_rows([HARD, SAMPLE])
    gate = {r["puzzle_id"]: r for r in S.solve_gate(rows, steps=1, max_rounds=1).collect()}
    batch = {r["puzzle_id"]: r for r in S.solve_batch(rows, steps=1, max_rounds=1).collect()}
    assert batch[0]["timed_out"] and gate[0]["timed_out"] and gate[0]["message"] == S.TIMED_OUT
    assert all(gate[k]["timed_out"] == batch[k]["timed_out"] and gate[k]["success"] == batch[k]["solved"] for k in gate)
    whole = {r["puzzle_id"]: r for r in S.solve_gate(rows).collect()}
    assert all(r["success"] and not r["timed_out"] for r in whole.values())


def test_candidates_equal_the_array_search(puzzle_rows):
    rows = puzzle_rows([HARD, SAMPLE, "0" * 81])
    for row in S.with_candidates(rows).collect():
        text = "".join(map(str, row["clues"]))
        assert row["masks"] == S.candidate_masks(S.to_array([text]))[0][0].tolist()


@pytest.mark.parametrize("seed", [3, 4])
def test_two_witnesses_equal_the_count(puzzle_rows, seed):
    """Unique exactly if one solution exists; also for grids whose solutions nobody could enumerate."""
    rng = random.Random(seed)
    texts = ["0" * 81, SAMPLE, "5" * 81, SAMPLE[:8] + "0" * 73]
    for blanks in (40, 48, 52, 56):
        cells = list(SOLVED)
        for i in rng.sample(range(81), blanks):
            cells[i] = "0"
        texts.append("".join(cells))
    got = S.unique_solution(puzzle_rows(texts), steps=4).orderBy("puzzle_id").collect()
    for text, row in zip(texts, got):
        n = brute_count(text, 2) if S.candidate_masks(S.to_array([text]))[1][0] else 0
        assert (row["is_unique"], row["complete"]) == (n == 1, True)
        assert (row["least"] == row["greatest"], row["least"] == "") == (n < 2, n == 0)
        for answer in (row["least"], row["greatest"]):
            assert n == 0 or all(c in ("0", a) for c, a in zip(text, answer)) and "0" not in answer
    tight = {r["puzzle_id"]: r for r in S.unique_solution(puzzle_rows([HARD, SAMPLE]), steps=1, max_rounds=1).collect()}
    assert tight[0]["is_unique"] is None and not tight[0]["complete"]


def test_few_verdicts_are_sent_and_many_are_joined(puzzle_rows, monkeypatch):
    rows = puzzle_rows([SAMPLE, SOLVED, SAMPLE, SAMPLE[:12] + "0" * 69, "55" + SAMPLE[2:]])
    found, plans = [], []
    for few in (50_000, 3):
        monkeypatch.setattr(S, "FEW_GRIDS", few)
        gate = S.solve_gate(rows)
        plans.append("broadcast" in gate._jdf.queryExecution().optimizedPlan().toString())
        found.append(sorted(map(tuple, gate.collect())))
    assert plans == [True, False] and found[0] == found[1] and len(found[0]) == 5
