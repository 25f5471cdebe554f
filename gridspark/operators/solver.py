"""Batch solving as a frontier of partial grids.

The frontier is a table of ``(grid, state)``: the puzzle and one partial assignment of it.
A round sends the frontier through ``mapInPandas``; each task narrows all its states at
once with array arithmetic and follows every state for a bounded number of steps. What is
still open comes back as rows, is checkpointed and spread over the cluster again, so one
hard puzzle becomes work for many tasks instead of a straggler.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import cells, puzzles
from gridspark.functions.binding import int_matrix, let
from gridspark.operators.scoring import clues_right
from gridspark.operators.tables import distinct_first
from gridspark.session import materialise

_UNITS = np.array(puzzles.UNITS)
_UNIT_OF = np.array([[i // 9, 9 + i % 9, 18 + (i // 27) * 3 + i % 9 // 3] for i in range(81)])
_POPCOUNT = np.array([bin(m).count("1") for m in range(512)], dtype=np.int8)
_DIGIT_OF = np.zeros(512, dtype=np.int8)
for _d in range(9):
    _DIGIT_OF[1 << _d] = _d + 1
_ALL = np.int16(511)


# --- numpy kernels over a batch of states -----------------------------------

def to_array(states) -> np.ndarray:
    """81-character strings to an (n, 81) array of digits."""
    text = "".join(states).encode("ascii")
    return (np.frombuffer(text, dtype=np.uint8) - 48).reshape(-1, 81).astype(np.int8)


def to_text(grids: np.ndarray) -> list[str]:
    raw = (grids.astype(np.uint8) + 48).tobytes().decode("ascii")
    return [raw[i : i + 81] for i in range(0, len(raw), 81)]


def candidate_masks(grids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidates per cell as a 9-bit mask, zero for filled cells; grid has no repeat)."""
    bits = np.where(grids > 0, np.left_shift(1, grids.astype(np.int16) - 1, where=grids > 0,
                                             out=np.zeros(grids.shape, np.int16)), 0)
    by_unit = bits[:, _UNITS]
    used = np.bitwise_or.reduce(by_unit, axis=2)
    valid = (_POPCOUNT[used] == (by_unit > 0).sum(axis=2)).all(axis=1)
    taken = np.bitwise_or.reduce(used[:, _UNIT_OF], axis=2)
    return np.where(grids == 0, _ALL & ~taken, 0).astype(np.int16), valid


def narrow(grids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fill forced cells until nothing changes: (grids, candidates, dead).

    Forced means a single candidate in the cell, or a single cell of a unit for a digit.
    """
    grids = grids.copy()
    masks, valid = candidate_masks(grids)
    dead = ~valid | ((grids == 0) & (masks == 0)).any(axis=1)
    moving = ~dead
    while moving.any():
        rows = np.flatnonzero(moving)
        mask = masks[rows]
        forced = np.where(_POPCOUNT[mask] == 1, mask, 0)
        in_unit = mask[:, _UNITS]
        seen = np.zeros(in_unit.shape[:2], np.int16)
        twice = np.zeros_like(seen)
        for k in range(9):
            twice |= seen & in_unit[:, :, k]
            seen |= in_unit[:, :, k]
        once = seen & ~twice
        lone = mask & np.bitwise_or.reduce(once[:, _UNIT_OF], axis=2)
        forced = np.where((forced == 0) & (_POPCOUNT[lone] == 1), lone, forced)
        # A cell that two digits claim has no filling at all.
        clash = (_POPCOUNT[lone] > 1).any(axis=1)
        changed = (forced > 0).any(axis=1) & ~clash
        dead[rows[clash]] = True
        rows, forced = rows[changed], forced[changed]
        moving[:] = False
        if len(rows) == 0:
            break
        grids[rows] = np.where(forced > 0, _DIGIT_OF[forced], grids[rows])
        masks[rows], valid = candidate_masks(grids[rows])
        broken = ~valid | ((grids[rows] == 0) & (masks[rows] == 0)).any(axis=1)
        dead[rows[broken]] = True
        moving[rows[~broken]] = True
    return grids, masks, dead


def tightest_cell(grids: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Blank cell with the fewest candidates, first in row-major order; -1 on a full grid."""
    count = np.where(grids == 0, _POPCOUNT[masks], 10)
    best = count.argmin(axis=1)
    return np.where(count[np.arange(len(grids)), best] == 10, -1, best)


def _branches(grid: np.ndarray, mask: np.ndarray, cell: int) -> list[np.ndarray]:
    """Children of a state, the largest digit first so that the smallest is popped first."""
    out = []
    for d in range(9, 0, -1):
        if mask[cell] >> (d - 1) & 1:
            child = grid.copy()
            child[cell] = d
            out.append(child)
    return out


def search(states: np.ndarray, steps: int, enough: int | None):
    """Follow each state for at most ``steps`` steps; yields (row, solved grid or open state, done).

    A state that gave ``enough`` solutions is left alone; None asks for all. The result of a state depends on
    that state alone, so it is the same in any batch.
    """
    stacks: dict[int, list[np.ndarray]] = {i: [s] for i, s in enumerate(states)}
    given: dict[int, int] = {}
    for _ in range(steps):
        if not stacks:
            return
        owners = list(stacks)
        grids, masks, dead = narrow(np.stack([stacks[o].pop() for o in owners]))
        cells = tightest_cell(grids, masks)
        for k, owner in enumerate(owners):
            if not dead[k]:
                if cells[k] < 0:
                    yield owner, grids[k], True
                    given[owner] = given.get(owner, 0) + 1
                    if given[owner] == enough:
                        stacks[owner] = []
                else:
                    stacks[owner] += _branches(grids[k], masks[k], cells[k])
            if not stacks[owner]:
                del stacks[owner]
    for owner, stack in stacks.items():
        for state in stack:
            yield owner, state, False


def _advance(steps: int, enough: int | None, chunk: int = 4096):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk]
                keys = part["grid"].to_numpy()
                moves = search(to_array(part["state"]), steps, enough)
                while found := list(itertools.islice(moves, BLOCK)):
                    yield pd.DataFrame({
                        "grid": keys[[f[0] for f in found]],
                        "state": to_text(np.stack([f[1] for f in found])),
                        "done": [f[2] for f in found],
                    })

    return run


BLOCK = 16_384  # grids that leave a task in one batch
MAX_STEPS = 1_024  # steps of a state in one round at most
FEW_GRIDS = 50_000  # distinct grids whose verdicts are sent to every task, about 200 bytes each
TIMED_OUT = "The search ran out of its budget."


# --- Spark operators --------------------------------------------------------

def _rounds(start: DataFrame, enough: int | None, steps: int, max_rounds: int | None,
            max_states: int | None):
    """Run the frontier; returns (found, open) where open holds what the budget left over.

    A grid leaves once ``enough`` solutions of it are known; branches never overlap, so each is another one.
    """
    frontier = start
    found: DataFrame | None = None
    number = 0
    dropped: DataFrame | None = None
    while max_rounds is None or number < max_rounds:
        number += 1
        moved = materialise(
            frontier.mapInPandas(_advance(steps, enough), "grid string, state string, done boolean")
        )
        hits = moved.filter("done").select("grid", "state")
        found = hits if found is None else found.unionByName(hits)
        frontier = moved.filter("NOT done").select("grid", "state")
        if enough is not None:
            known = found.groupBy("grid").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
            frontier = frontier.join(known.select("grid"), "grid", "left_anti")
        if max_states is not None:
            big = frontier.groupBy("grid").count().filter(F.col("count") > max_states).select("grid")
            over = materialise(frontier.join(big, "grid", "left_semi").select("grid").distinct())
            dropped = over if dropped is None else dropped.unionByName(over)
            frontier = frontier.join(over, "grid", "left_anti")
        # Spread the open states by state, not by puzzle: one puzzle may own most of them.
        frontier = frontier.repartition("state")
        if frontier.isEmpty():
            break
        # Longer rounds save shuffles; the ceiling keeps a task's length and its stacks bounded.
        steps = min(2 * steps, MAX_STEPS)
    left = frontier.select("grid").distinct()
    if dropped is not None:
        left = left.unionByName(dropped).distinct()
    return found, left


def distinct_grids(puzzles_df: DataFrame, grid: str) -> DataFrame:
    """Each grid once, as text; copies collapse before the shuffle."""
    return puzzles_df.select(puzzles.grid_text(F.col(grid)).alias("grid")).distinct()


def solve_grids(
    grids: DataFrame, steps: int = 64, max_rounds: int | None = None, max_states: int | None = None
) -> DataFrame:
    """(grid, solution, timed_out) for a table of distinct grid texts.

    ``solution`` is NULL where none was found.
    """
    found, left = _rounds(
        grids.select("grid", F.col("grid").alias("state")), 1, steps, max_rounds, max_states
    )
    answers = found.groupBy("grid").agg(F.min("state").alias("solution"))
    open_grids = left.select("grid", F.lit(True).alias("_open"))
    return (
        grids.select("grid").join(answers, "grid", "left").join(open_grids, "grid", "left")
        .select(
            "grid", "solution",
            (F.col("solution").isNull() & F.coalesce("_open", F.lit(False))).alias("timed_out"),
        )
    )


def with_verdict(texts: DataFrame, verdict: DataFrame, grids: DataFrame, on: str = "grid") -> DataFrame:
    """``texts`` with what ``verdict`` says of their grid in ``on``, which goes; it has a row at most for each of the written ``grids``.

    Few rows go to all texts, which then stay where they are.
    """
    few = grids.limit(FEW_GRIDS + 1).count() <= FEW_GRIDS
    return texts.join(F.broadcast(verdict) if few else verdict, on).drop(on)


def _back_to_puzzles(puzzles_df: DataFrame, key: str, grid: str, verdict: DataFrame, grids: DataFrame) -> DataFrame:
    return with_verdict(puzzles_df.select(key, puzzles.grid_text(F.col(grid)).alias("grid")), verdict, grids)


def solve_batch(
    puzzles_df: DataFrame,
    key: str = "puzzle_id",
    grid: str = "clues",
    steps: int = 64,
    max_rounds: int | None = None,
    max_states: int | None = None,
) -> DataFrame:
    """(key, solved, timed_out, solution as 81 digits).

    Equal grids are solved once. A grid with several solutions gets the smallest of those
    found in its first successful round, the same on every run. With a budget, grids still
    open at its end are marked ``timed_out``; without one the search is complete.
    """
    grids = materialise(distinct_grids(puzzles_df, grid))
    verdict = solve_grids(grids, steps, max_rounds, max_states).select(
        "grid", F.col("solution").isNotNull().alias("solved"), "timed_out",
        F.coalesce("solution", F.lit("")).alias("solution"),
    )
    return _back_to_puzzles(puzzles_df, key, grid, verdict, grids)


def solution_count(
    puzzles_df: DataFrame,
    key: str = "puzzle_id",
    grid: str = "clues",
    steps: int = 64,
    max_rounds: int | None = None,
    max_states: int | None = None,
) -> DataFrame:
    """(key, solutions, is_unique, complete): all solutions counted unless a budget ran out."""
    grids = materialise(distinct_grids(puzzles_df, grid))
    found, left = _rounds(
        grids.select("grid", F.col("grid").alias("state")), None, steps, max_rounds, max_states
    )
    # Branches never overlap, so every solution arrives exactly once.
    counts = found.groupBy("grid").agg(F.count("*").alias("_n"))
    unfinished = left.select("grid", F.lit(True).alias("_open"))
    solutions = F.coalesce("_n", F.lit(0)).cast("bigint")
    complete = F.col("_open").isNull()
    verdict = (
        grids.join(counts, "grid", "left").join(unfinished, "grid", "left")
        .select(
            "grid", solutions.alias("solutions"),
            ((solutions == 1) & complete).alias("is_unique"), complete.alias("complete"),
        )
    )
    return _back_to_puzzles(puzzles_df, key, grid, verdict, grids)


def unique_solution(
    puzzles_df: DataFrame,
    key: str = "puzzle_id",
    grid: str = "clues",
    steps: int = 64,
    max_rounds: int | None = None,
    max_states: int | None = None,
) -> DataFrame:
    """(key, is_unique, least, greatest, complete): uniqueness by two witnesses instead of a count.

    Every grid is searched until two solutions are known or none is left to look for; ``least`` and
    ``greatest`` are the smaller and the larger of those found, and the puzzle is well formed exactly if they
    are equal. An empty grid ends as soon as it has two. ``complete`` is false only where a budget ended
    the search before it could tell; ``is_unique`` is then NULL. Unsolvable grids have no witnesses.
    """
    grids = materialise(distinct_grids(puzzles_df, grid))
    found, left = _rounds(
        grids.select("grid", F.col("grid").alias("state")), 2, steps, max_rounds, max_states
    )
    # A round may find more than two; the witnesses are those of all that it found, the same on every run.
    seen = found.groupBy("grid").agg(F.min("state").alias("least"), F.max("state").alias("greatest"))
    unfinished = left.select("grid", F.lit(True).alias("_open"))
    two = F.coalesce(F.col("least") < F.col("greatest"), F.lit(False))
    complete = F.col("_open").isNull() | two
    verdict = (
        grids.join(seen, "grid", "left").join(unfinished, "grid", "left")
        .select(
            "grid", F.when(complete, F.col("least").isNotNull() & ~two).alias("is_unique"),
            F.coalesce("least", F.lit("")).alias("least"), F.coalesce("greatest", F.lit("")).alias("greatest"),
            complete.alias("complete"),
        )
    )
    return _back_to_puzzles(puzzles_df, key, grid, verdict, grids)


def with_candidates(puzzles_df: DataFrame, grid: str = "clues") -> DataFrame:
    """Add ``masks``: 81 nine-bit candidate sets, zero for filled cells. No shuffle and no Python."""
    bits = F.transform(F.col(grid), lambda d: F.when(d > 0, F.call_function("shiftleft", F.lit(1), d.cast("int") - 1)).otherwise(0))
    masks = let(
        F.struct(F.col(grid).alias("g"), bits.alias("b"), int_matrix(puzzles.UNITS).alias("u")),
        lambda s: let(
            F.struct(s["g"].alias("g"), F.transform(
                s["u"], lambda unit: F.aggregate(unit, F.lit(0), lambda acc, i: acc.bitwiseOR(s["b"][i]))).alias("seen")),
            lambda t: F.transform(F.arrays_zip(t["g"].alias("d"), int_matrix(_UNIT_OF.tolist()).alias("of")), lambda cell: F.when(
                cell["d"] == 0,
                F.lit(511).bitwiseAND(F.bitwise_not(t["seen"][cell["of"][0]].bitwiseOR(t["seen"][cell["of"][1]]).bitwiseOR(t["seen"][cell["of"][2]]))),
            ).otherwise(0))))
    return puzzles_df.withColumn("masks", masks)


def tightest_cells(puzzles_df: DataFrame, key: str = "puzzle_id", grid: str = "clues") -> DataFrame:
    """(key, idx, n): the blank cell to branch on; n = 0 is a dead end, idx = -1 a full grid."""
    ranked = F.transform(
        F.arrays_zip(F.col(grid).alias("d"), F.col("masks").alias("m")),
        lambda s, i: F.when(s["d"] == 0, F.struct(F.bit_count(s["m"]).alias("n"), i.alias("idx"))),
    )
    best = F.array_min(F.filter(ranked, lambda s: s.isNotNull()))
    return (
        with_candidates(puzzles_df.select(key, grid), grid)
        .select(key, best.alias("best"))
        .select(
            key,
            F.coalesce("best.idx", F.lit(-1)).alias("idx"),
            F.coalesce("best.n", F.lit(-1)).alias("n"),
        )
    )


def fill_naked_singles(puzzles_df: DataFrame, key: str = "puzzle_id", grid: str = "clues") -> DataFrame:
    """(key, filled, n): one pass that fills every cell with exactly one candidate."""
    fill = F.zip_with(
        F.col(grid),
        F.col("masks"),
        lambda d, m: F.when(
            (d == 0) & (F.bit_count(m) == 1), F.log2(m.cast("double")).cast("int") + 1
        ).otherwise(d),
    )
    filled = with_candidates(puzzles_df.select(key, grid), grid).select(
        key, grid, fill.alias("filled")
    )
    return filled.select(
        key, "filled", (cells.clue_count(F.col("filled")) - cells.clue_count(F.col(grid))).alias("n")
    )


def solve_gate(
    puzzles_df: DataFrame, key: str = "puzzle_id", grid: str = "clues",
    steps: int = 64, max_rounds: int | None = None, max_states: int | None = None,
) -> DataFrame:
    """(key, success, timed_out, message, solution): validate, require the minimum of clues, solve, verify.

    ``message`` follows the solve response: the joined errors of an invalid puzzle, or the
    outcome of the search. A search that its budget ended is ``timed_out`` and says so, because it proves
    nothing about the puzzle. Invalid and sparse puzzles bypass the solver. All of it depends
    on the grid alone, so it is worked out once per distinct grid.
    """
    clues = puzzles.grid_cells(F.col("grid"))
    checked = materialise(
        distinct_grids(puzzles_df, grid).select("grid", clues.alias("clues")).select(
            "grid", "clues", puzzles.is_valid_grid(F.col("clues")).alias("valid"),
            cells.has_min_clues(F.col("clues")).alias("enough"),
        )
    )
    solved = solve_grids(checked.filter("valid AND enough"), steps, max_rounds, max_states)
    success = F.col("solution").isNotNull() & puzzles.is_solution(puzzles.grid_cells(F.col("solution")))
    accepted = solved.select(
        "grid", F.coalesce(success, F.lit(False)).alias("success"), "timed_out", "solution"
    ).select(
        "grid", "success", "timed_out",
        F.when(F.col("success"), "solved").when(F.col("timed_out"), TIMED_OUT)
        .otherwise("Could not find valid solution.").alias("message"),
        F.when(F.col("success"), F.col("solution")).otherwise("").alias("solution"),
    )
    refused = lambda df, message: df.select(
        "grid", F.lit(False).alias("success"), F.lit(False).alias("timed_out"), message.alias("message"),
        F.lit("").alias("solution")
    )
    invalid = refused(
        checked.filter("NOT valid"), cells.invalid_message(puzzles.violations(F.col("clues")))
    )
    sparse = refused(
        checked.filter("valid AND NOT enough"), F.lit(f"At least {cells.MIN_CLUES} clues are needed")
    )
    verdict = accepted.unionByName(invalid).unionByName(sparse)
    return _back_to_puzzles(puzzles_df, key, grid, verdict, checked)


def solve_response(gate: DataFrame, measured: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """(key, success, message, solution, nodes_explored, solve_time_ms): the answer to a solve request.

    ``gate`` is the result of ``solve_gate``, ``measured`` has nodes and elapsed_ms of the searches that ran. Time has
    one decimal, ties to even, in the column and in the message. Puzzles refused before the search have neither.
    """
    refused = F.col("message").startswith("Invalid puzzle") | F.col("message").startswith("At least ")
    time = F.bround("elapsed_ms", 1)
    joined = gate.join(measured.select(key, "nodes", "elapsed_ms"), key, "left")
    return joined.select(
        key, "success", F.when(F.col("success"), cells.solve_message(F.col("nodes"), time)).otherwise(F.col("message")).alias("message"),
        "solution", F.when(~refused, F.col("nodes")).alias("nodes_explored"), F.when(~refused, time).alias("solve_time_ms"),
    )


def showcase(images: DataFrame, key: str, order: str, grid: str, predicted: str, truth: str, n: int) -> DataFrame:
    """(grid text, order, key, solution): the first ``n`` different puzzles fit to be shown.

    Fit are images that are ``detected``, have blanks, whose clues are all read right and
    whose puzzle solves. The cheap gates come first; the solver sees each puzzle once.
    """
    ready = images.filter(
        F.col("detected") & (cells.clue_count(F.col(grid)) < 81) & clues_right(F.col(predicted), F.col(truth))
    ).select(F.col(key), F.col(order).alias("_order"), F.col(grid), puzzles.grid_text(F.col(grid)).alias("_text"))
    first = materialise(ready.groupBy("_text").agg(F.min_by(F.struct(key, "_order", grid), F.struct("_order", key)).alias("r")).select("_text", "r.*"))
    solved = solve_batch(first, "_text", grid).filter("solved").select("_text", "solution")
    return distinct_first(first.join(solved, "_text"), "_text", "_order", n).select(
        F.col("_text").alias("grid"), key, "solution"
    )
