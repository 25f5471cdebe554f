"""Rules of 9x9 constraint puzzles on ``array<int>`` columns of 81 row-major cells.

A unit is a row, column or box. Each digit owns four bits of a BIGINT, so the sum over a
unit counts every digit at once (a count is at most nine and never carries).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.binding import int_matrix, let

ROWS = [[9 * i + j for j in range(9)] for i in range(9)]
COLUMNS = [[9 * i + j for i in range(9)] for j in range(9)]
BOXES = [
    [9 * (3 * (b // 3) + k // 3) + 3 * (b % 3) + k % 3 for k in range(9)] for b in range(9)
]
UNITS = ROWS + COLUMNS + BOXES
PEERS = [
    sorted({j for unit in UNITS if i in unit for j in unit} - {i}) for i in range(81)
]
UNIT_TYPES = ["row"] * 9 + ["col"] * 9 + ["box"] * 9

REPEATED = 0xEEEEEEEEE0  # some digit 1-9 counted twice or more
COMPLETE = 0x1111111110  # every digit 1-9 counted exactly once


def unit_counts(grid: Column) -> Column:
    """27 packed digit counts: rows, then columns, then boxes."""
    nibbles = F.transform(
        grid, lambda d: F.call_function("shiftleft", F.lit(1).cast("bigint"), d * 4)
    )
    return let(
        F.struct(nibbles.alias("n"), int_matrix(UNITS).alias("u")),
        lambda s: F.transform(
            s["u"],
            lambda cells: F.aggregate(
                cells, F.lit(0).cast("bigint"), lambda acc, i: acc + s["n"][i]
            ),
        ),
    )


def is_valid_grid(grid: Column) -> Column:
    """No digit appears twice in a unit; blanks are ignored."""
    return F.forall(unit_counts(grid), lambda m: m.bitwiseAND(F.lit(REPEATED)) == 0)


def is_solution(grid: Column) -> Column:
    """Every unit holds each of 1-9 exactly once."""
    return F.forall(unit_counts(grid), lambda m: m == F.lit(COMPLETE))


def violations(grid: Column) -> Column:
    """One message per repeated digit, rows before columns before boxes."""
    def unit_messages(digits: Column, u: Column) -> Column:
        def message(d: Column, k: Column) -> Column:
            first = F.array_position(digits, d)
            number = u % 9
            text = (
                F.when(
                    u < 9,
                    F.format_string(
                        "Row %d: duplicate %d at columns %d and %d", number + 1, d, first, k + 1
                    ),
                )
                .when(
                    u < 18,
                    F.format_string(
                        "Col %d: duplicate %d at rows %d and %d", number + 1, d, first, k + 1
                    ),
                )
                .otherwise(
                    F.format_string(
                        "Box (%d,%d): duplicate %d",
                        (number / 3).cast("int") + 1, number % 3 + 1, d,
                    )
                )
            )
            return F.when((d != 0) & (first <= k), text)

        return F.filter(F.transform(digits, message), lambda m: m.isNotNull())

    units = let(
        F.struct(grid.alias("g"), int_matrix(UNITS).alias("u")),
        lambda s: F.transform(s["u"], lambda cells: F.transform(cells, lambda i: s["g"][i])),
    )
    return F.flatten(F.transform(units, unit_messages))


def conflicting_units(grid: Column) -> Column:
    """array<struct<type,unit>> of the units that hold a repeat, each named once."""
    names = F.expr("array(" + ",".join(f"'{t}'" for t in UNIT_TYPES) + ")")
    tagged = let(
        names,
        lambda n: F.transform(
            unit_counts(grid),
            lambda m, u: F.when(
                m.bitwiseAND(F.lit(REPEATED)) != 0,
                F.struct(n[u].alias("type"), (u % 9).alias("unit")),
            ),
        ),
    )
    return F.filter(tagged, lambda t: t.isNotNull())


def grid_text(grid: Column) -> Column:
    """81 digits as one string: the compact form used for keys and shuffles."""
    return F.array_join(grid.cast("array<string>"), "")


def grid_cells(text: Column) -> Column:
    """81 digits back to an array; NULL for any other length."""
    digits = F.slice(F.split(text, ""), 1, 81).cast("array<int>")
    return F.when(F.length(text) == 81, digits)


def agrees_with_clues(clues: Column, solution: Column) -> Column:
    return F.forall(F.zip_with(clues, solution, lambda c, s: (c == 0) | (c == s)), lambda b: b)


def peer_digits(grid: Column, at: Column) -> Column:
    """Of every position in ``at``: idx, its peers that are filled, and the sum of their digits."""
    return let(
        F.struct(grid.alias("n"), int_matrix(PEERS).alias("p")),
        lambda s: F.transform(at, lambda i: let(
            F.transform(s["p"][i], lambda j: s["n"][j]),
            lambda digits: F.struct(
                i.alias("idx"), F.size(F.filter(digits, lambda d: d != 0)).alias("filled"),
                F.aggregate(digits, F.lit(0), lambda acc, d: acc + d).alias("total"),
            ),
        )),
    )


def explode_units(df, grid: str, key: str):
    """One row per (unit type, unit, position) of each puzzle: 27 x 9 rows."""
    layout = F.expr(
        "array("
        + ",".join(
            f"struct('{t}' AS unit_type, {u % 9} AS unit, {k} AS pos, {i} AS idx)"
            for u, (t, cells) in enumerate(zip(UNIT_TYPES, UNITS))
            for k, i in enumerate(cells)
        )
        + ")"
    )
    return (
        df.select(key, grid, F.explode(layout).alias("cell"))
        .select(key, "cell.unit_type", "cell.unit", "cell.pos", "cell.idx",
                F.col(grid)[F.col("cell.idx")].alias("digit"))
    )
