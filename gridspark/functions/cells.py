"""Cell-level projections, predicates, text forms and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.binding import let

# Fixed values.
CONFIDENCE_THRESHOLD = 0.50
EMPTY_THRESHOLD = 0.03
SUSPECT_WHITE_RATIO = 0.15
MIN_CLUES = 17
DIFFICULTY_LEVELS = [(36, "Easy"), (28, "Medium"), (22, "Hard")]
HARDEST_LEVEL = "Expert"
FAMILIES = {16: "small", 32: "medium", 64: "large"}


# --- multi-valued cells -----------------------------------------------------

def coerce_multivalue(cell: Column) -> Column:
    """A cell with several acceptable values becomes blank."""
    return F.when(F.size(cell) > 1, F.lit(0)).otherwise(F.try_element_at(cell, F.lit(1)))


def first_nonzero(cell: Column) -> Column:
    """First non-zero value, 0 without one; plain cells skip the array search."""
    several = F.coalesce(F.try_element_at(F.filter(cell, lambda v: v != 0), F.lit(1)), F.lit(0))
    return F.when(F.size(cell) == 1, F.element_at(cell, 1)).otherwise(several)


def match_any(predicted: Column, cell: Column) -> Column:
    return F.array_contains(cell, predicted)


def is_filled(cell: Column) -> Column:
    """Any non-zero value; digits are 0-9, so the largest tells (and stays in codegen)."""
    return F.array_max(cell) > 0


# --- prediction gates -------------------------------------------------------

def confidence_gate(probs: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """struct(digit, conf, best_digit) over classes 1-9 of a 10-class vector."""
    def pick(digits: Column) -> Column:
        conf = F.array_max(digits)
        best = F.array_position(digits, conf).cast("int")
        return F.struct(
            F.when(conf < threshold, F.lit(0)).otherwise(best).alias("digit"),
            conf.alias("conf"),
            best.alias("best_digit"),
        )

    return let(F.slice(probs, 2, 9), pick)


def is_empty_vector(vec: Column, threshold: float = EMPTY_THRESHOLD) -> Column:
    """Mean intensity below a share of full scale: the cell never reaches a model."""
    total = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.size(vec) < threshold * 255


def white_ratio(vec: Column) -> Column:
    return F.size(F.filter(vec, lambda v: v == 255)) / F.size(vec)


def is_suspect(digit: Column, ratio: Column, empty: Column) -> Column:
    return (digit == 0) & (ratio > SUSPECT_WHITE_RATIO) & ~empty


# --- labels -----------------------------------------------------------------

def clue_count(grid: Column) -> Column:
    return F.size(F.filter(grid, lambda v: v != 0))


def has_min_clues(grid: Column, minimum: int = MIN_CLUES) -> Column:
    return clue_count(grid) >= minimum


def difficulty(clues: Column) -> Column:
    label = F.lit(HARDEST_LEVEL)
    for least, name in reversed(DIFFICULTY_LEVELS):
        label = F.when(clues >= least, F.lit(name)).otherwise(label)
    return label


def confidence_band(digit: Column, conf: Column) -> Column:
    return F.when(
        digit != 0,
        F.when(conf >= 0.8, F.lit("high")).when(conf >= 0.5, F.lit("medium")).otherwise(F.lit("low")),
    ).otherwise(F.lit("none"))


def detector_confidence(area: Column, image_area: Column) -> Column:
    ratio = area / image_area
    return F.when(ratio > 0.05, F.least(F.lit(1.0), ratio / 0.5)).otherwise(F.lit(0.0))


def override(manual: Column, auto: Column) -> tuple[Column, Column]:
    """(value, source): the manual value wins when present."""
    source = F.when(manual.isNotNull(), F.lit("manual")).otherwise(F.lit("auto"))
    return F.coalesce(manual, auto), source


def model_family(channels: Column) -> Column:
    families = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(
        F.try_element_at(families, F.try_element_at(channels, F.lit(1))), F.lit("?")
    )


def blended_accuracy(filled: Column, empty: Column) -> Column:
    return 0.5 * filled + 0.5 * empty


# --- text forms -------------------------------------------------------------

def format_cell(cell: Column) -> Column:
    return (
        F.when(F.size(cell) > 1, F.array_join(cell.cast("array<string>"), "/"))
        .when(F.try_element_at(cell, F.lit(1)) != 0, F.element_at(cell, 1).cast("string"))
        .otherwise(F.lit("."))
    )


def _digit(token: Column) -> Column:
    value = F.trim(token).try_cast("int")
    return F.when(value.between(0, 9), value)


def parse_cell(token: Column) -> Column:
    """'3' -> [3]; '7/1' -> [1,7]; anything malformed -> NULL."""
    parts = F.transform(F.split(token, "/"), _digit)

    def check(values: Column) -> Column:
        unique = F.array_sort(F.array_distinct(values))
        bad = F.exists(values, lambda v: v.isNull())
        return (
            F.when(bad, F.lit(None))
            .when(F.size(values) == 1, values)
            .when(F.size(unique) >= 2, unique)
        )

    return let(parts, check)


def parse_grid_line(line: Column) -> Column:
    """Nine tokens, or a compact nine-character string; NULL when malformed."""
    text = F.trim(line)
    compact = (F.length(text) == 9) & ~text.rlike(r"[\s/]")
    tokens = F.when(compact, F.split(F.regexp_replace(text, "(.)(?=.)", "$1 "), " ")).otherwise(
        F.split(text, r"\s+")
    )
    cells = F.transform(tokens, parse_cell)
    return let(
        cells,
        lambda c: F.when((F.size(c) == 9) & ~F.exists(c, lambda v: v.isNull()), c),
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(
        name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    ).otherwise(name)


def solve_message(nodes: Column, elapsed_ms: Column) -> Column:
    return F.format_string("Solved in %d nodes (%.1fms)", nodes, elapsed_ms)


def invalid_message(errors: Column) -> Column:
    return F.concat(F.lit("Invalid puzzle: "), F.array_join(errors, "; "))


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_short_ts(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, hh:mm a")


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


# --- grid shape -------------------------------------------------------------

def grid_error(grid: Column) -> Column:
    """Text of the first schema violation of a nested 9x9 grid, NULL when well formed."""
    def row_error(row: Column, i: Column) -> Column:
        bad_cells = F.transform(
            row,
            lambda v, j: F.when(
                v.isNull() | ~v.between(0, 9),
                F.format_string("Cell [%d][%d] must be an integer 0-9", i, j),
            ),
        )
        first_bad = F.try_element_at(F.filter(bad_cells, lambda e: e.isNotNull()), F.lit(1))
        wrong_width = row.isNull() | (F.size(row) != 9)
        return F.when(
            wrong_width, F.format_string("Row %d must have exactly 9 columns", i)
        ).otherwise(first_bad)

    errors = F.filter(F.transform(grid, row_error), lambda e: e.isNotNull())
    return F.when(
        grid.isNull() | (F.size(grid) != 9), F.lit("Grid must have exactly 9 rows")
    ).otherwise(F.try_element_at(errors, F.lit(1)))
