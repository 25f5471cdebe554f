"""Readers for annotation, label, manifest, outline, image and experiment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.cells import basename, grid_error, stem
from gridspark.functions.geometry import OUTER_POINTS

IMAGE_PATTERN = r"\.(jpeg|jpg|png|webp)$"

ANNOTATION_SCHEMA = (
    "images array<struct<path:string,corners_16:array<array<double>>,grid:array<array<string>>>>"
)
EXPERIMENT_SCHEMA = (
    "protocol map<string,string>, results array<struct<name:string,depth:int,channels:array<int>,"
    "dropout:double,parameters:bigint,best_val_acc:double,synthetic_test_acc:double,"
    "real_filled_acc:double,real_empty_acc:double,epochs_run:int,train_time_s:double>>"
)
HISTORY_SCHEMA = (
    "best_epoch int, best_val_acc double, test_acc double, history struct<train_loss:array<double>,"
    "train_acc:array<double>,val_loss:array<double>,val_acc:array<double>,lr:array<double>>"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell_values(text: Column) -> Column:
    """'5' or '[1,7]' as written in the file -> array<int>."""
    return F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",").cast("array<int>")


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(path, points, outer, cells): one row per image, every cell a set of digits.

    A document that spans lines is read by one task; large collections should hold one
    document per line (``multi_line=False``), which splits.
    """
    image = (
        spark.read.schema(ANNOTATION_SCHEMA).option("multiLine", multi_line).json(path)
        .select(F.explode("images").alias("i")).select("i.*")
    )
    points = F.transform(
        "corners_16", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    )
    return image.select(
        "path",
        points.alias("points"),
        F.transform(F.flatten("grid"), _cell_values).alias("cells"),
    ).withColumn("outer", F.array(*[F.get("points", F.lit(i)) for i in OUTER_POINTS]))


def read_label_files(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """(stem, phone, resolution, depth, filetype, grid).

    Line 1 is the device, line 2 ``WxH: depth TYPE``, then rows of nine integers. Other
    rows are skipped and a short grid is padded with blank rows.
    """
    text = F.regexp_replace("value", r"\r", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    at = lambda array, i: F.coalesce(F.try_element_at(array, F.lit(i)), F.lit(""))
    header = F.split(F.trim(F.regexp_replace(at(F.col("lines"), 2), r"[:\s]+", " ")), " ")
    rows = F.transform(
        F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))),
        lambda s: F.transform(F.split(s, r"\s+"), lambda t: t.try_cast("int")),
    )
    good = F.filter(rows, lambda r: (F.size(r) == 9) & ~F.exists(r, lambda v: v.isNull()))
    blank = F.array_repeat(F.array_repeat(F.lit(0), 9), 9)
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
        .select(stem(F.col("_metadata.file_path")).alias("stem"), lines.alias("lines"))
        .select(
            "stem",
            at(F.col("lines"), 1).alias("phone"),
            at(header, 1).alias("resolution"),
            at(header, 2).alias("depth"),
            at(header, 3).alias("filetype"),
            F.slice(F.concat(good, blank), 1, 9).alias("grid"),
        )
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, stem) of every non-blank line."""
    name = basename(F.trim("value"))
    return (
        spark.read.text(path).filter(F.trim("value") != "")
        .select(name.alias("name"), stem(name).alias("stem"))
    )


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(name, outline): rows with a bad number are dropped, the last row of a file wins."""
    axes = [f"p{i}_{a}" for i in range(1, 5) for a in "xy"]
    schema = "filepath string, " + ", ".join(f"{a} string" for a in axes)
    raw = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
        .select("*", F.struct(
            "_metadata.file_path", "_metadata.file_block_start",
            F.monotonically_increasing_id().alias("row"),
        ).alias("_place"))
    )
    numbers = F.array(*[F.col(a).try_cast("double") for a in axes])
    corners = F.array(*[
        F.struct(F.col("n")[2 * i].alias("x"), F.col("n")[2 * i + 1].alias("y")) for i in range(4)
    ])
    return (
        raw.select(basename(F.col("filepath")).alias("name"), numbers.alias("n"), "_place")
        .filter(~F.exists("n", lambda v: v.isNull()))
        .groupBy("name").agg(F.max_by("n", "_place").alias("n"))
        .select("name", corners.alias("outline"))
    )


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of image files. The bytes are never read: the column is pruned."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .filter(F.lower("path").rlike(IMAGE_PATTERN))
        .select("path", basename(F.col("path")).alias("name"), "length")
    )


def scan_labelled_dirs(spark: SparkSession, root: str) -> DataFrame:
    """(path, digit, group_id) from ``SampleNNN/imgCCC-IIIII.png``; digit 0 is left out."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.png").load(root)
    )
    sample = F.regexp_extract("path", r"/Sample(\d{3})/[^/]*$", 1).try_cast("int")
    group = F.regexp_extract("path", r"-(\d+)\.png$", 1).try_cast("int")
    return files.select("path", (sample - 1).alias("digit"), group.alias("group_id")).filter(
        "digit BETWEEN 1 AND 9 AND group_id IS NOT NULL"
    )


def read_experiments(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per configuration of results files."""
    return (
        spark.read.schema(EXPERIMENT_SCHEMA).option("multiLine", multi_line).json(path)
        .selectExpr("inline(results)")
    )


def history_long(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, train_loss, train_acc, val_loss, val_acc, lr): one row per epoch."""
    metrics = ["train_loss", "train_acc", "val_loss", "val_acc", "lr"]
    zipped = F.arrays_zip(*[F.col(f"history.{m}").alias(m) for m in metrics])
    return (
        spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).json(path)
        .select(stem(F.col("_metadata.file_path")).alias("run"), F.posexplode(zipped).alias("i", "m"))
        .select("run", (F.col("i") + 1).alias("epoch"), "m.*")
    )


def split_valid(df: DataFrame, grid: str = "grid") -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, quarantined rows with their first error)."""
    checked = df.withColumn("error", grid_error(F.col(grid)))
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")
