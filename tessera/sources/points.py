"""Point files: comma-separated lines, with or without a header, clean or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.logreg import moments, predict, standardised


def tokens(line: Column) -> Column:
    """The non-blank tokens of a line; blank ones go before the width is looked at."""
    return F.filter(F.transform(F.split(line, ","), lambda t: F.trim(t)), lambda t: t != "")


def parse_points(lines: DataFrame, width: int, line: str = "value") -> DataFrame:
    """``features`` (array of doubles) of lines with ``width`` numbers; other lines, a header among them, are dropped."""
    out = lines.select(F.transform(tokens(F.col(line)), lambda t: t.try_cast("double")).alias("features"))
    return out.where((F.size("features") == width) & ~F.exists("features", lambda v: v.isNull()))


def parse_labelled(lines: DataFrame, width: int, line: str = "value") -> DataFrame:
    """``features`` and ``label`` of lines with exactly ``width`` + 1 numbers."""
    parts = F.transform(F.split(F.trim(F.col(line)), ","), lambda t: F.trim(t).try_cast("double"))
    out = lines.select(parts.alias("__v")).where((F.size("__v") == width + 1) & ~F.exists("__v", lambda v: v.isNull()))
    return out.select(F.slice("__v", 1, width).alias("features"), F.element_at("__v", -1).alias("label"))


def width_of(lines: DataFrame, line: str = "value") -> int:
    """Tokens of the first line that is not blank (0 if there is none)."""
    row = lines.where(F.trim(line) != "").select(F.size(tokens(F.col(line))).alias("n")).head(1)
    return row[0]["n"] if row else 0


def sniff_header(lines: DataFrame, line: str = "value") -> tuple[bool, int]:
    """Whether the first line that is not blank has a token that is no number, and its number of tokens."""
    row = lines.where(F.trim(line) != "").select(F.split(line, ",").alias("t")).head(1)
    if not row:
        return False, 0
    found = []
    for t in row[0]["t"]:
        try:
            float(t)
            found.append(True)
        except ValueError:
            found.append(False)
    return not all(found), len(found)


def template_info(lines: DataFrame, line: str = "value") -> dict:
    """Whether a labelled file has a header, its label's name, and whether labels are written as decimals, by its first two lines."""
    info = {"header": True, "label_name": "label", "label_float": False}
    rows = [r[0].strip().split(",") for r in lines.select(line).head(2)]
    if not rows:
        return info
    probe = rows[0]
    try:
        [float(x) for x in rows[0] if x]
        info["header"] = False
    except ValueError:
        info["label_name"] = rows[0][-1]
        probe = rows[1] if len(rows) > 1 else [""]
    return info | {"label_float": "." in probe[-1]}


def read_standardised(spark: SparkSession, path: str, width: int) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Clean labelled points with features less their means by their deviations over all rows, and those figures."""
    points = read_labelled(spark, path, width)
    names = [f"f{i}" for i in range(width)]
    by = moments(points, names)
    return standardised(points, names, by), by


def accuracy_of_head(points: DataFrame, features: list[str], weights, intercept: float, n: int, label: str = "label") -> float | None:
    """The share of right predictions among the first ``n`` rows; None without rows."""
    head = points.limit(n)
    return predict(head, features, weights, intercept).agg(F.avg((F.col("prediction") == F.col(label).cast("double")).cast("int"))).first()[0]


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a file, its width taken from the first line."""
    lines = spark.read.text(path)
    return parse_points(lines, width_of(lines))


def labelled_schema(width: int) -> T.StructType:
    return T.StructType([*(T.StructField(f"f{i}", T.DoubleType()) for i in range(width)), T.StructField("label", T.DoubleType())])


def clean_labelled(df: DataFrame) -> DataFrame:
    """Rows without nulls, the label as an integer; a header read under the schema is all nulls and goes."""
    return df.where("f0 is not null").dropna().withColumn("label", F.col("label").cast("int"))


def read_labelled(spark: SparkSession, path: str, width: int, who: str = "reader") -> DataFrame:
    """Labelled points under a fixed schema; an empty result is a RuntimeError."""
    out = clean_labelled(spark.read.schema(labelled_schema(width)).csv(path, header=False, mode="PERMISSIVE"))
    if not out.head(1):
        raise RuntimeError(f"{who}: no usable rows in {path}")
    return out


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types and header found by Spark and by the first line; rows with nulls go."""
    header, _ = sniff_header(spark.read.text(path))
    return spark.read.csv(path, header=header, inferSchema=True).dropna()


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def check_input(spark: SparkSession, path: str) -> str | None:
    """None for a file with numbers after an optional header, or what is wrong with it."""
    try:
        lines = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    except Exception as e:  # the reader's own message says which path
        return f"cannot read {path}: {str(e).splitlines()[0]}"
    for r in lines:
        try:
            [float(t) for t in r["value"].split(",")]
            return None
        except ValueError:
            continue
    return f"no line of numbers in {path}" if lines else f"{path} is empty"
