"""Writers of the result tables.

Each takes a whole cohort and writes it partitioned by subject and session;
rows are sorted inside a file where the format needs an order. A folder per visit
costs more than its rows where a cohort has very many: ``packed`` writes the same
lines with the ids as columns before them, in as many files as there are tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eccentra.operators import profiles

TREE = ["Subject", "Session"]


def _tree(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"subject_id": "Subject", "session_id": "Session"})


def results_wide(densities: DataFrame, layers: DataFrame | None, layer_names: Sequence[str]) -> DataFrame:
    """Wide result rows per subject and session: every grid step between the
    smallest and the largest step of density and layers, zeros as null, the
    largest of repeated values.

    Without layers the last step is left out, as in the density-only table.
    """
    key = ["subject_id", "session_id"]
    d = densities.select(*key, "e10", F.concat(F.lit("densities_"), "axis").alias("name"), F.col("density").alias("value"))
    names = ["densities_X", "densities_Y"]
    if layers is not None:
        lay = layers.filter(F.col("layer").isin(list(layer_names)))
        d = d.unionByName(lay.select(*key, "e10", F.concat_ws("_", "layer", "axis").alias("name"), F.col("thickness").alias("value")))
        names = [f"{c}_{a}" for a in "XY" for c in ("densities", *layer_names)]
    wide = d.groupBy(*key, "e10").pivot("name", names).agg(F.max(F.when(F.col("value") != 0, F.col("value"))))
    full = profiles.own_range(wide, key, end_exclusive=layers is None)
    return full.withColumn("location", F.col("e10") / 10.0).select(*key, "location", *[F.col(f"`{n}`") for n in names])


def write_results(wide: DataFrame, path: str, packed: bool = False) -> None:
    """``sep=,`` line, header, then rows by location, one file per session (packed: one run of rows)."""
    cols = [c for c in wide.columns if c not in ("subject_id", "session_id")]

    def cell(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = wide.select("subject_id", "session_id", F.col("location").alias("_at"), F.concat_ws(",", *[cell(c) for c in cols]).alias("line"))
    keys = wide.select("subject_id", "session_id").distinct()
    top = keys.withColumn("_h", F.explode(F.array(
        F.struct(F.lit(-1e9).alias("_at"), F.lit("sep=,").alias("line")), F.struct(F.lit(-1e8).alias("_at"), F.lit(",".join(cols)).alias("line")))))
    out = _tree(rows.unionByName(top.select("subject_id", "session_id", "_h.*"))).repartition(*TREE).sortWithinPartitions(*TREE, "_at")
    if packed:
        write_packed(out.select(*TREE, F.col("line").alias("value")), path)
    else:
        out.select(*TREE, "line").write.partitionBy(*TREE).mode("overwrite").text(path)


def write_packed(lines: DataFrame, path: str) -> None:
    """(Subject, Session, value): lines of text files."""
    lines.select(*TREE, "value").write.mode("overwrite").parquet(path)


def _eight_digits(c: Column) -> Column:
    """The value as text with eight significant digits."""
    return F.when(c.isNotNull(), F.format_string("%.8g", c))


def write_density_profile(profile: DataFrame, scalars: DataFrame, path: str, packed: bool = False) -> None:
    """Profile columns and subject scalars as two tables."""
    cols = [c for c in profile.columns if c not in ("subject_id", "session_id")]
    text = profile.select("subject_id", "session_id", *[_eight_digits(F.col(c)).alias(c) for c in cols])
    _write_csv(_tree(text), f"{path}/profile", packed)
    scalars.write.mode("overwrite").parquet(f"{path}/scalars")


def _write_csv(rows: DataFrame, path: str, packed: bool) -> None:
    out = rows if packed else rows.repartition(*TREE).sortWithinPartitions(*TREE)
    (out.write if packed else out.write.partitionBy(*TREE)).mode("overwrite").option("header", "true").option("sep", ";").csv(path)


def write_raw_densities(raw: DataFrame, path: str, packed: bool = False) -> None:
    for axis in "XY":
        t = raw.filter(F.col("axis") == axis).select("subject_id", "session_id", "ecc", "density")
        _write_csv(_tree(t), f"{path}/{axis}", packed)


def write_feature_sheets(table: DataFrame, path: str) -> None:
    """One folder per feature with ``median (std)`` cells."""
    from eccentra.operators.cohort import median_std_text

    out = table.withColumn("cell", median_std_text(F.col("median"), F.coalesce("std", F.lit(float("nan")))))
    out.drop("median", "std", "n").write.partitionBy("feature").mode("overwrite").option("header", "true").csv(path)


def position_lut(files: DataFrame, mirrored_before: int = 49) -> DataFrame:
    """One look-up row per image of the first modality of its folder; x runs
    the other way for early subjects."""
    x = F.when(F.col("subject_id") < mirrored_before, -F.col("x_position")).otherwise(F.col("x_position"))
    return files.select("subject_id", "session_id", F.col("image_id").alias("img"), x.alias("X"), F.col("y_position").alias("Y"), F.col("x_size").alias("range"))


def correlation_documents(corr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON document per key: {layer: {part: [rho, p]}}; layers and parts
    are few, so a document stays small."""
    part = F.struct("part", F.when(F.col("rho").isNotNull(), F.array(F.col("rho"), F.col("p"))).alias("v"))
    lay = corr.groupBy(*keys, "layer").agg(F.map_from_entries(F.sort_array(F.collect_list(part))).alias("parts"))
    return lay.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", F.to_json("parts").alias("j")))))).alias("doc"))


def tile_lines(tiles: DataFrame) -> DataFrame:
    """``x y count density`` with three decimals."""
    return tiles.select("image_id", F.format_string("%d %d %d %.3f", "x", "y", "n_points", "density").alias("line"))
