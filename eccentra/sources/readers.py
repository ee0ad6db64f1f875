"""Readers of the cohort file formats.

All readers take a glob over the whole cohort, so one scan serves every
subject; subject and session come from the path. Of a ``packed`` cohort (see the
writers) they come from columns. Missing values in any of the files' spellings
(NaN, empty, infinite) become null here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from eccentra import constants as K, schemas
from eccentra.operators import grid

SUBJECT = r"Subject=?(\d+)"
SESSION = r"Session=?(\d+)"


def _glob(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", "true")


def _visits(spark: SparkSession, schema, named: bool, packed: bool = False):
    """A reader of files in folders per subject and session, and their two ids.

    Folders named ``Subject=../Session=..`` are partitions: filters on the ids
    leave out files. Other folder names are read recursively and parsed. In packed
    files the ids are the first two columns.
    """
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not named and not packed:
        return _glob(spark).schema(own), path_ids(), own.names
    ids = [T.StructField("Subject", T.IntegerType()), T.StructField("Session", T.IntegerType())]
    both = T.StructType([*ids, *own.fields] if packed else [*own.fields, *ids])
    return spark.read.schema(both), _column_ids(), own.names


def _column_ids() -> list[Column]:
    return [F.col("Subject").alias("subject_id"), F.col("Session").alias("session_id")]


def _documents(spark: SparkSession, path: str, packed: bool) -> DataFrame:
    """(subject_id, session_id, value): the lines of text files."""
    return spark.read.parquet(path).select(*_column_ids(), "value") if packed else _glob(spark).text(path).select(*path_ids(), "value")


def path_ids() -> list[Column]:
    p = F.col("_metadata.file_path")
    return [F.regexp_extract(p, SUBJECT, 1).try_cast("int").alias("subject_id"), F.regexp_extract(p, SESSION, 1).try_cast("int").alias("session_id")]


def null_missing(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null."""
    out = [F.when(~F.isnan(f.name) & (F.abs(F.col(f"`{f.name}`")) != float("inf")), F.col(f"`{f.name}`")).alias(f.name)
           if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*out)


def cohort_results(spark: SparkSession, path: str, layers: Sequence[str], skip: tuple[int, int] | None = None, named: bool = True, packed: bool = False) -> DataFrame:
    """All result tables within +-10 degrees, one session optionally left out.

    The first line of each file names the separator and is skipped as a
    comment; empty files give no rows.
    """
    own = schemas.results(layers)
    if packed:
        lines = _documents(spark, path, True).filter(~F.col("value").startswith("s") & ~F.col("value").startswith(own.names[0] + ","))
        cells = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)).alias("v")
        df = lines.select("subject_id", "session_id", cells).select("subject_id", "session_id", "v.*").filter(F.abs("location") <= 10)
    else:
        read, ids, names = _visits(spark, own, named)
        df = read.option("header", "true").option("comment", "s").csv(path).select(*ids, *[F.col(f"`{c}`") for c in names]).filter(F.abs("location") <= 10)
    if skip is not None:
        df = df.filter(~((F.col("subject_id") == skip[0]) & (F.col("session_id") == skip[1])))
    return null_missing(df)


def subject_results(results: DataFrame) -> DataFrame:
    """Only the first session with data of each subject."""
    first = results.groupBy("subject_id").agg(F.min("session_id").alias("session_id"))
    return results.join(first, ["subject_id", "session_id"], "left_semi")


def density_profiles(spark: SparkSession, path: str, named: bool = True, packed: bool = False) -> DataFrame:
    """The profile table in long form (kind, axis), missing values dropped."""
    read, ids, names = _visits(spark, schemas.DENSITY_PROFILE, named, packed)
    wide = null_missing(read.option("header", "true").option("sep", ";").csv(path).select(*ids, *names))
    cols = [c for c in names if c != "ecc"]
    long = wide.unpivot(["subject_id", "session_id", "ecc"], cols, "name", "density").filter("density IS NOT NULL")
    kind = F.when(F.col("name").contains("smthd"), "smoothed").when(F.col("name").contains("fit"), "fitted").otherwise("raw")
    return long.select("subject_id", "session_id", kind.alias("kind"), F.substring("name", -1, 1).alias("axis"), "ecc", "density")


def raw_densities(spark: SparkSession, path_x: str, path_y: str, named: bool = True, packed: bool = False) -> DataFrame:
    parts = []
    for axis, path in (("X", path_x), ("Y", path_y)):
        read, ids, _ = _visits(spark, schemas.DENSITY_RAW, named, packed)
        parts.append(read.option("header", "true").option("sep", ";").csv(path).select(*ids, F.lit(axis).alias("axis"), "ecc", "density"))
    return null_missing(parts[0].unionByName(parts[1]))


def _layer_vectors(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    d = _documents(spark, path, packed).select("subject_id", "session_id", F.from_json("value", schemas.LAYER_DOC).alias("d"))
    s = d.select("subject_id", "session_id", "d.spacing", F.explode("d.study").alias("study", "slices"))
    s = s.select("subject_id", "session_id", "spacing", "study", F.explode("slices").alias("slice", "layers"))
    s = s.select("subject_id", "session_id", "spacing", "study", F.col("slice").cast("int").alias("slice"), F.explode("layers").alias("name", "body"))
    return s.select("subject_id", "session_id", "spacing", "study", "slice", grid.canonical_layer(F.col("name")).alias("layer"), F.col("body.vector").alias("vector"))


def _samples(vectors: DataFrame) -> DataFrame:
    out = vectors.select(*[c for c in vectors.columns if c != "vector"], F.posexplode("vector").alias("pos", "thickness"))
    v = F.col("thickness")
    return out.withColumn("thickness", F.when(~F.isnan(v) & (v != 0), v))


def layer_documents(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One row per sample of every layer vector of JSON documents, one document
    per line."""
    return _samples(_layer_vectors(spark, path, packed))


def _slice_vectors(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    s = _documents(spark, path, packed).select("subject_id", "session_id", F.explode(F.from_json("value", schemas.SLICE_DOC)["study"]).alias("study", "slices"))
    s = s.select("subject_id", "session_id", "study", F.explode("slices").alias("slice", "body"))
    vector = F.transform("body.vector", lambda v: F.when(~F.isnan(v), v))
    return s.select("subject_id", "session_id", "study", F.col("slice").cast("int").alias("slice"), vector.alias("vector")).filter(F.size("vector") > 0)


def layer_collection(spark: SparkSession, thickness: str, cvis: str, os: str, packed: bool = False) -> DataFrame:
    """Samples of all three layer documents of a visit.

    OS vectors are stretched to the length of their slice's PR_RPE vector; a slice
    of thicknesses without one has that many nulls. Null ends of CVI vectors are
    trimmed to the mean length of the study's thickness vectors, cut to a whole number.

    Documents are parsed once, and the vectors of a study meet as rows in one shuffle; samples become rows at the end.
    """
    study, at = ["subject_id", "session_id", "study"], ["subject_id", "session_id", "study", "slice"]
    vectors = _layer_vectors(spark, thickness, packed)
    both = vectors.withColumn("kind", F.lit("T"))
    for kind, path in (("OS", os), ("CVI", cvis)):
        more = _slice_vectors(spark, path, packed).select("*", F.lit(kind).alias("layer"), F.lit(kind).alias("kind"))
        both = both.unionByName(more.filter("subject_id IS NOT NULL AND session_id IS NOT NULL"), allowMissingColumns=True)
    size, own = F.size("vector"), F.col("kind") == "T"
    pr_rpe = own & (F.col("layer") == K.LAYER_ALIASES["PR_RPE"])
    near, far = W.partitionBy(*at), W.partitionBy(*study)
    t = both.repartition(*study).sortWithinPartitions(*at).withColumns({
        "_goal": F.floor(F.avg(F.when(own & F.col("layer").isin(list(K.LAYERS_THICKNESS)), size)).over(far)).cast("int"),
        "_spacing": F.min(F.when(own, F.col("spacing"))).over(far)})
    t = t.withColumns({"_long": F.max(F.when(pr_rpe & (size > 0), size)).over(near), "_has_os": F.max(F.col("kind") == "OS").over(near)})

    def made(layer: str, spacing: str, vector: Column) -> Column:
        return F.struct(F.lit(layer).alias("layer"), F.col(spacing).alias("spacing"), vector.alias("vector"))

    none = F.array_repeat(F.lit(None).cast("double"), size)
    missing = pr_rpe & (size > 0) & ~F.col("_has_os") & F.col("subject_id").isNotNull() & F.col("session_id").isNotNull()
    same = F.struct("layer", "spacing", F.transform("vector", lambda v: F.when(~F.isnan(v) & (v != 0), v)).alias("vector"))
    out = (F.when(missing, F.array(same, made("OS", "_spacing", none))).when(own, F.array(same))
           .when((F.col("kind") == "OS") & F.col("_long").isNotNull(), F.array(made("OS", "_spacing", grid.resample_array(F.col("vector"), F.col("_long")))))
           .when((F.col("kind") == "CVI") & F.col("_goal").isNotNull(), F.array(made("CVI", "_spacing", grid.trim_array(F.col("vector"), F.col("_goal"))))))
    t = t.select(*at, F.explode(out).alias("_v"))
    return t.select("subject_id", "session_id", "_v.spacing", "study", "slice", "_v.layer", F.posexplode("_v.vector").alias("pos", "thickness"))


def browse_export(spark: SparkSession, path: str, variant: str = "OCT_CUBE") -> DataFrame:
    """The single cube dataset of each patient and study; others are flagged by
    their count instead of stopping the job."""
    d = _glob(spark).text(path).select(F.explode(F.from_json("value", schemas.BROWSE)).alias("patient", "studies"))
    d = d.select("patient", F.explode("studies").alias("study", "datasets"))
    cubes = F.array_sort(F.filter("datasets", lambda x: F.array_contains(x["info"]["layerVariants"], variant)),
                         lambda x, y: (x["info"]["id"] - y["info"]["id"]).cast("int"))
    t = d.select("patient", "study", F.size(cubes).alias("n_cubes"), cubes[0].alias("c"))
    return t.filter("n_cubes >= 1").select(
        "patient", "study", "n_cubes", F.col("c.info.id").alias("dataset"),
        F.to_json(F.struct(F.col("c.tvss").alias("thickness"), F.col("c.oct.info.spacing").alias("spacing"))).alias("thickness_doc"),
        F.to_json(F.struct(F.col("c.cvis").alias("index"), F.col("c.oct.info.spacing").alias("spacing"))).alias("index_doc"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    return null_missing(spark.read.schema(schemas.BASELINE).option("header", "true").csv(path))


def fovea_parameters(spark: SparkSession, path: str, names: Sequence[str], named: bool = True, packed: bool = False) -> DataFrame:
    """Long ``param;value`` files -> one row per subject and session; values
    that are not numbers are null, header rows drop out, of repeated ones the largest stays."""
    read, ids, _ = _visits(spark, schemas.PARAMETERS, named, packed)
    t = read.option("sep", ";").csv(path).select(*ids, "param", F.col("value").try_cast("double").alias("value")).filter(F.col("param").isin(list(names)))
    return t.groupBy("subject_id", "session_id").pivot("param", list(names)).agg(F.max("value"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate files (x, y as reals) -> whole pixels, swapped to (y, x)."""
    raw = spark.read.schema("image_id int, x double, y double").csv(path)
    return raw.select("image_id", F.rint("y").cast("int").alias("row"), F.rint("x").cast("int").alias("col"))


def position_lut(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Positions of image files by the number in their name; y points up."""
    lut = spark.read.schema(schemas.POSITION_LUT).option("sep", ";").csv(path).dropDuplicates().withColumn("number", F.col("img").try_cast("bigint"))
    f = files.withColumn("number", F.regexp_extract("file_name", r"_(\d+)_", 1).try_cast("bigint"))
    return f.join(lut, "number").select(*files.columns, "number", F.col("X").alias("x"), (-F.col("Y")).alias("y"), F.col("range"))


def component_locations(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Corrected montage files: components with the centre of their file and
    the image size taken from the least rotated component.

    The metadata row is the one whose name is a pair of numbers; a montage is a
    folder, which may hold several part files; in packed files it is the first column.
    """
    if packed:
        raw = spark.read.schema(T.StructType([T.StructField("file", T.StringType()), *schemas.COMPONENTS.fields])).option("quote", '"').csv(path)
    else:
        raw = _glob(spark).schema(schemas.COMPONENTS).option("quote", '"').csv(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/", 1))
    pair = r"^\((-?[\d.]+), ?(-?[\d.]+)\)$"
    head = raw.filter(F.col("name").rlike(pair)).select(
        "file", F.regexp_extract("name", pair, 1).cast("double").alias("centre_x"), F.regexp_extract("name", pair, 2).cast("double").alias("centre_y"))
    body = raw.filter(~F.col("name").rlike(pair))
    size = body.groupBy("file").agg(F.min_by("image_size", F.struct(F.abs("angle"), "name")).alias("image_size"))
    return (body.drop("image_size").join(head, "file").join(size, "file")
            .select("name", F.col("x").cast("double").alias("x"), "y", "angle", "centre_x", "centre_y", "image_size"))
