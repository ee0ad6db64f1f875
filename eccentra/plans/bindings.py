"""Views that bind the operators to the given tables.

Each view is one SQL text read by Spark and by the checking engine alike.
Values are whole numbers or dyadic fractions, so sums are exact in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # layer observations: one thickness and one density reading on the 0.1 degree grid
    "v_obs": """
        SELECT subject_id, session_id, axis, e10, layer, raw_layer, thickness, source,
               base_density + CAST(floor(1.2e6 / (10 + abs(e10))) AS DOUBLE) AS density,
               visit, obs_id
        FROM (SELECT CAST(l_suppkey AS INT) + 1 AS subject_id,
                     1 + CAST(l_suppkey % 3 AS INT) AS session_id,
                     CASE WHEN l_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END AS axis,
                     CAST((l_partkey * 7 + l_orderkey * 3 + l_linenumber) % 201 AS INT) - 100 AS e10,
                     CASE l_returnflag WHEN 'A' THEN 'GCL+IPL' WHEN 'N' THEN 'Choroid' ELSE 'RNFL' END AS layer,
                     CASE l_returnflag WHEN 'A' THEN 'GCL_IPL' WHEN 'N' THEN 'CC_CS' ELSE 'RNFL' END AS raw_layer,
                     l_quantity - 1 AS thickness,
                     CASE WHEN l_linestatus = 'O' THEN 'near' ELSE 'far' END AS source,
                     CAST(floor(l_extendedprice / 10) AS DOUBLE) AS base_density,
                     1 + CAST(l_linenumber % 3 AS INT) AS visit,
                     l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS obs_id
              FROM {lineitem}) AS b""",
    # one density and thickness value per subject, axis and grid point
    "v_profile": """
        SELECT subject_id, session_id, axis, e10, avg(density) AS density,
               avg(nullif(thickness, 0)) AS thickness, CAST(count(*) AS BIGINT) AS n_obs
        FROM {v_obs} GROUP BY subject_id, session_id, axis, e10""",
    "v_layer_profile": """
        SELECT subject_id, session_id, layer, axis, e10, avg(thickness) AS thickness
        FROM {v_obs} WHERE thickness > 0
        GROUP BY subject_id, session_id, layer, axis, e10""",
    # one row per subject
    "v_baseline": """
        SELECT CAST(s_suppkey AS INT) + 1 AS subject_id,
               CASE WHEN s_suppkey % 2 = 0 THEN 'OD' ELSE 'OS' END AS laterality,
               DATE '1952-01-01' + CAST(s_suppkey * 997 % 17000 AS INT) AS birth_date,
               DATE '2021-01-01' + CAST(s_suppkey * 31 % 600 AS INT) AS visit_date,
               21e0 + (s_suppkey * 37 % 64) / 8e0 AS axial_right,
               21e0 + (s_suppkey * 41 % 64) / 8e0 AS axial_left,
               (s_suppkey * 29 % 56) / 4e0 - 8e0 AS sphere_right,
               (s_suppkey * 23 % 56) / 4e0 - 8e0 AS sphere_left,
               CASE WHEN s_nationkey % 2 = 0 THEN 'H' ELSE 'F' END AS sex
        FROM {supplier}""",
    # detected points, in pixels of their image
    "v_points": """
        SELECT CAST(l_suppkey AS INT) AS image_id,
               CAST((l_partkey * 13 + l_orderkey * 7) % 720 AS INT) AS x,
               CAST((l_orderkey * 11 + l_linenumber * 101 + l_partkey) % 720 AS INT) AS y,
               CAST(l_extendedprice AS DOUBLE) AS quality,
               CASE WHEN l_linestatus = 'O' THEN 'near' ELSE 'far' END AS source
        FROM {lineitem}""",
    # the same points as an irregular raw profile: offset in degrees (1/512), value
    "v_raw_density": """
        SELECT CAST(l_suppkey AS INT) + 1 AS subject_id,
               CASE WHEN l_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END AS axis,
               (CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber) % 10241 AS INT) - 5120) / 512e0 AS ecc,
               CAST(floor(l_extendedprice / 10) AS DOUBLE)
                 + CAST(floor(1.2e6 / (10 + abs(CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber) % 10241 AS INT) - 5120) / 51)) AS DOUBLE) AS density
        FROM {lineitem}""",
    # valid and dark pixels
    "v_pixels": """
        SELECT image_id, x, y, CAST(max(v) AS DOUBLE) AS v FROM (
          SELECT CAST(l_suppkey AS INT) AS image_id,
                 CAST((l_orderkey * 17 + l_partkey) % 720 AS INT) AS x,
                 CAST((l_partkey * 19 + l_orderkey * 5) % 720 AS INT) AS y,
                 CAST(l_quantity AS INT) * 5 AS v FROM {lineitem}) AS p
        GROUP BY image_id, x, y""",
    # pixels of small images whose tiles are nearly filled
    "v_crop_pixels": """
        SELECT image_id, x, y, CAST(max(v) AS DOUBLE) AS v FROM (
          SELECT CAST(l_suppkey AS INT) AS image_id,
                 CAST((l_orderkey * 17 + l_partkey) % 20 AS INT) AS x,
                 CAST((l_partkey * 19 + l_orderkey * 5 + l_linenumber) % 20 AS INT) AS y,
                 CAST(l_quantity AS INT) * 5 AS v FROM {lineitem}) AS p
        GROUP BY image_id, x, y""",
    # montage elements on an integer grid with a near-translation transform
    "v_elements": """
        SELECT o_orderkey AS element_id, o_orderkey - o_orderkey % 40 AS mosaic_id,
               CAST(o_orderkey % 40 % 7 AS INT) - 3 AS x,
               CAST((o_orderkey % 40 - o_orderkey % 40 % 7) / 7 AS INT) - 3 AS y,
               1e0 AS a11, (o_custkey % 5 - 2) / 64e0 AS a12,
               (o_orderkey % 40 % 7) * 512e0 + CAST(o_custkey % 37 AS DOUBLE) - 18 AS a13,
               (2 - o_custkey % 5) / 64e0 AS a21, 1e0 AS a22,
               ((o_orderkey % 40 - o_orderkey % 40 % 7) / 7) * 512e0 + CAST(o_custkey % 41 AS DOUBLE) - 20 AS a23
        FROM {orders}""",
    # parent pointers inside a mosaic; roots point to themselves
    "v_matches": """
        SELECT o_orderkey AS node, o_orderkey - o_orderkey % 40 AS mosaic_id,
               CASE WHEN o_custkey % 6 = 0 OR o_orderkey % 40 - (1 + o_custkey % 4) < 0 THEN o_orderkey
                    ELSE o_orderkey - (1 + o_custkey % 4) END AS parent,
               CAST(o_custkey % 7 AS DOUBLE) - 3 AS dx, CAST(o_custkey % 11 AS DOUBLE) - 5 AS dy,
               CAST(floor(o_totalprice) AS BIGINT) % 200 AS n_inliers,
               CAST(o_custkey % 64 AS DOUBLE) / 64e0 AS inlier_ratio
        FROM {orders}""",
    # image file names: up to three modalities per acquisition, some with crop
    # prefix, half-degree position or a name that must be rejected
    "v_files": """
        SELECT file_no, subject AS dir_subject_id,
               CASE WHEN file_no % 31 = 0 THEN 0 ELSE 1 + subject % 400 END AS dir_session_id,
               concat(
                 CASE WHEN acq % 9 = 0 THEN concat('CROP_', CAST(acq % 30 AS VARCHAR(9)), '_x', CAST(acq % 535 AS VARCHAR(9)), 'y', CAST(subject % 535 AS VARCHAR(9)), '_') ELSE '' END,
                 CASE WHEN file_no % 23 = 0 THEN 'Patient' ELSE 'Subject' END, CAST(subject AS VARCHAR(20)),
                 '_Session', CAST(1 + subject % 400 AS VARCHAR(20)), '_',
                 CASE WHEN subject % 2 = 0 THEN 'OD' ELSE 'OS' END, '_(',
                 CAST(acq % 21 - 10 AS VARCHAR(9)), CASE WHEN acq % 10 = 3 THEN '.5' ELSE '' END, ',',
                 CAST(acq % 5 - 2 AS VARCHAR(9)), CASE WHEN acq % 10 = 3 THEN '.5' ELSE '' END, ')_1.5x1.5_',
                 CAST(1000 + acq AS VARCHAR(20)), '_',
                 CASE file_no % 3 WHEN 0 THEN 'Confocal' WHEN 1 THEN 'CalculatedSplit'
                      ELSE CASE WHEN file_no % 17 = 0 THEN '850nm' ELSE 'DarkField' END END,
                 '_extract_reg_avg.tif') AS file_name
        FROM (SELECT o_orderkey AS file_no, CAST(floor(o_orderkey / 3) AS BIGINT) AS acq,
                     CAST(1 + floor(o_orderkey / 120) AS BIGINT) AS subject
              FROM {orders}) AS f""",
}

# The tile view needs an array explode, whose spelling differs between engines.
TILE_SPARK = """
    SELECT CAST(vec_id AS BIGINT) AS tile_id, label, CAST(t.pos AS INT) AS pos,
           greatest(0e0, least(255e0, CAST(floor((CAST(t.v AS DOUBLE) + 5e-1) * 256e0) AS DOUBLE))) AS v
    FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, v"""
TILE_ORACLE = """
    SELECT CAST(vec_id AS BIGINT) AS tile_id, label, CAST(i - 1 AS INT) AS pos,
           greatest(0e0, least(255e0, CAST(floor((CAST(embedding[i] AS DOUBLE) + 5e-1) * 256e0) AS DOUBLE))) AS v
    FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) AS u"""


def _needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


class Bindings:
    """Resolves tables and views of one data folder to DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "v_tile":
            return self.spark.sql(TILE_SPARK, embeddings=self.table("embeddings"))
        if name in VIEWS:
            text = VIEWS[name]
            return self.spark.sql(text, **{n: getattr(self, n) for n in set(_needs(text))})
        raise AttributeError(name)


def sql_prelude(body: str) -> str:
    """CTE definitions of the views a SQL text mentions, in dependency order."""
    done: list[str] = []

    def visit(view: str) -> None:
        if view in done:
            return
        for dep in _needs(VIEWS.get(view, "")):
            if dep in VIEWS:
                visit(dep)
        done.append(view)

    for view in list(VIEWS) + ["v_tile"]:
        if re.search(rf"\b{view}\b", body):
            visit(view)
    parts = []
    for view in done:
        text = TILE_ORACLE if view == "v_tile" else VIEWS[view].format(
            **{n: n for n in _needs(VIEWS[view])})
        parts.append(f"{view} AS ({text})")
    return ", ".join(parts)
