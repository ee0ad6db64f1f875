"""Column expressions for eccentricity, sectors, densities and transforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eccentra import constants as K


def steps_of(ecc_deg: Column) -> Column:
    """Grid index (tenths of a degree), half-even like the measured grid."""
    return F.bround(ecc_deg * K.GRID_PER_DEGREE, 0).cast("int")


def degrees_of(steps: Column) -> Column:
    return steps / F.lit(float(K.GRID_PER_DEGREE))


def pixel_steps(px: Column) -> Column:
    """Grid index of a pixel distance."""
    return F.bround(px / K.PIXELS_PER_DEGREE * K.GRID_PER_DEGREE, 0).cast("int")


def step_interval_px(steps: Column) -> tuple[Column, Column]:
    """Pixel limits of a grid step."""
    half = 0.5 / K.GRID_PER_DEGREE
    return ((degrees_of(steps) - half) * K.PIXELS_PER_DEGREE,
            (degrees_of(steps) + half) * K.PIXELS_PER_DEGREE)


def signed_eccentricity(dx: Column, dy: Column, axis: Column, right_eye: Column) -> Column:
    """Signed distance to the centre in degrees; x flips for right eyes."""
    side_x = F.when(dx >= 0, 1.0).otherwise(-1.0) * F.when(right_eye, -1.0).otherwise(1.0)
    side_y = F.when(dy >= 0, 1.0).otherwise(-1.0)
    sign = F.when(axis == "X", side_x).when(axis == "Y", side_y).otherwise(1.0)
    return sign * F.sqrt(dx * dx + dy * dy) / K.PIXELS_PER_DEGREE


def in_thickness_sector(axis: Column, dx: Column, dy: Column) -> Column:
    """Strict sector of layer samples, in pixels."""
    def limit(d: Column) -> Column:
        return K.SECTOR_SLOPE * F.abs(d) + K.SECTOR_OFFSET_PX
    return F.when(axis == "X", F.abs(dy) < limit(dx)).otherwise(F.abs(dx) < limit(dy))


def in_count_sector(axis: Column, sx: Column, sy: Column) -> Column:
    """Closed sector of detected points, on distances rounded to the grid."""
    offset = K.SECTOR_OFFSET_PX / K.PIXELS_PER_DEGREE
    ax, ay = degrees_of(F.abs(sx)), degrees_of(F.abs(sy))
    return F.when(axis == "X", ay <= K.SECTOR_SLOPE * ax + offset).otherwise(
        ax <= K.SECTOR_SLOPE * ay + offset)


def count_density(count: Column, area: Column, threshold: float = K.AREA_THRESHOLD) -> Column:
    per_mm2 = (K.PIXELS_PER_DEGREE / K.MM_PER_DEGREE) ** 2
    return F.when(area > threshold, F.lit(per_mm2) * count / area).otherwise(0.0)


def density_spacing(density: Column) -> Column:
    """Spacing in arcmin of a hexagonal mosaic with the given density."""
    return F.sqrt(2.0 / F.nullif(density, F.lit(0.0)) / F.sqrt(F.lit(3.0))) / K.MM_PER_DEGREE * 60.0


def ring_density(radius: Column, size: Column) -> Column:
    r = radius / size * K.PIXELS_PER_DEGREE / K.MM_PER_DEGREE
    return F.sqrt(F.lit(3.0)) / 2.0 * r * r


def robust_estimate(estimates: Column, ecc_deg: Column) -> Column:
    """Median of three estimates, or their largest where the median is low."""
    ordered = F.array_sort(estimates)
    floor_ = 5000.0 + 45000.0 * F.exp(-F.abs(ecc_deg))
    return F.when(ordered[1] < floor_, F.array_max(estimates)).otherwise(ordered[1])


def age_years(birth: Column, visit: Column) -> Column:
    return F.datediff(visit, birth) / 365.0


def significance_marker(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def significance_alpha(p: Column, threshold: float = 0.05) -> Column:
    shade = 0.15 + 0.85 * F.pow(1.0 - p, F.lit(4.0))
    return F.when(p.isNull() | F.isnan(p) | (p > threshold), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)))


def crop_size(distance_deg: Column) -> Column:
    size = F.least(F.lit(300.0), 160.0 * F.sqrt(1.0 + distance_deg * distance_deg / 20.0))
    return F.floor(size).cast("int")


def crop_origins(size: Column, image_size: int = K.IMAGE_SIZE, overlap: float = 1 / 3) -> Column:
    """Array of crop offsets along one side that cover the image."""
    ratio = image_size / size
    n = F.ceil(1 + (ratio - 1) / (1 - overlap))
    actual = 1 - (ratio - 1) / (n - 1)
    step = F.greatest(F.floor(size * (1 - actual)).cast("int"), F.lit(1))
    return F.sequence(F.lit(0), F.lit(image_size) - size, step)


def patch_offsets(length: Column, patch: int, min_overlap: int = 14) -> Column:
    """Array of patch offsets along one side, overlapping by at least ``min_overlap``."""
    span = length - patch
    n = F.when(length <= patch, 1).otherwise(
        F.greatest(F.lit(2), (F.ceil(span / float(patch - min_overlap)) + 1).cast("int")))
    return F.when(n == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1),
                    lambda i: F.floor(i * span / (n - 1)).cast("int")))


def affine(x: Column, y: Column, prefix: str = "", scale: float = 1.0) -> tuple[Column, Column]:
    """Point under the 2x3 matrix in columns a11..a23, both rows scaled."""
    a = {k: F.col(prefix + k) for k in ("a11", "a12", "a13", "a21", "a22", "a23")}
    return ((a["a11"] * x + a["a12"] * y + a["a13"]) * scale,
            (a["a21"] * x + a["a22"] * y + a["a23"]) * scale)


def affine_product(left: str, right: str) -> list[Column]:
    """Columns of (left @ right) for two prefixed 2x3 matrices."""
    def l(k):  # noqa: E743
        return F.col(left + k)

    def r(k):
        return F.col(right + k)
    out = []
    for i in "12":
        for j in "12":
            out.append((l(f"a{i}1") * r(f"a1{j}") + l(f"a{i}2") * r(f"a2{j}")).alias(f"a{i}{j}"))
        out.append((l(f"a{i}1") * r("a13") + l(f"a{i}2") * r("a23") + l(f"a{i}3")).alias(f"a{i}3"))
    return [out[0], out[1], out[2], out[3], out[4], out[5]]


def widen_intervals(s1: Column, e1: Column, s2: Column, e2: Column) -> list[Column]:
    """Replace the narrower of two intervals by the wider one."""
    second, first = (e2 - s2) > (e1 - s1), (e1 - s1) > (e2 - s2)
    return [F.when(second, s2).otherwise(s1), F.when(second, e2).otherwise(e1),
            F.when(first, s1).otherwise(s2), F.when(first, e1).otherwise(e2)]
