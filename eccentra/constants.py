"""Fixed values of the measurement geometry and of the result tables."""

PIXELS_PER_DEGREE = 480.0
MM_PER_DEGREE = 0.291
AREA_THRESHOLD = 4819
GRID_PER_DEGREE = 10          # profile grid: tenths of a degree
GRID_LIMIT = 100              # +-10 degrees, in grid steps
SECTOR_SLOPE = 0.2
SECTOR_OFFSET_PX = 200.0
NEAR_LIMIT_DEG = 4.0          # the near source is used inside this radius
FAR_LIMIT_DEG = 2.0           # the far source is used outside this radius
IMAGE_SIZE = 720
MAX_PLAUSIBLE_DENSITY = 150_000.0

# Layer names as exported -> names used in the analysis.
LAYER_ALIASES = {
    "GCL_IPL": "GCL+IPL",
    "INL_OPL": "INL+OPL",
    "PR_RPE": "PhotoR+RPE",
    "CC_CS": "Choroid",
}
# Layers whose vector lengths set the goal length of CVI vectors.
LAYERS_THICKNESS = ("RNFL", "GCL+IPL", "INL+OPL", "ONL", "PhotoR+RPE", "Choroid", "OS")

# Points that a surface is thinned to, the least it needs, and the shift and width of the fall-off.
SURFACE_TARGET, SURFACE_LEAST = 30000, 1000
SURFACE_THINNING = (1.58853363, 1.03617677, 1.62750008, 0.9)
