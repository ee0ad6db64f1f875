"""Image file names: parsing into typed columns and rendering back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The token patterns of the naming scheme.
INT = r"-?\d+"
NUMBER = r"-?\d+\.?\d*"
LETTERS = r"[a-zA-Z]+"
LETTERS_DIGITS = r"[a-zA-Z0-9]+"
ANY = r".*"


def _scheme(position: str, modality: str, anchored: bool) -> str:
    body = (rf"({ANY})Subject({INT})_Session({INT})_({LETTERS})_\(({position}),({position})\)_"
            rf"({NUMBER})x({NUMBER})_({INT})_({modality})({ANY})\.({LETTERS})$")
    return "^" + body if anchored else body


WHOLE_POSITION = _scheme(INT, LETTERS_DIGITS, False)
REAL_POSITION = _scheme(NUMBER, LETTERS, True)
CROP_PREFIX = rf"CROP_({INT})_x({INT})y({INT})_"

FIELDS = [("prefix", "string"), ("subject_id", "bigint"), ("session_id", "bigint"), ("eye", "string"),
          ("x_position", "double"), ("y_position", "double"), ("x_size", "double"), ("y_size", "double"),
          ("image_id", "bigint"), ("modality", "string"), ("postfix", "string"), ("extension", "string")]


_MARK = "\u0001"


def _captures(name: Column, pattern: str) -> Column:
    """All captures of one regular-expression pass, as an array."""
    marked = F.regexp_replace(name, pattern, _MARK.join(f"${i}" for i in range(1, len(FIELDS) + 1)))
    return F.split(marked, _MARK)


def parse_file_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Add the twelve typed fields; names outside the scheme are dropped.

    Whole-number positions are tried first, then real ones. Each pattern runs
    once per name; the fields are read from the captured array.
    """
    n = len(FIELDS)
    whole, real = F.col("_whole"), F.col("_real")
    out = (df.withColumn("_whole", _captures(F.col(name), WHOLE_POSITION))
           .withColumn("_real", F.when(F.size("_whole") < n, _captures(F.col(name), REAL_POSITION))))
    # exploding zero or one match keeps later filters from repeating the expressions
    match = F.when(F.size(whole) == n, F.array(whole)).when(F.size(real) == n, F.array(real))
    out = out.select(*df.columns, F.explode(match).alias("_parts"))
    return out.select(*df.columns, *[F.col("_parts")[i].cast(t).alias(f) for i, (f, t) in enumerate(FIELDS)])


def crop_fields(prefix: str = "prefix") -> list[Column]:
    """crop_id, crop_x_position, crop_y_position of a crop prefix, else null."""
    has = F.col(prefix).rlike(CROP_PREFIX)
    return [F.when(has, F.regexp_extract(prefix, CROP_PREFIX, i)).cast("bigint").alias(n)
            for i, n in enumerate(("crop_id", "crop_x_position", "crop_y_position"), 1)]


def _position_text(col: str) -> Column:
    c = F.col(col)
    return F.when(F.floor(c) == c, F.floor(c).cast("string")).otherwise(c.cast("string"))


def render_file_name() -> Column:
    """Inverse of parsing; whole positions are printed without decimals."""
    crop = F.when(F.col("crop_id").isNotNull(), F.format_string(
        "CROP_%d_x%dy%d_", "crop_id", "crop_x_position", "crop_y_position")).otherwise(F.lit(""))
    return F.concat(
        crop, F.format_string("Subject%d_Session%d_", "subject_id", "session_id"), F.col("eye"),
        F.lit("_("), _position_text("x_position"), F.lit(","), _position_text("y_position"), F.lit(")_"),
        F.col("x_size").cast("string"), F.lit("x"), F.col("y_size").cast("string"), F.lit("_"),
        F.col("image_id").cast("string"), F.lit("_"), F.col("modality"),
        F.coalesce(F.col("postfix"), F.lit("")), F.lit("."), F.col("extension"))


def consistent_with(**wanted) -> Column:
    """Rows whose every named column is null or equal to the wanted value."""
    cond = F.lit(True)
    for col, value in wanted.items():
        cond = cond & (F.col(col).isNull() | (F.col(col) == F.lit(value)))
    return cond


def fix_modality_names(col: str) -> Column:
    fixed = F.regexp_replace(col, "_850nm", "_OA850nm")
    return F.regexp_replace(fixed, "_790nm", "_OA790nm")


# The nine central positions of the location shorthand (x, y).
CENTRAL_CODES = {
    "TL": (1, 1), "TM": (0, 1), "TR": (-1, 1),
    "ML": (1, 0), "C": (0, 0), "MR": (-1, 0),
    "BL": (1, -1), "BM": (0, -1), "BR": (-1, -1),
}


def shorthand_location(code: Column, eye: Column) -> tuple[Column, Column]:
    """(x, y) of a location code such as ``TL``, ``T2S1`` or ``2T1S``.

    One or two direction letters with a number before or after each; temporal
    is positive for left eyes and negative for right eyes.
    """
    up = F.upper(code)
    flip = F.when(F.upper(eye) == "OD", F.lit(-1.0)).otherwise(F.lit(1.0))
    ok = up.rlike(r"^(?:[A-Z]\d+(?:\.\d+)?){1,2}$|^(?:\d+(?:\.\d+)?[A-Z]){1,2}$")

    def read(letter: str) -> Column:
        lead = F.regexp_extract(up, rf"{letter}(\d+(?:\.\d+)?)", 1)
        trail = F.regexp_extract(up, rf"(\d+(?:\.\d+)?){letter}", 1)
        return F.when(up.rlike(r"^[A-Z]"), lead).otherwise(trail).try_cast("double")

    def last_of(a: str, b: str, sign: Column) -> Column:
        va, vb = sign * read(a), -sign * read(b)
        later = F.when(F.instr(up, a) > F.instr(up, b), F.coalesce(va, vb)).otherwise(F.coalesce(vb, va))
        return F.coalesce(later, F.lit(0.0))

    x, y = last_of("T", "N", flip), last_of("S", "I", F.lit(1.0))
    cx = F.lit(None).cast("double")
    cy = F.lit(None).cast("double")
    for name, (px, py) in CENTRAL_CODES.items():
        cx = F.when(up == name, F.lit(float(px))).otherwise(cx)
        cy = F.when(up == name, F.lit(float(py))).otherwise(cy)
    return F.coalesce(cx, F.when(ok, x)), F.coalesce(cy, F.when(ok, y))
