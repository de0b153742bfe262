"""Cleaning expressions (all JVM-side, codegen'd, null-safe).

Each helper returns a :class:`Column`; they compose inside one projection
so a whole cleaning step stays in one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo import config as C

_EDGE_SPACE = r"^\s+|\s+$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading/trailing white space (tabs and newlines too)."""
    return F.regexp_replace(col_(c), _EDGE_SPACE, "")


def na_to_null(c: str | Column) -> Column:
    """Missing-value tokens of the CSV reader become NULL (matched unpadded)."""
    c = col_(c)
    return F.when(~c.isin(C.NA_TOKENS), c)


def yes_flag(c: str | Column) -> Column:
    """Trimmed text equal to 'Y' → 1, anything else (null too) → 0."""
    return F.coalesce(strip(c) == F.lit("Y"), F.lit(False)).cast("tinyint")


def to_number(c: str | Column) -> Column:
    """Text → double; unparsable text, NULL and NaN all become NULL."""
    d = col_(c).try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def clip(c: str | Column, lo: float = C.CLIP_LOW, hi: float = C.CLIP_HIGH) -> Column:
    """Clip into [lo, hi] keeping NULL (least/greatest alone would not)."""
    c = col_(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def to_date(c: str | Column) -> Column:
    """ISO or US-style date text → DATE; anything else → NULL."""
    c = col_(c)
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"),
                      F.try_to_date(c, "MM/dd/yyyy"))


def date_parts(df: DataFrame, c: str = "RECVDATE") -> DataFrame:
    """Add RECV_YEAR_MONTH ('yyyy-MM') and RECV_YEAR, drop the source."""
    d = to_date(c)
    return (df.withColumns({"RECV_YEAR_MONTH": F.date_format(d, "yyyy-MM"),
                            "RECV_YEAR": F.year(d)})
              .drop(c))


def normalise_manufacturer(c: str | Column) -> Column:
    """NULL → UNKNOWN, upper case, strip, then the alias map."""
    base = strip(F.upper(F.coalesce(col_(c), F.lit(C.MANUFACTURER_MISSING))))
    expr = None
    for raw, canon in C.MANUFACTURER_ALIASES.items():
        expr = (F.when(base == F.lit(raw), F.lit(canon)) if expr is None
                else expr.when(base == F.lit(raw), F.lit(canon)))
    return expr.otherwise(base) if expr is not None else base


def fill_unknown(c: str | Column) -> Column:
    """P10: categorical NULL → 'Unknown', as text."""
    return F.coalesce(col_(c).cast("string"), F.lit(C.CATEGORY_MISSING))


def fill_zero_flag(c: str | Column) -> Column:
    """NULL flag after an outer join → 0, narrowed to tinyint."""
    return F.coalesce(col_(c), F.lit(0)).cast("tinyint")


def round_half_even(c: str | Column, digits: int) -> Column:
    """Numpy-style rounding of doubles: rint(x·10^d)/10^d.

    The scaled double is rounded half-to-even: 2.675·100 is exactly 267.5, so
    2.675 → 2.68 and 0.125 → 0.12, as pandas' ``round`` does. ``F.round`` and
    ``F.bround`` round the exact binary value (2.67499…) and give 2.67.
    """
    scale = float(10 ** digits)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale)


def r6(c: str | Column) -> Column:
    """Round a double aggregate to 1e-6 so summation order cannot show."""
    return round_half_even(c, 6)


def pretty_symptom(c: str | Column) -> Column:
    """P16: 'SYM_Chest_pain' → 'Chest pain'."""
    return F.regexp_replace(F.regexp_replace(col_(c), "^SYM_", ""), "_", " ")


def decide(p: str | Column, threshold: float = C.DECISION_THRESHOLD) -> Column:
    """Class decision at the threshold (inclusive)."""
    return (col_(p) >= F.lit(threshold)).cast("int")


def outcome_text(c: str | Column) -> Column:
    """0/1 label → 'Survived'/'Died'."""
    c = col_(c)
    return F.when(c == 1, F.lit("Died")).when(c == 0, F.lit("Survived"))


def yes_no_text(c: str | Column) -> Column:
    """0/1 flag → 'No / Not Reported'/'Yes'."""
    c = col_(c)
    return F.when(c == 1, F.lit("Yes")).when(c == 0, F.lit("No / Not Reported"))


def model_label(c: str | Column) -> Column:
    """P20: model key → display name; unknown keys: '_' → ' ', title case."""
    m = F.create_map(*[F.lit(x) for kv in C.MODEL_LABELS.items() for x in kv])
    c = col_(c)
    return F.coalesce(m[c], F.initcap(F.regexp_replace(c, "_", " ")))
