"""Column-name helpers for the data-dependent symptom flag columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilo import config as C

# A character class valid in Java and RE2 alike: '-' last, nothing escaped.
_UNSAFE = "[" + "".join(ch for ch in C.SAFE_NAME_CHARS if ch != "-") + "-]"


def safe_name(term: str) -> str:
    """P7 on the driver: 'Chest pain' → 'SYM_Chest_pain' (≤30 names)."""
    return C.SYM_PREFIX + re.sub(_UNSAFE, "_", term)


def safe_name_col(c: str | Column) -> Column:
    """P7 as a column expression, for long tables of terms."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(C.SYM_PREFIX), F.regexp_replace(c, _UNSAFE, "_"))


def sym_columns(columns) -> list[str]:
    """Flag columns are rediscovered by prefix, as downstream steps do."""
    return [c for c in columns if c.startswith(C.SYM_PREFIX)]


def present(wanted, columns) -> list[str]:
    """Keep the wanted names that exist, in the wanted order."""
    have = set(columns)
    return [c for c in wanted if c in have]
