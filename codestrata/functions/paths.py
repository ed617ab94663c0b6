"""Path form: forward slashes, no leading ``./``, Unicode NFC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ICU's composing normaliser is on Spark's own class path; it is reached only by
#: the rare paths with characters beyond ASCII, so the expression stays in the JVM.
_NFC = "com.ibm.icu.text.Normalizer"


def path_form(path: Column) -> Column:
    """Null stays null; the result is idempotent."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")
    composed = F.try_reflect(F.lit(_NFC), F.lit("compose"), plain, F.lit(False))
    return F.when(plain.isNull() | plain.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(composed)


def path_form_sql(col: str) -> str:
    """The same in DuckDB's SQL."""
    return rf"nfc_normalize(regexp_replace(replace({col}, '\', '/'), '^(\./+)+', ''))"
