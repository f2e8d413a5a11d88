"""Citation markers ``[n](CITE)`` in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKER = r"\[(\d+)\]\(CITE\)"


def markers(answer: Column | str) -> Column:
    """All numbers in order, repeated ones too; what exceeds 18 digits counts as null and is dropped."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(_MARKER), F.lit(1)), lambda d: d.try_cast("long"))
    return F.filter(found, lambda n: n.isNotNull())


def positions(answer: Column | str, numbers: Column) -> Column:
    """Map from each number that occurs to the 0-based offset of its first marker, leading zeros or not."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    place = lambda n: F.call_function("regexp_instr", answer, F.concat(F.lit(r"\[0*"), n.cast("string"), F.lit(r"\]\(CITE\)"))) - 1
    pairs = F.filter(F.transform(F.array_distinct(numbers), lambda n: F.struct(n.alias("id"), place(n).cast("int").alias("at"))), lambda p: p["at"] >= 0)
    return F.map_from_entries(pairs)


def check(answers: DataFrame, answer: str = "response", n_citations: str = "n_citations") -> DataFrame:
    """Adds ``referenced_ids``, ``referenced_unique``, ``out_of_range_ids``, ``orphan_indices`` (0-based) and ``valid``."""
    n = F.col(n_citations)
    every = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))
    out = answers.withColumn("referenced_ids", markers(answer))
    out = out.withColumn("referenced_unique", F.array_sort(F.array_distinct("referenced_ids")))
    out = out.withColumn("out_of_range_ids", F.filter("referenced_ids", lambda i: (i < 1) | (i > n)))
    out = out.withColumn("orphan_indices", F.transform(F.array_except(every, F.col("referenced_unique")), lambda i: i - 1))
    return out.withColumn("valid", F.size("out_of_range_ids") == 0)
