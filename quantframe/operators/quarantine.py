"""Corrupt input: lines read leniently, every row either clean or set aside with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.joins import beside
from quantframe.functions.windows import ordered

CORRUPT = "_corrupt"


def read_lines(lines: DataFrame, schema: str, column: str = "value", options: dict[str, str] | None = None) -> DataFrame:
    """The other columns and the fields of each line's CSV record, read as text; _corrupt holds the line where its fields aren't as many as the schema's."""
    fields = T._parse_datatype_string(schema)
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField(CORRUPT, T.StringType())])
    record = F.from_csv(F.col(column), text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **(options or {})})
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, F.col(column).alias("_line"), record.alias("r")).select(*rest, "_line", "r.*")


def sanitise(rows: DataFrame, schema: str, keys: list[str], ts: str, order: str, numbers: list[str], times: float = 10.0) -> DataFrame:
    """rows of ``read_lines`` with typed fields and ``reasons``, an array that is empty for clean rows:

    unreadable (wrong number of fields), not_a_time, not_a_number (by column, where text is no number), missing (an empty number), infinite, outlier (further from the key's
    median than ``times`` the distance of its quartiles), repeated (a later row of the key has the same time; ``order`` tells which is later). Fields that aren't what they should be are null. No row is dropped."""
    types = {f.name: f.dataType for f in T._parse_datatype_string(schema)}
    named = lambda test, reason: F.when(test, F.lit(reason))
    good = F.col(CORRUPT).isNull()
    typed, reasons = rows, [named(~good, "unreadable")]
    for c, t in types.items():
        value = F.col(c).try_cast(t)
        typed = typed.withColumn(f"_t_{c}", F.when(good, value))
        if c == ts:
            reasons.append(named(good & value.isNull(), "not_a_time"))
        if c in numbers:
            wild = F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
            reasons += [named(good & (F.col(c).isNull() | (F.trim(c) == "")), f"missing {c}"), named(good & (F.trim(c) != "") & value.isNull(), f"not_a_number {c}"), named(good & wild, f"infinite {c}")]
            typed = typed.withColumn(f"_t_{c}", F.when(good & ~wild, value))
    typed = typed.withColumn("_found", F.array_compact(F.array(*reasons)))
    typed = typed.select(*[c for c in rows.columns if c not in types and c != CORRUPT], *[F.col(f"_t_{c}").alias(c) for c in types], "_found")
    # statistics of each key over its readable numbers
    bounds = typed.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in numbers])
    held = beside(typed, bounds, keys, "left")
    far = [named(F.abs(F.col(c) - F.col(f"_q_{c}")[1]) > times * (F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]), f"outlier {c}") for c in numbers]
    later = F.lead(F.lit(1)).over(ordered([*keys, ts], order)).isNotNull()
    repeated = named(F.col(ts).isNotNull() & later, "repeated")
    return held.withColumn("reasons", F.concat("_found", F.array_compact(F.array(*far, repeated)))).drop("_found", *[f"_q_{c}" for c in numbers])


def parted(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clean rows, and the others with their line and reasons."""
    return marked.filter(F.size("reasons") == 0).drop("reasons", "_line"), marked.filter(F.size("reasons") > 0)


def reason_counts(marked: DataFrame) -> DataFrame:
    """reason, n: how often each occurs (clean: rows without any)."""
    reasons = F.when(F.size("reasons") == 0, F.array(F.lit("clean"))).otherwise(F.col("reasons"))
    return marked.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
