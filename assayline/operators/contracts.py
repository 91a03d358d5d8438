"""Contract validation: typed valid rows and an error row for each broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.names import free_names
from ..functions.scratch import written
from ..sources.schemas import CONTRACTS, ENUMS, Field

_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "date": "date", "url": "string", "enum": "string"}


def fields_of(contract: str) -> tuple[Field, ...]:
    return CONTRACTS[contract].fields


def with_row_numbers(df: DataFrame, column: str = "row_number", first: int = 2) -> DataFrame:
    """Numbers in the rows' own order, without a sort. ``df`` is read once and written with its rows' places in their
    tasks, so numbers stay when tasks are done again; a row a task is counted up and joined."""
    line, part, n, start = free_names(df.withColumn(column, F.lit(None)), "_line", "_part", "_n", "_start")
    kinds = [kind for _, kind in df.dtypes]
    plain = df.toDF(*[f"c{i}" for i in range(len(kinds))])  # any name can be written, but no column without a type
    plain = plain.withColumns({f"c{i}": F.col(f"c{i}").cast("string") for i, kind in enumerate(kinds) if kind == "void"})
    rows = written(plain.withColumn(line, F.monotonically_increasing_id()).withColumn(part, F.shiftright(line, 33)), "numbered")
    counted = rows.groupBy(part).agg(F.count("*").alias(n), F.min(line).alias(start))
    upto = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = written(counted.select(part, (F.coalesce(F.sum(n).over(upto), F.lit(0)) + first - F.col(start)).alias(start)), "starts")
    found = rows.join(starts, part)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c != column], (F.col(start) + F.col(line)).cast("long").alias(column))


def _text(name: str) -> Column:
    return F.trim(F.col(f"`{name}`").cast("string"))


def as_date(name: str) -> Column:
    """The column as a date: ``yyyy-MM-dd`` and nothing else, but for a time that is midnight; null where it is something else."""
    text = _text(name)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0+)?)?)?$"), F.substring(text, 1, 10))
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")


def typed(field: Field) -> Column:
    """The field as its type, null where it can't be."""
    text = _text(field.name)
    blank = F.when(F.lower(text) != "nan", text)
    number = F.when(blank.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr(f"try_cast(trim(cast(`{field.name}` as string)) as double)"))
    finite = F.when(F.abs(number) < float("inf"), number)
    if field.kind == "int":
        return F.when(finite == F.floor(finite), finite).cast("bigint")
    if field.kind == "float":
        return finite
    if field.kind == "bool":
        low = F.lower(blank)
        return F.when(low.isin("true", "1", "yes", "y", "on", "t", "1.0"), True).when(low.isin("false", "0", "no", "n", "off", "f", "0.0"), False)
    if field.kind == "date":
        return as_date(field.name)
    return text


def _given(name: str) -> Column:
    """Not null; a floating NaN counts as null."""
    return F.col(f"`{name}`").isNotNull() & (F.lower(_text(name)) != "nan")


def field_errors(field: Field, value: Column) -> list[Column]:
    """Codes of what is wrong with one field, null where nothing is; ``value`` is the typed field."""
    given = _given(field.name)
    code = lambda what: F.lit(f"{field.name}:{what}")
    out = []
    if field.need != "nullable":
        out.append(F.when(~given, code("missing")))
    if field.kind == "str" and field.need == "required":
        out.append(F.when(given & (F.length(value) == 0), code("empty")))
    if field.kind in ("int", "float", "bool", "date"):
        out.append(F.when(given & value.isNull(), code(f"not_{field.kind}")))
    if field.kind == "url":
        out.append(F.when(given & ~value.rlike(r"^https?://[^/\s]+"), code("not_url")))
    if field.kind == "enum":
        out.append(F.when(given & ~value.isin(*ENUMS[field.vocabulary]), code("not_in_vocabulary")))
    for sign, bound in field.limits:
        within = {">=": value >= bound, ">": value > bound, "<=": value <= bound}[sign]
        out.append(F.when(~within, code("out_of_range")))
    return out


def validate(df: DataFrame, contract: str, row_number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(valid, errors)``: rows typed by the contract, and ``(row_number, error)`` for each thing that is wrong.

    A missing required column, or an empty table, gives one error of row 1. Unknown
    columns fail every row. Cross-field rules are looked at where the fields
    themselves are right. Among valid rows all members of a repeated key fail.
    Rows are numbered from 2 in their order, or by ``row_number``.
    """
    spec, fields = CONTRACTS[contract], fields_of(contract)
    spark = df.sparkSession
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {_TYPES[f.kind]}" for f in fields)
    lost = [f.name for f in fields if f.need == "required" and f.name not in df.columns]
    alone = ["missing_columns:" + "|".join(lost)] if lost else ["empty_table"] if df.isEmpty() else []
    if alone:
        return spark.createDataFrame([], schema), spark.createDataFrame([(1, alone[0])], "row_number long, error string")
    numbered = df.withColumnRenamed(row_number, "_row") if row_number else with_row_numbers(df, "_row")
    unknown = sorted(set(df.columns) - set(names) - {row_number})
    present = [f for f in fields if f.name in df.columns]
    values = {f.name: typed(f) for f in present}
    shaped = numbered.select(
        "_row",
        *[(values[f.name] if f.name in values else F.lit(f.default)).cast(_TYPES[f.kind]).alias(f.name) for f in fields],
        F.array_compact(F.array(
            *[F.lit(f"unknown_column:{c}") for c in unknown], *[e for f in present for e in field_errors(f, values[f.name])], F.lit(None).cast("string")
        )).alias("_wrong"),
    )
    # Written once: valid rows and errors are two readings of the same typed rows.
    shaped = written(shaped, "typed")
    rules = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(f"rule:{name}")) for name, test in spec.rules], F.lit(None).cast("string")))
    judged = shaped.withColumn("_wrong", F.when(F.size("_wrong") > 0, F.col("_wrong")).otherwise(rules))
    right = judged.where(F.size("_wrong") == 0).withColumn("_same", F.count("*").over(W.partitionBy(*spec.key)))
    wrong = judged.where(F.size("_wrong") > 0).select(F.col("_row").alias("row_number"), F.explode("_wrong").alias("error"))
    repeated = right.where("_same > 1").select(F.col("_row").alias("row_number"), F.lit("duplicate_key").alias("error"))
    return right.where("_same = 1").select(*names), wrong.unionByName(repeated)
