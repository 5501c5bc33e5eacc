"""Delimited files and data-quality checks (Q1-Q5).

``verify_constraints`` turns the constraint rows into aggregates over the table
(partial per task) and unpivots them to one row per constraint row; distinct counts and
bounds on text, which have no hash aggregate, are a pass each for all columns together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.distinct import distinct_counts

# The control grammar's two clauses.
_SEP = r"(?i)FIELDS\s+TERMINATED\s+BY\s+'([^']+)'"
_QUOTE = r"(?i)OPTIONALLY\s+ENCLOSED\s+BY\s+'([^']+)'"

# The constraint kinds understood by verify_constraints.
CHECK_KINDS = ["type", "min", "max", "sign", "max_nulls", "no_duplicates", "allowed_values",
               "min_length", "max_length", "rex"]


def control_lookup(requests: DataFrame, control: DataFrame) -> DataFrame:
    """Q1: the control text of every requested ``file_id``; an id without one is
    reported (``found = false``) rather than failing the whole batch."""
    return requests.select("file_id").join(control.select("file_id", "ctl_config"), "file_id", "left") \
        .withColumn("found", F.col("ctl_config").isNotNull())


def parse_control(ctl: Column) -> tuple[Column, Column]:
    """Q2: separator from ``FIELDS TERMINATED BY '…'`` (default ``,``) and quote
    from ``OPTIONALLY ENCLOSED BY '…'`` (default ``"``), case-insensitive."""
    sep = F.coalesce(F.nullif(F.regexp_extract(ctl, _SEP, 1), F.lit("")), F.lit(","))
    quote = F.coalesce(F.nullif(F.regexp_extract(ctl, _QUOTE, 1), F.lit("")), F.lit('"'))
    return sep, quote


def load_delimited(spark, path: str, columns: Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Q3: read delimited text with every column as string. A line with too many
    fields is skipped, a short line is padded with NULL. One sentinel column
    past the declared ones tells the two apart: it is set only on long lines."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("__extra", T.StringType())])
    df = spark.read.schema(schema).option("sep", sep).option("quote", quote).option("mode", "PERMISSIVE").csv(path)
    return df.where(F.col("__extra").isNull()).drop("__extra")


CHECKS_PER_PASS = 400


def _kind_of(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string"


def _measure(check: str, expected: str, field: T.StructField):
    """(aggregate, or min or max where it is a bound on text, and functions of its value:
    measured number, measured text, verdict).

    Bounds compare in the field's own type: numbers as numbers, dates as dates, other values
    as text. Counts of misses must be 0 (``max_nulls``: within the limit)."""
    c, kind = F.col(f"`{field.name}`"), _kind_of(field.dataType)
    limit = F.lit(expected).try_cast("double")

    def number(x):
        return x.cast("double")

    def text(x):
        return x.cast("string")

    def no_number(x):
        return F.lit(None).cast("double")

    def no_text(x):
        return F.lit(None).cast("string")

    def within(value, bound, low):
        return lambda x: value(x) >= bound if low else value(x) <= bound

    if check == "type":
        return F.count(F.lit(1)), no_number, lambda x: F.lit(kind), lambda x: F.lit(kind == expected)
    if check in ("min", "max"):
        low = check == "min"
        best = F.min(c) if low else F.max(c)
        if kind in ("int", "real"):
            return best, number, no_text, within(number, limit, low)
        if kind == "date":
            bound = F.lit(expected).try_cast("timestamp_ntz")
            return (best, no_number, lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss"),
                    within(lambda x: x.cast("timestamp_ntz"), bound, low))
        # the least or greatest text comes from _text_bounds: an aggregate over text can't hash
        return check, no_number, no_text, lambda x: F.lit(None).cast("boolean")
    if check in ("min_length", "max_length"):
        low, size = check == "min_length", F.length(c.cast("string"))
        return F.min(size) if low else F.max(size), number, no_text, within(number, limit, low)
    if check == "max_nulls":
        return F.count_if(c.isNull()), number, no_text, within(number, limit, False)
    if check == "no_duplicates":
        misses = F.count(c)  # less the distinct values, which one shuffle counts for all such checks
    elif check == "sign":
        if kind not in ("int", "real"):  # has no sign: not measured
            return F.count(F.lit(1)), no_number, no_text, lambda x: F.lit(False)
        bad = {"positive": c <= 0, "non-negative": c < 0, "zero": c != 0, "non-positive": c > 0, "negative": c >= 0}
        misses = F.count_if(bad[expected])
    elif check == "allowed_values":
        allowed = [v.strip() for v in expected.split("|")]
        misses = F.count_if(c.isNotNull() & ~c.cast("string").isin(allowed))
    elif check == "rex":
        misses = F.count_if(c.isNotNull() & ~c.cast("string").rlike(expected))
    else:
        raise ValueError(f"unknown check kind: {check}")
    return misses, number, no_text, lambda x: x == 0


RESULT_SCHEMA = "table_name string, field string, check string, expected string, actual double, actual_text string, passes boolean"


def _text_bounds(df: DataFrame, columns: dict[int, str], check: str) -> DataFrame:
    """``entry, bound``: the least (``min``) or greatest text of each entry's column, for all of
    them in one pass. Every task keeps one value per entry before the shuffle."""
    cells = [F.struct(F.lit(i).alias("entry"), F.col(f"`{c}`").cast("string").alias("bound")) for i, c in columns.items()]
    order = F.col("bound").asc() if check == "min" else F.col("bound").desc()
    first = F.row_number().over(Window.partitionBy("entry").orderBy(order))
    return df.select(F.inline(F.array(*cells))).where("bound is not null").withColumn("_place", first).where("_place = 1").drop("_place")


def _one_pass(df: DataFrame, group: list, fields: dict, table: str) -> DataFrame:
    made = [_measure(r["check"], r["expected"], fields[r["field"]]) for r in group]
    bounds = {i: m[0] for i, m in enumerate(made) if isinstance(m[0], str)}
    plain = [m[0].alias(f"a{i}") for i, m in enumerate(made) if i not in bounds]
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *plain)
    stats = stats.withColumns({f"a{i}": F.lit(None).cast("string") for i in bounds}) if bounds else stats
    entries = [
        F.struct(F.lit(i).alias("entry"), F.lit(r["field"]).alias("field"), F.lit(r["check"]).alias("check"), F.lit(r["expected"]).alias("expected"),
                 number(F.col(f"a{i}")).alias("actual"), text(F.col(f"a{i}")).alias("actual_text"),
                 F.coalesce(passes(F.col(f"a{i}")), F.lit(False)).alias("passes"))
        for i, (r, (_, number, text, passes)) in enumerate(zip(group, made, strict=True))
    ]
    rows = stats.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))
    once = [i for i, r in enumerate(group) if r["check"] == "no_duplicates"]
    if once:
        columns = list(dict.fromkeys(group[i]["field"] for i in once))
        of_entry = F.element_at(F.create_map(*[F.lit(x) for i in once for x in (i, columns.index(group[i]["field"]))]), F.col("entry"))
        counts = distinct_counts(df, columns)
        rows = rows.join(counts, F.when(F.col("entry").isin(once), of_entry) == F.col("column_no"), "left")
        left = F.col("actual") - F.coalesce("distinct_count", F.lit(0))
        rows = rows.withColumns({"actual": F.when(F.col("entry").isin(once), left).otherwise(F.col("actual")),
                                 "passes": F.when(F.col("entry").isin(once), left == 0).otherwise(F.col("passes"))})
    for check in sorted(set(bounds.values())):
        found = _text_bounds(df, {i: group[i]["field"] for i, c in bounds.items() if c == check}, check)
        meets = F.col("bound") >= F.col("expected") if check == "min" else F.col("bound") <= F.col("expected")
        rows = rows.join(found, "entry", "left").withColumns({
            "actual_text": F.coalesce("bound", "actual_text"), "passes": F.coalesce(meets, F.col("passes"))}).drop("bound")
    return rows.select("table_name", "field", "check", "expected", "actual", "actual_text", "passes")


def verify_constraints(df: DataFrame, constraints: DataFrame, table: str) -> DataFrame:
    """One row per constraint row: expected, measured, passes.

    Constraints are configuration; they become aggregate expressions, up to
    ``CHECKS_PER_PASS`` per pass over the table, and each measures itself, so several checks
    of one kind on a field stay apart. A check that can't be measured (an expected value that
    does not fit the field's type, a bound on a field without values) does not pass."""
    fields = {f.name: f for f in df.schema.fields}
    rows = constraints.where(F.col("table_name") == table).select("field", "check", "expected").collect()
    out = df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    for first in range(0, len(rows), CHECKS_PER_PASS):
        part = _one_pass(df, rows[first:first + CHECKS_PER_PASS], fields, table)
        out = part if not first else out.unionByName(part)
    return out


def quality_run_log(results: DataFrame, constraint_file: str) -> DataFrame:
    """Q4: one row per checked table: passes (all checks), counts and summary."""
    return results.groupBy("table_name").agg(
        F.bool_and("passes").alias("passes"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passes")).alias("failures"),
    ).select(
        "table_name", F.lit(constraint_file).alias("constraint_file"),
        F.when(F.col("passes"), "Y").otherwise("N").alias("passes"), "checks", "failures",
        F.format_string("%d checks, %d failures", F.col("checks"), F.col("failures")).alias("summary"),
    )


def _num_text(c: Column) -> Column:
    return F.coalesce(c.cast("decimal(20,4)").cast("string"), F.lit("null"))


def quality_details(results: DataFrame) -> DataFrame:
    """Q5: one row per (field, check), passing ones too, with Y/N and a JSON
    detail."""
    actual = F.coalesce(F.col("actual_text"), _num_text(F.col("actual")))
    details = F.to_json(F.struct("check", "expected", actual.alias("actual"), "passes"))
    return results.select(
        "table_name", F.col("field").alias("field_name"), F.col("check").alias("check_type"),
        F.col("expected").alias("expected_value"), actual.alias("actual_value"),
        F.when(F.col("passes"), "Y").otherwise("N").alias("passes"), details.alias("details_json"),
    )
