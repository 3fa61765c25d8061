"""Records of CSV files whose quoted fields hold line breaks, cut in parallel.

Whether a line break ends a record depends on all quotes before it in the file. For each
line it is known what it does to that state: it keeps it, swaps it, or sets it whatever it
was. Such steps can be put together in any grouping, so they are first put together inside
runs of up to ``RUN_LINES`` lines of a file block, then over the runs of a file (one row for
each run), which gives every run the state it starts in. A second pass cuts all runs at their
true record ends. Runs, not blocks, are dealt to tasks, so no window holds a whole block.

A record is where its first line is; the lines of a record that several lines make up,
also over borders of runs and blocks, meet by that place. All other lines are records as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, BLOCK, PLACE = "_file", "_block", "_place"
RECORD = "_record"
RUN = "_run"
RUN_LINES = 4096  # a power of two
_OF_RUN = [FILE, BLOCK, RUN]
HEADER = "_header"

# What a line does to the state (0 outside of quotes, 1 inside): keep, swap, set to 0, set to 1.
_KEEP, _SWAP, _SET = 0, 1, 2

# A quote opens a field only as its first character; two quotes inside are one of the text.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'^{_FIELDS}"{_INSIDE}$'
_STAYS_OPEN = rf'^{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?$'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file block, their order in it and their run."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(PLACE),
        F.col("value").alias("line"),
    )
    return lines.withColumn(RUN, _run(F.col(PLACE)))


def _run(place: Column) -> Column:
    return F.shiftright(place, RUN_LINES.bit_length() - 1)


def _step() -> Column:
    """What a line does to the state."""
    from_outside, from_inside = F.col("line").rlike(_OPENS), F.col("line").rlike(_STAYS_OPEN)
    moved = (
        F.when(from_outside & from_inside, _SET + 1)
        .when(from_outside, _SWAP)
        .when(from_inside, _KEEP)
        .otherwise(_SET)
    )
    return F.when(F.contains("line", F.lit('"')), moved).otherwise(_KEEP)


def _together(df: DataFrame, step: str, into: str, order: Window) -> DataFrame:
    """The steps of all rows up to each one put together."""
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_swaps", F.sum((F.col(step) == _SWAP).cast("int")).over(upto))
    was_set = F.when(F.col(step) >= _SET, F.struct((F.col(step) - _SET).alias("to"), F.col("_swaps").alias("at")))
    df = df.withColumn("_last", F.last(was_set, ignorenulls=True).over(upto))
    since = (F.col("_last.to") + F.col("_swaps") - F.col("_last.at")) % 2 + _SET
    return df.withColumn(into, F.when(F.col("_last").isNotNull(), since).otherwise(F.col("_swaps") % 2)).drop("_swaps", "_last")


def _state(start: Column, step: Column) -> Column:
    return F.when(step >= _SET, step - _SET).otherwise((start + step) % 2)


def _before(step: str, order: Window) -> Column:
    """The steps of all earlier rows put together."""
    return F.coalesce(F.lag(step).over(order), F.lit(_KEEP))


def _run_states(lines: DataFrame) -> DataFrame:
    """For each run: the state it starts in, where the record open there began, the header's place."""
    in_run = Window.partitionBy(*_OF_RUN).orderBy(PLACE)
    quoted = lines.filter(F.contains("line", F.lit('"'))).select(*_OF_RUN, PLACE, _step().alias("step"))
    quoted = _together(quoted, "step", "upto", in_run).withColumn("earlier", _before("upto", in_run))

    def opened(start: int) -> Column:
        """Where the last record opened if the run starts in this state."""
        outside = _state(F.lit(start), F.col("earlier")) == 0
        return F.max(F.when(outside & (_state(F.lit(start), F.col("upto")) == 1), F.col(PLACE)))

    moves = quoted.groupBy(*_OF_RUN).agg(
        F.max_by("upto", PLACE).alias("step"), opened(0).alias("open0"), opened(1).alias("open1")
    )
    text = F.when(F.rtrim(F.col("line"), F.lit("\r")) != "", F.col(PLACE))
    runs = lines.groupBy(*_OF_RUN).agg(
        F.min(text).alias("first_text"), F.min_by(F.endswith("line", F.lit("\r")), PLACE).alias("returns")
    )
    runs = runs.join(moves, _OF_RUN, "left").fillna(_KEEP, ["step"])
    by_run = Window.partitionBy(FILE).orderBy(BLOCK, RUN)  # one row for each run
    earlier = by_run.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(FILE)
    states = _together(runs, "step", "upto", by_run).withColumn("start", _state(F.lit(0), _before("upto", by_run)))
    opened_here = F.when(F.col("start") == 0, F.col("open0")).otherwise(F.col("open1"))
    states = states.withColumn("opened", F.when(opened_here.isNotNull(), F.struct(F.col(BLOCK).alias("b"), opened_here.alias("p"))))
    texts = F.when(F.col("first_text").isNotNull(), F.struct(F.col(BLOCK).alias("b"), F.col("first_text").alias("p")))
    return states.select(
        *_OF_RUN,
        "start",
        F.last("opened", ignorenulls=True).over(earlier).alias("open"),
        F.min(texts).over(whole).alias("header"),
        F.min_by("returns", F.struct(BLOCK, RUN)).over(whole).alias("returns"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record that is not empty: where it begins, its text, whether it is the header.

    Line ends are line feeds, or carriage return and line feed where a file's first line
    ends so; those inside of a record become line feeds. A record that is still open at a
    file's end ends there, without the last line end.
    """
    lines = _lines(spark, path)
    in_run = Window.partitionBy(*_OF_RUN).orderBy(PLACE)
    placed = lines.withColumn("step", _step()).join(_run_states(lines), _OF_RUN)
    clean = F.when(F.col("returns"), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    placed = _together(placed.withColumn("line", clean), "step", "upto", in_run)
    placed = placed.withColumns(
        {"inside": _state(F.col("start"), _before("upto", in_run)) == 1, "goes_on": _state(F.col("start"), F.col("upto")) == 1}
    )
    began = F.last(F.when(~F.col("inside"), F.col(PLACE)), ignorenulls=True).over(in_run)
    here = F.struct(F.col(BLOCK).alias("b"), began.alias("p"))
    placed = placed.withColumn("began", F.when(began.isNotNull(), here).otherwise(F.col("open")))
    is_header = F.col("began") == F.col("header")
    alone = placed.filter(~F.col("inside") & ~F.col("goes_on") & (F.col("line") != "")).select(
        FILE, BLOCK, PLACE, F.col("line").alias(RECORD), is_header.alias(HEADER)
    )
    parts = placed.filter(F.col("inside") | F.col("goes_on"))
    parts = parts.groupBy(FILE, "began", is_header.alias(HEADER)).agg(
        F.array_sort(F.collect_list(F.struct(BLOCK, PLACE, "line"))).alias("lines")
    )
    joined = parts.select(
        FILE,
        F.col("began.b").alias(BLOCK),
        F.col("began.p").alias(PLACE),
        F.array_join(F.col("lines.line"), "\n").alias(RECORD),
        HEADER,
    )
    return alone.unionByName(joined)
