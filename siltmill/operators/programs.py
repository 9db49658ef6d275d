"""Edit programs: parsing, execution and acceptance, as native expressions.

A program is a list of lines. `remove_lines(x=S, y=E)` removes lines S to E of the text (from 0, both included),
`remove_lines(all=True)` removes all, `normalize(x="s")` deletes a string, `normalize(x="s", y="t")` replaces it; other
lines do nothing. Malformed lines and ranges beyond the text are counted as errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, lines, word_count

OPS = "array<struct<kind:string,first:bigint,last:bigint,source:string,target:string,errors:int>>"


def _integer(text: Column) -> Column:
    """A whole number as Python reads it: blanks around it, a sign, single underscores between digits."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, '^"+|"+$', "")


def _parsed(line: Column) -> Column:
    removes, normalizes = F.startswith(line, F.lit("remove_lines")), F.startswith(line, F.lit("normalize"))
    everything = removes & F.contains(line, F.lit("all=True"))
    opening, closing = F.instr(line, "("), F.instr(line, ")")
    # Without a closing bracket the last character is lost and an error counted.
    stop = F.when(closing > 0, closing).otherwise(F.length(line))
    inner = F.substring(line, opening + 1, F.greatest(stop - opening - 1, F.lit(0)))
    unclosed = F.when(closing == 0, 1).otherwise(0)
    parts = F.split(inner, ",", -1)
    value = lambda i: F.get(F.split(F.get(parts, F.lit(i)), "=", -1), F.lit(1))
    one, two = value(0), value(1)
    start, end = _integer(one), _integer(two)
    none = F.lit(None)
    op = lambda kind, errors, first=none, last=none, source=none, target=none: F.struct(
        F.lit(kind).alias("kind"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), source.cast("string").alias("source"), target.cast("string").alias("target"), errors.cast("int").alias("errors")
    )
    count = F.size(parts)
    return (
        F.when(everything, op("all", F.lit(0)))
        .when((removes | normalizes) & (opening == 0), op("error", F.lit(1)))
        .when(removes & start.isNotNull() & end.isNotNull(), op("remove", unclosed, start, end))
        .when(removes, op("error", unclosed + 1))
        .when(normalizes & (count == 1) & one.isNotNull(), op("delete", unclosed, source=_unquoted(one), target=F.lit("")))
        .when(normalizes & (count == 2) & one.isNotNull() & two.isNotNull(), op("replace", unclosed, source=_unquoted(one), target=_unquoted(two)))
        .when(normalizes & (count <= 2), op("error", unclosed + 1))
        .when(normalizes, op("other", unclosed))
        .otherwise(op("other", F.lit(0)))
    )


def parse_program(program: Column) -> Column:
    """Operations of the program's lines, in order."""
    return F.transform(F.split(F.regexp_replace(filled(program), "^ +| +$", ""), "\n", -1), _parsed)


def ranges_of(ops: Column) -> Column:
    """The removals, as a position and a range each."""
    return F.filter(F.transform(ops, lambda o, i: F.when(o["kind"] == "remove", F.struct(o["first"].alias("first"), i.alias("at"), o["last"].alias("last")))), lambda x: x.isNotNull())


#: Ranges that are folded at a time. Arrays are copied when they grow, so long ones grow in pieces.
PIECE = 256


def _once(column: Column) -> Column:
    """The column behind a barrier: a filter on it is not rewritten in terms of the steps it was made by, which would repeat them many times over.
    Filters on other columns belong before the operator."""
    return F.when(F.spark_partition_id() >= 0, column)


def with_merged_ranges(df: DataFrame, ranges: str, name: str) -> DataFrame:
    """Adds the ranges by start, joined where one begins no later than just behind the end of those before.

    Of sorted ranges one opens a merged range if it begins behind the highest end so far. That end is carried into pieces of PIECE ranges from the
    pieces' own highest ends, so the work grows as the number of ranges and not as its square.
    """
    s, pieces, tops = "__sorted", "__pieces", "__tops"
    least = F.lit(-(1 << 62)).cast("bigint")
    count = F.ceil(F.size(s) / PIECE).cast("int")
    placed = lambda x, i: F.struct(x["first"].alias("first"), i.alias("at"), x["last"].alias("last"))
    done = df.withColumn(s, F.transform(F.sort_array(F.col(ranges)), placed))
    done = done.withColumn(pieces, F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(F.col(s), i * PIECE + 1, PIECE))).otherwise(F.array().cast("array<array<struct<first:bigint,at:int,last:bigint>>>")))
    done = done.withColumn(tops, F.transform(pieces, lambda p: F.array_max(F.transform(p, lambda x: x["last"]))))

    def opened(piece: Column, carried: Column) -> Column:
        def add(state: Column, x: Column) -> Column:
            new = F.array(F.struct(x["first"].alias("first"), x["at"].alias("at")))
            return F.struct(F.when(x["first"] > state["top"] + 1, F.concat(state["opened"], new)).otherwise(state["opened"]).alias("opened"), F.greatest(state["top"], x["last"]).alias("top"))

        start = F.struct(F.array().cast("array<struct<first:bigint,at:int>>").alias("opened"), F.coalesce(carried, least).alias("top"))
        return F.aggregate(piece, start, add, lambda state: state["opened"])

    carried = F.transform(F.col(tops), lambda _, i: F.array_max(F.slice(F.col(tops), F.lit(1), i)))
    done = done.withColumn("__carried", carried).withColumn("__opened", F.flatten(F.zip_with(pieces, "__carried", opened)))
    own = lambda x, i: F.slice(F.col(s), x["at"] + 1, F.coalesce(F.get(F.col("__opened"), i + 1)["at"], F.size(s)) - x["at"])
    merged = F.transform("__opened", lambda x, i: F.struct(x["first"].alias("first"), F.array_max(F.transform(own(x, i), lambda y: y["last"])).alias("last")))
    return done.withColumn(name, _once(merged)).drop(s, pieces, tops, "__carried", "__opened")


def execute(df: DataFrame, text: str, program: str) -> DataFrame:
    """Adds edited, errors, removed_lines (their number), merged (the ranges), removed (the lines themselves) and replaced (source and target of each) to every row.

    The steps are separate projections, so that Spark evaluates the parsed program once for each row. Lines are taken in stretches between the merged
    ranges, so the work grows as lines and ranges together.
    """
    done = df.withColumn("__text", filled(F.col(text))).withColumn("__ops", parse_program(F.col(program)))
    replaced = F.aggregate(
        F.filter("__ops", lambda o: o["kind"].isin("delete", "replace") & (o["source"] != "") & ~((o["kind"] == "replace") & (o["source"] == " "))), F.col("__text"), lambda t, o: F.replace(t, o["source"], o["target"])
    )
    done = done.withColumn("__lines", lines(replaced)).withColumn("__ranges", ranges_of(F.col("__ops")))
    done = done.withColumn("__all", F.exists("__ops", lambda o: o["kind"] == "all"))
    count = F.size("__lines")
    done = with_merged_ranges(done, "__ranges", "merged")
    # ranges that end before they begin take part in the merging but remove nothing, nor does what lies beyond the text
    done = done.withColumn("__real", F.filter("__ranges", lambda r: (r["last"] >= r["first"]) & (r["last"] >= 0) & (r["first"] < count)))
    done = with_merged_ranges(done, "__real", "__gone")
    end = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("__gone"), i - 1)["last"] + 1)
    upto = lambda i: F.coalesce(F.get(F.col("__gone"), i)["first"], count.cast("bigint"))
    stretch = lambda i: F.slice(F.col("__lines"), (F.least(end(i), count) + 1).cast("int"), F.greatest(upto(i) - end(i), F.lit(0)).cast("int"))
    kept = F.when(F.col("__all"), F.array().cast("array<string>")).when(F.size("__gone") == 0, F.col("__lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size("__gone")), stretch)))
    beyond = F.size(F.filter("merged", lambda r: (r["first"] >= count) | (r["last"] >= count)))
    own = F.aggregate("__ops", F.lit(0), lambda n, o: n + o["errors"])
    done = done.withColumn("__kept", kept).withColumn("errors", _once((own + beyond).cast("bigint")))
    done = done.withColumn("edited", _once(F.array_join("__kept", "\n"))).withColumn("removed_lines", _once((count - F.size("__kept")).cast("bigint")))
    within = lambda r: F.slice(F.col("__lines"), F.greatest(r["first"], F.lit(0)).cast("int") + 1, (F.least(r["last"], count - 1) - F.greatest(r["first"], F.lit(0)) + 1).cast("int"))
    removed = F.when(F.col("__all"), F.col("__lines")).otherwise(F.flatten(F.transform("__gone", within)))
    replaced_ = F.transform(F.filter("__ops", lambda o: o["kind"].isin("delete", "replace")), lambda o: F.struct(o["source"].alias("source"), o["target"].alias("target")))
    done = done.withColumn("removed", _once(removed)).withColumn("replaced", _once(replaced_))
    return done.drop("__text", "__ops", "__lines", "__ranges", "__real", "__gone", "__all", "__kept")


def accept(df: DataFrame, text: str, least_share: float = 0.0, drop_share: float = 0.95, most_errors: int = 2, least_words: int = 10) -> DataFrame:
    """Adds status and refined to rows with edited and errors.

    Rules in order: almost all words gone and few errors, empty; few words left, empty whatever the errors; few errors,
    the edited text; else the text as it was. A text without words is empty (status empty_input).
    """
    before, after = word_count(filled(F.col(text))), word_count(F.col("edited"))
    done = df.withColumn("__before", before).withColumn("__after", after)
    share, few = F.try_divide(F.col("__after").cast("double"), F.col("__before").cast("double")), F.col("errors") < most_errors
    status = (
        F.when(F.col("__before") == 0, "empty_input")
        .when((share <= F.lit(1 - drop_share)) & few, "dropped")
        .when(F.col("__after") <= least_words, "too_short")
        .when((share >= F.lit(least_share)) & few, "edited")
        .otherwise("original")
    )
    done = done.withColumn("status", _once(status))
    refined = F.when(F.col("status") == "edited", F.col("edited")).when(F.col("status") == "original", filled(F.col(text))).otherwise("")
    return done.withColumn("refined", refined).drop("__before", "__after")


def document_program(text: Column, program: Column) -> Column:
    """Empty where the program says drop anywhere, else the text."""
    return F.when(F.contains(filled(program), F.lit("drop")), "").otherwise(filled(text))
