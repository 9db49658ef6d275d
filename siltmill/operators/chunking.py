"""Chunks of lines within a token budget, chunks of characters, and gathering what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import labelled_lines, token_estimate

SPANS = "array<struct<first:int,last:int,tokens:bigint>>"


def line_spans(tokens: Column, budget: int) -> Column:
    """First and last line (from 0) and tokens of the chunks of lines with these token counts.

    Lines are added while the sum stays within the budget; a line over the budget is a chunk of its own.
    """
    state = F.struct(F.array().cast(SPANS).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum"))

    def add(s: Column, n: Column) -> Column:
        span = lambda first, last, total: F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), total.cast("bigint").alias("tokens")))
        open_ = s["at"] > s["first"]
        flushed = F.when(open_, F.concat(s["done"], span(s["first"], s["at"] - 1, s["sum"]))).otherwise(s["done"])
        fits, alone = s["sum"] + n <= budget, n > budget
        next_ = s["at"] + 1
        done = F.when(fits, s["done"]).when(alone, F.concat(flushed, span(s["at"], s["at"], n))).otherwise(flushed)
        first = F.when(fits, s["first"]).when(alone, next_).otherwise(s["at"])
        total = F.when(fits, s["sum"] + n).when(alone, F.lit(0)).otherwise(n)
        return F.struct(done.alias("done"), first.cast("int").alias("first"), next_.cast("int").alias("at"), total.cast("bigint").alias("sum"))

    def finish(s: Column) -> Column:
        rest = F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).cast("int").alias("last"), s["sum"].alias("tokens")))
        return F.when(s["at"] > s["first"], F.concat(s["done"], rest)).otherwise(s["done"])

    return F.aggregate(tokens, state, add, finish)


def chunk_lines(df: DataFrame, text: str, budget: int = 1_500, tokens=token_estimate) -> DataFrame:
    """A row for each chunk of labelled lines: the other columns and chunk (from 0), first_line, last_line, chunk_tokens, chunk_text.

    The chunks are made within the row; the whole text is not carried into theirs.
    """
    rest = [c for c in df.columns if c != text]
    done = df.withColumn("__lines", labelled_lines(F.col(text))).withColumn("__spans", line_spans(F.transform("__lines", lambda x: tokens(x)), budget))
    body = lambda s: F.array_join(F.slice("__lines", s["first"] + 1, s["last"] - s["first"] + 1), "\n")
    chunks = F.transform("__spans", lambda s: F.struct(s["first"].alias("first_line"), s["last"].alias("last_line"), s["tokens"].alias("chunk_tokens"), body(s).alias("chunk_text")))
    return done.select(*rest, F.posexplode(chunks).alias("chunk", "__chunk")).select(*rest, "chunk", "__chunk.*")


def character_cuts(text: Column, size: Column, look_back: int = 500) -> Column:
    """Ends of the chunks of a text: each is full, or ends behind the last line feed among its final `look_back` characters."""
    length = F.length(text)
    # no chunk but the last is shorter than this
    least = F.greatest(F.lit(1), size - look_back + 1)
    turns = F.ceil(length / least).cast("int")

    def add(ends: Column, _: Column) -> Column:
        start = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))
        window = F.substring(text, start + 1, size)
        tail_from = F.greatest(F.lit(0), size - look_back)
        tail = F.substring(window, tail_from + 1, size)
        back = F.instr(F.reverse(tail), "\n")
        # place of the line feed in the window, from 0; it must not be the first character
        place = tail_from + F.length(tail) - back
        end = F.when(start + size >= length, length).when((back > 0) & (place > 0), start + place + 1).otherwise(start + size)
        return F.when(start >= length, ends).otherwise(F.concat(ends, F.array(end.cast("int"))))

    whole = F.when(length == 0, F.array().cast("array<int>")).otherwise(F.array(length.cast("int")))
    # a chunk whose window is the whole text needs no search
    return F.when((size <= 0) | (length <= size), whole).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), F.array().cast("array<int>"), add))


def chunk_characters(df: DataFrame, text: str, size: int | Column) -> DataFrame:
    """A row for each chunk of characters: the other columns and chunk (from 0), start, end, chunk_text. The chunks joined are the text."""
    size = F.lit(size) if isinstance(size, int) else size
    rest = [c for c in df.columns if c != text]
    done = df.withColumn("__ends", character_cuts(F.col(text), size))
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("__ends", i - 1))
    chunks = F.transform("__ends", lambda e, i: F.struct(start(i).alias("start"), e.alias("end"), F.substring(F.col(text), start(i) + 1, e - start(i)).alias("chunk_text")))
    return done.select(*rest, F.posexplode(chunks).alias("chunk", "__chunk")).select(*rest, "chunk", "__chunk.*")


def gather(rows: DataFrame, key: list[str], position: str, value: str, separator: str = "\n") -> DataFrame:
    """key, parts and the values joined in the order of their positions; equal positions by value."""
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    return rows.groupBy(*key).agg(ordered.alias("__parts")).select(*key, F.size("__parts").cast("bigint").alias("parts"), F.array_join(F.transform("__parts", lambda p: F.coalesce(p[value], F.lit(""))), separator).alias("joined"))


def gather_all(documents: DataFrame, rows: DataFrame, key: list[str], position: str, value: str, separator: str = "\n") -> DataFrame:
    """gather for every document: those without rows have no parts and the empty text."""
    return documents.select(*key).join(gather(rows, key, position, value, separator), key, "left").na.fill({"parts": 0, "joined": ""})
