"""Program generators. A language model is plugged in behind ProgramModel; RuleModel stands in for one offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines


class ProgramModel(Protocol):
    """Programs for a batch of prompts, in order. Made once for each Python worker."""

    def programs(self, prompts: list[str]) -> list[str]: ...


def prompt(chunk: Column) -> Column:
    """A chunk as the model gets it."""
    return F.concat(F.lit("[doc]\n"), chunk, F.lit("\n[/doc]"))


def generate(df: DataFrame, key: list[str], prompt_column: str, make: Callable[[], ProgramModel], batch: int = 256) -> DataFrame:
    """key, program and error of every row; a failing batch gives error rows and no lost job. Only key and prompt go to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            prompts = b.column(len(key)).to_pylist()
            programs: list[str | None] = []
            errors: list[str | None] = []
            for i in range(0, len(prompts), batch):
                part = [p or "" for p in prompts[i : i + batch]]
                try:
                    found = model.programs(part)
                    if len(found) != len(part):
                        raise ValueError("the model gave another number of programs than it got prompts")
                    programs += found
                    errors += [None] * len(part)
                except Exception as e:  # the rows say what happened
                    programs += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"[:200]] * len(part)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(key))), pa.array(programs, pa.string()), pa.array(errors, pa.string())], [*key, "program", "error"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, prompt_column).mapInArrow(run, f"{kinds}, program string, error string")


def with_rule_program(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a deterministic program: a line goes where it stood in the text before, or is nothing but an address; double blanks become single.

    Lines are sorted with their numbers, so that equal ones lie side by side.
    """
    body, rows = F.col(text), "__rows"
    done = df.withColumn(rows, F.sort_array(F.transform(lines(body), lambda x, i: F.struct(x.alias("line"), i.alias("at")))))
    again = lambda x, i: (F.trim(x["line"]) != "") & (i > 0) & (F.get(F.col(rows), i - 1)["line"] == x["line"])
    gone = F.filter(F.transform(rows, lambda x, i: F.when(again(x, i) | x["line"].rlike("^https?://[^ ]*$"), x["at"]).otherwise(-1)), lambda i: i >= 0)
    done = done.withColumn("__at", F.sort_array(gone))
    calls = F.transform("__at", lambda i: F.concat(F.lit("remove_lines(line_start="), i.cast("string"), F.lit(", line_end="), i.cast("string"), F.lit(")")))
    blanks = F.when(F.contains(body, F.lit("  ")), F.array(F.lit('normalize(source_str="  ", target_str=" ")'))).otherwise(F.array().cast("array<string>"))
    done = done.withColumn(name, F.array_join(F.concat(calls, blanks), "\n"))
    return done.withColumn(name, F.when(F.col(name) == "", "keep_all()").otherwise(F.col(name))).drop(rows, "__at")
