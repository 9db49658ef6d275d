"""Refinement and rewriting from end to end: chunk, generate, put together, accept.

A document stays one row throughout: its chunks are an array, a model's outputs are an array beside it, and nothing is
shuffled. Models get the chunks of many rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, join_outputs, labelled_lines, token_estimate
from . import chunking, programs
from .models import ProgramModel, prompt


def generate_arrays(df: DataFrame, prompts: str, make: Callable[[], ProgramModel], name: str, batch: int = 256) -> DataFrame:
    """Adds `name`, the model's outputs for the row's array of prompts, and `name`_error. A failing batch gives null outputs and says why; no row is lost.

    The rows' other columns pass through Arrow as they are, so neither texts nor outputs are shuffled.
    """
    kinds = df.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + f", `{name}` array<string>, `{name}_error` string"
    names = df.columns
    at = names.index(prompts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            lists = b.column(at).to_pylist()
            flat = [p or "" for x in lists for p in x or []]
            made: list[str | None] = []
            failed: list[str | None] = []
            for i in range(0, len(flat), batch):
                part = flat[i : i + batch]
                try:
                    found = model.programs(part)
                    if len(found) != len(part):
                        raise ValueError("the model gave another number of outputs than it got prompts")
                    made += found
                    failed += [None] * len(part)
                except Exception as e:  # the rows say what happened
                    made += [None] * len(part)
                    failed += [f"{type(e).__name__}: {e}"[:200]] * len(part)
            outputs, errors, i = [], [], 0
            for x in lists:
                n = len(x or [])
                outputs.append(made[i : i + n])
                errors.append(next((e for e in failed[i : i + n] if e), None))
                i += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outputs, pa.list_(pa.string())), pa.array(errors, pa.string())], [*names, name, f"{name}_error"])

    return df.mapInArrow(run, out)


class LineRuleModel:
    """Stands in for a language model: reads labelled lines, drops those that stood in the same prompt before and bare addresses, makes double blanks single."""

    def programs(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            seen: set[str] = set()
            calls = []
            for line in p.removeprefix("[doc]\n").removesuffix("\n[/doc]").split("\n"):
                number, _, text = line[1:].partition("]")
                if text.strip(" ") and text in seen or text.startswith(("http://", "https://")) and " " not in text:
                    calls.append(f"remove_lines(line_start={int(number)}, line_end={int(number)})")
                seen.add(text)
            if "  " in p:
                calls.append('normalize(source_str="  ", target_str=" ")')
            out.append("\n".join(calls) or "keep_all()")
        return out


class BlankRewriter:
    """Stands in for a model that writes chunks anew: double blanks become single."""

    def programs(self, prompts: list[str]) -> list[str]:
        return [p.replace("  ", " ") for p in prompts]


def refine_in_chunks(df: DataFrame, text: str, make: Callable[[], ProgramModel] = LineRuleModel, budget: int = 1_500, **limits) -> DataFrame:
    """Every document refined by the programs of its chunks: adds chunks (their number), program, errors, edited, removed_lines, status and refined.

    Lines keep their numbers in the whole text, so the chunks' programs, one after another, are a program of the document. The empty text has no chunk.
    limits: those of programs.accept.
    """
    rest = df.columns
    body = lambda s: F.array_join(F.slice("__lines", s["first"] + 1, s["last"] - s["first"] + 1), "\n")
    done = df.withColumn("__lines", labelled_lines(filled(F.col(text)))).withColumn("__spans", chunking.line_spans(F.transform("__lines", lambda x: token_estimate(x)), budget))
    prompts = F.when(filled(F.col(text)) == "", F.array().cast("array<string>")).otherwise(F.transform("__spans", lambda s: prompt(body(s))))
    done = generate_arrays(done.withColumn("__prompts", prompts).select(*rest, "__prompts"), "__prompts", make, "__programs")
    parts = F.transform("__programs", lambda p: F.trim(filled(p)))
    done = done.select(*rest, F.size("__programs").cast("bigint").alias("chunks"), F.array_join(parts, "\n").alias("program"), F.col("__programs_error").alias("model_error"))
    return programs.accept(programs.execute(done, text, "program"), text, **limits)


def rewrite_in_chunks(df: DataFrame, text: str, make: Callable[[], ProgramModel] = BlankRewriter, size: int | Column = 1_000) -> DataFrame:
    """Every document written anew chunk by chunk: adds num_chunks, programs (the chunks' outputs), programs_delimited and model_error."""
    rest = df.columns
    done = df.withColumn("__ends", chunking.character_cuts(filled(F.col(text)), F.lit(size) if isinstance(size, int) else size))
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("__ends", i - 1))
    done = done.withColumn("__chunks", F.transform("__ends", lambda e, i: F.substring(filled(F.col(text)), start(i) + 1, e - start(i))))
    done = generate_arrays(done.select(*rest, "__chunks"), "__chunks", make, "programs")
    return done.select(*rest, F.size("programs").cast("bigint").alias("num_chunks"), "programs", join_outputs(F.transform("programs", filled)).alias("programs_delimited"), F.col("programs_error").alias("model_error"))


def merge_rewrites(df: DataFrame, parts: str, is_code: bool = False) -> DataFrame:
    """A rewritten row as its source has it: the joined outputs go into raw_content and text, as far as there are such columns, else into a new text.

    For code the outputs are programs and go into programs and programs_delimited instead.
    """
    if is_code:
        return df.withColumn("programs", F.col(parts)).withColumn("programs_delimited", join_outputs(F.transform(parts, filled)))
    joined = F.array_join(F.transform(parts, filled), "")
    targets = [c for c in ("raw_content", "text") if c in df.columns][:1] or ["text"]
    return df.withColumns({c: joined for c in targets})


def stopped_chunks(parts: Column, reasons: Column) -> Column:
    """How many of a row's chunks stopped at the model's limit."""
    return F.size(F.filter(F.zip_with(parts, reasons, lambda _, r: F.coalesce(F.lower(F.trim(r)).isin("length", "max_tokens"), F.lit(False))), lambda x: x)).cast("bigint")


def pair_counts(df: DataFrame, inputs: Column, outputs: Column) -> DataFrame:
    """documents, changed (an output differs from its input), dropped (nothing came out) and mismatched (another number of outputs)."""
    same = F.size(inputs) == F.size(outputs)
    empty = F.trim(F.array_join(outputs, "")) == ""
    return df.agg(F.count("*").alias("documents"), F.count_if(same & ~empty & (inputs != outputs)).alias("changed"), F.count_if(empty).alias("dropped"), F.count_if(~same).alias("mismatched"))


def in_order(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """group, rows and gaps: whether the positions of each group are 0, 1, 2, ... without gaps and repeats. Only counts are gathered."""
    n = F.count("*")
    broken = (F.min(position) != 0) | (F.max(position) != n - 1) | (F.count_distinct(position) != n)
    return df.groupBy(*group).agg(n.alias("rows"), F.coalesce(broken, F.lit(True)).alias("has_gaps"))


def without_gaps(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """df, if every group is complete; else an error that names one that is not."""
    bad = in_order(df, group, position).where("has_gaps").select(*group).first()
    if bad is not None:
        raise ValueError(f"rows are missing or repeated in {bad.asDict()}")
    return df

