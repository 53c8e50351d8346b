"""The ledger of token costs: what an operation cost against doing the same with plain file reads.

A ledger row has output and input tokens and calls of both ways; a call has a fixed overhead of ``CALL_TOKENS`` tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.functions import columns as C

# Fixed values of the cost model.
CALL_TOKENS = 30
SEARCH_TOKENS = 200

_SUMS = ["output_tokens", "alternative_tokens", "files_touched", "engine_input_tokens", "alt_input_tokens", "engine_calls", "alt_calls"]


def entry_total(inputs: Column, output: Column, calls: Column) -> Column:
    return inputs + output + calls * CALL_TOKENS


def with_totals(ledger: DataFrame) -> DataFrame:
    """Rows with total_engine, total_alternative and saved."""
    own = entry_total(F.col("engine_input_tokens"), F.col("output_tokens"), F.col("engine_calls"))
    other = entry_total(F.col("alt_input_tokens"), F.col("alternative_tokens"), F.col("alt_calls"))
    return ledger.withColumns({"total_engine": own, "total_alternative": other, "saved": F.greatest(other - own, F.lit(0))})


def since(ledger: DataFrame, start: str | None) -> DataFrame:
    return ledger if start is None else ledger.where(F.col("created_at") >= F.lit(start).cast("timestamp"))


def by_command(ledger: DataFrame, start: str | None = None) -> DataFrame:
    """(command, operations, sums of all columns), most saved first."""
    grouped = since(ledger, start).groupBy("command").agg(F.count("*").alias("operations"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])
    other = entry_total(F.col("alt_input_tokens"), F.col("alternative_tokens"), F.col("alt_calls"))
    own = entry_total(F.col("engine_input_tokens"), F.col("output_tokens"), F.col("engine_calls"))
    return grouped.orderBy((other - own).desc(), "command")


def report_lines(ledger: DataFrame, start: str | None = None) -> DataFrame:
    """(command, operations, output_tokens, alternative_tokens, saved, percent): savings of each command, clamped at 0."""
    saved = F.greatest(F.col("alternative_tokens") - F.col("output_tokens"), F.lit(0))
    return by_command(ledger, start).select("command", "operations", "output_tokens", "alternative_tokens", saved.alias("saved"), F.round(C.percentage(saved, F.col("alternative_tokens")), 6).alias("percent"))


def report(ledger: DataFrame, start: str | None = None) -> DataFrame:
    """(operations, output_tokens, alternative_tokens, total_saved, input_saved, calls_saved, percent), one row.

    The total is clamped after summing, inputs and calls are clamped per command before.
    """
    rows = by_command(ledger, start)
    total = F.greatest(F.sum("alternative_tokens") - F.sum("output_tokens"), F.lit(0))

    def clamped(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0))

    return rows.agg(
        F.coalesce(F.sum("operations"), F.lit(0)).alias("operations"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("alternative_tokens"), F.lit(0)).alias("alternative_tokens"), F.coalesce(total, F.lit(0)).alias("total_saved"),
        clamped("alt_input_tokens", "engine_input_tokens").alias("input_saved"), clamped("alt_calls", "engine_calls").alias("calls_saved"),
        F.round(C.percentage(F.coalesce(total, F.lit(0)), F.coalesce(F.sum("alternative_tokens"), F.lit(0))), 6).alias("percent"),
    )


def file_cost(files: DataFrame) -> DataFrame:
    """(path, tokens): what reading each file whole costs."""
    return files.select("path", C.read_cost(F.col("size_bytes")).alias("tokens"))


def symbol_cost(sizes: DataFrame) -> DataFrame:
    """(tokens, calls) of an operation on a symbol, from (files, total_bytes) of the files involved."""
    return sizes.select((C.read_cost(F.col("total_bytes")) + SEARCH_TOKENS).alias("tokens"), (F.lit(1) + F.col("files")).alias("calls"))


def scoped_cost(sizes: DataFrame) -> DataFrame:
    """(tokens, calls) of an operation on all files below a path, from their (files, total_bytes)."""
    return symbol_cost(sizes)


def at_least(base: Column, own: Column) -> Column:
    """The alternative's cost where it cannot be less than the answer itself, as for searches."""
    return F.greatest(base, own)


def file_or_own(cost: Column, own: Column) -> Column:
    """The cost of reading a file, or the answer's own size for a file the index does not know."""
    return F.when(F.coalesce(cost, F.lit(0)) == 0, own).otherwise(cost)


def read_symbol_cost(cost: Column, own: Column) -> Column:
    """The cost of finding and reading one symbol's file."""
    return file_or_own(cost, own) + SEARCH_TOKENS


def write_cost(kind: str, size: Column, old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(input tokens, output tokens, calls) of replacing, deleting, inserting or extracting by plain reads and writes.

    ``size`` is the file after the edit; the whole file before the edit had to be read.
    """
    calls = {"replace": 3, "delete": 3, "insert": 2, "extract": 4}[kind]
    before = size - new + old
    return C.text_tokens(old + new), C.read_cost(F.greatest(before, F.lit(0))) + C.text_tokens(old) + C.text_tokens(new), F.lit(calls)
