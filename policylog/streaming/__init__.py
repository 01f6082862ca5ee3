"""Rulesets over streams of base facts: each micro-batch is solved anew against the static facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from policylog.engine import Ruleset, SolveResult
from policylog.sources.edb import Edb


def solve_each_batch(stream: DataFrame, ruleset: Ruleset, predicate: str, static: Callable[[Edb], None], sink: Callable[[SolveResult, int], None]) -> DataStreamWriter:
    """A stream writer that adds each batch's rows to predicate, adds the static facts, solves, and hands the result on.
    Rules are not monotone across batches: each result is the least model of its own batch and the static facts."""

    def handle(batch: DataFrame, number: int) -> None:
        edb = ruleset.edb()
        static(edb)
        edb.add_dataframe(predicate, batch)
        sink(ruleset.solve(edb), number)

    return stream.writeStream.foreachBatch(handle)
