"""Filters of whole rows by a judge of Arrow batches, whatever the columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame


def filter_rows(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows of ``docs`` that stay; ``judge()`` makes, once a task, a function from a text column to a mask."""
    place = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(found):
        keep = judge()
        for b in found:
            yield b.filter(keep(b.column(place)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
