"""Batched model calls as a plug-in, with retries, a stage cache and a fallback.

A model is a factory ``load() -> call`` where ``call(pandas.DataFrame) -> list[str]``. Loading happens
once per task; Spark decides where rows go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, cut_lineage
from . import gates

Model = Callable[[], Callable[[pd.DataFrame], list]]


def infer(df: DataFrame, load: Model, batch: int = 32, output: str = "result") -> DataFrame:
    """Call the model on batches of rows. A batch that raises marks its rows failed; the rest go on."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField(output, T.StringType()), T.StructField("status", T.StringType())]
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for pdf in parts:
            if call is None:
                call = load()
            results, states = [], []
            for at in range(0, len(pdf), batch):
                rows = pdf.iloc[at : at + batch]
                try:
                    answer = list(call(rows))
                    if len(answer) != len(rows):
                        raise ValueError("model returned another number of rows")
                    results += answer
                    states += ["ok"] * len(rows)
                except Exception:  # the failure belongs to these rows only
                    results += [None] * len(rows)
                    states += ["failed"] * len(rows)
            yield pdf.assign(**{output: pd.Series(results, dtype=object).values, "status": states})

    return df.mapInPandas(run, schema)


def accepted(source: str = "text", output: str = "result", script: str | None = None) -> Column:
    """A result that is present, valid and not the source itself."""
    ok = (F.col("status") == "ok") & F.coalesce(F.trim(output) != "", F.lit(False)) & (F.col(output) != F.col(source))
    return ok & ~gates.T.has_class(F.col(output), script) if script else ok


def retry_failed(
    df: DataFrame, load: Model, rounds: int = 3, batch: int = 32, source: str = "text", output: str = "result"
) -> DataFrame:
    """First run, then up to ``rounds`` re-runs of only the rows not accepted. Rows that never succeed
    are left out. Every run is checkpointed, so no model call is ever repeated by a later action."""
    good = None
    todo = df
    for attempt in range(rounds + 1):
        done = cut_lineage(infer(todo, load, batch, output).withColumn("attempt", F.lit(attempt)))
        won = done.where(accepted(source, output))
        good = won if good is None else good.unionByName(won)
        todo = done.where(~F.coalesce(accepted(source, output), F.lit(False))).select(*df.columns)
        if todo.isEmpty():
            break
    return good


def retry_until_covered(
    df: DataFrame, load: Model, key: str, rounds: int = 2, enough: float = 0.8, singles: int = 5, batch: int = 32,
    source: str = "text", output: str = "result",
) -> DataFrame:
    """Page form: a page is asked again while fewer than 80 % of its rows are accepted, at most
    ``rounds`` runs in all; afterwards pages with at most ``singles`` rows missing have those asked one
    by one."""
    good = None
    todo = df
    for attempt in range(1, rounds + 1):
        done = cut_lineage(infer(todo, load, batch, output).withColumn("attempt", F.lit(attempt)))
        cover = done.groupBy(key).agg(F.avg(F.coalesce(accepted(source, output), F.lit(False)).cast("int")).alias("_share"))
        again = cover.where(F.col("_share") < enough).select(key) if attempt < rounds else cover.limit(0).select(key)
        settled = done.join(again, key, "left_anti").where(accepted(source, output))
        good = settled if good is None else good.unionByName(settled)
        todo = done.join(again, key, "left_semi").select(*df.columns)
        if todo.isEmpty():
            break
    good = cut_lineage(good)
    rest = df.join(good.select(*df.columns), df.columns, "left_anti")
    few = rest.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= singles).select(key)
    last = infer(rest.join(few, key, "left_semi"), load, 1, output).withColumn("attempt", F.lit(rounds + 1))
    return good.unionByName(last.where(accepted(source, output)))


def cached_stage(
    pages: DataFrame, stage: str, load: Model, keys: list[str], folder: str | None = None, batch: int = 32
) -> DataFrame:
    """Results of a stage for all pages: those in the stage table plus new ones, which are appended.
    Only pages without a result reach the model; a failed page stays out and is tried next time."""
    spark = pages.sparkSession
    path = f"{folder or checkpoint_dir(spark)}/stage={stage}"
    schema = T.StructType(
        [*[pages.schema[k] for k in keys], T.StructField("result", T.StringType()), T.StructField("status", T.StringType())]
    )
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(path)
    stored = spark.read.schema(schema).parquet(path).select(*keys)
    todo = pages.join(stored, keys, "left_anti")
    fresh = infer(todo, load, batch).where("status = 'ok'").select(*keys, "result", "status")
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(pages.select(*keys), keys, "left_semi")


def fallback_text(df: DataFrame, source: str = "text", output: str = "result", leaked: str = "leaked") -> DataFrame:
    """The source text where the result leaked, failed or is missing."""
    usable = (F.col("status") == "ok") & ~F.coalesce(F.col(leaked), F.lit(False)) & (F.trim(output) != "")
    return df.withColumn("final", F.when(usable, F.col(output)).otherwise(F.col(source)))
