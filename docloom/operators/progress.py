"""Progress of builds and streams: rows and sizes of every stage, counted while the rows pass, without a job of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "stage string, n_rows long, n_bytes long"


def _size(df: DataFrame) -> Column:
    """Bytes of a row's texts."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) for name, kind in df.dtypes if kind in ("string", "binary")]
    return F.sum(sum(texts, F.lit(0)).cast("long"))


def _metrics(df: DataFrame) -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("n_rows"), F.coalesce(_size(df), F.lit(0)).alias("n_bytes")


@dataclass
class Progress:
    """Stages of one build in order. told is called with (stage, n_rows, n_bytes) as each one is finished."""

    spark: SparkSession
    told: Callable[[str, int, int], None] | None = None
    done: dict[str, tuple[int, int]] = field(default_factory=dict)
    _open: dict[str, Observation] = field(default_factory=dict)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, observed. A name stands once in a build."""
        if name in self._open or name in self.done:
            raise ValueError(f"stage {name} is there already")
        self._open[name] = Observation(name)
        return df.observe(self._open[name], *_metrics(df))

    def finished(self, *names: str) -> None:
        """An action has run over these stages (all that are open, by default): their counts are taken. A stage that no action
        ever ran over would be waited for."""
        for name in names or list(self._open):
            found = self._open.pop(name).get
            self.done[name] = found["n_rows"], found["n_bytes"]
            if self.told:
                self.told(name, *self.done[name])

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(name, *counts) for name, counts in self.done.items()], SCHEMA)


class StreamProgress(StreamingQueryListener):
    """Counts of a stream's stages, a row for each batch: observed(df, name) inside the query, table() outside it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []
        self.failed: list[str] = []
        spark.streams.addListener(self)

    @staticmethod
    def observed(df: DataFrame, name: str) -> DataFrame:
        return df.observe(name, *_metrics(df))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.rows.append((name, event.progress.batchId, row["n_rows"], row["n_bytes"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows), "stage string, batch long, n_rows long, n_bytes long")

    def close(self) -> None:
        self.spark.streams.removeListener(self)
