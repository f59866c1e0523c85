"""Polled providers as a streaming source: the offset is the ``since`` cursor.

A tick asks each account of a provider for what happened from the cursor to the
tick's start, one task an account, on the executors.  The cursor moves to the
tick's start only when the micro-batch has succeeded, because the streaming
checkpoint commits it then: a provider that fails fails the batch, and the next
run asks for the same range again.  Nothing is skipped and no loop is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: (account, since, until) -> rows, times in ISO-8601 UTC, ``until`` exclusive.
Fetch = Callable[[str, str, str], Iterator[tuple]]


def iso(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Range(InputPartition):
    """What one task asks: an account, from since to until."""

    def __init__(self, account: str, since: str, until: str) -> None:
        self.account, self.since, self.until = account, since, until


class PollReader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, accounts: list[str], since: str, clock: Callable[[], str]) -> None:
        self.fetch, self.accounts, self.since, self.clock = fetch, accounts, since, clock

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"since": self.clock()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(a, start["since"], end["since"]) for a in self.accounts] if start["since"] < end["since"] else []

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.fetch(partition.account, partition.since, partition.until)


def source(name: str, schema: str, fetch: Fetch, accounts: list[str], since: str, clock: Callable[[], str] | None = None) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; ``fetch`` is the provider's client and travels with tasks."""
    now = clock or (lambda: iso(time.time()))

    class Poll(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> PollReader:  # noqa: N802, ARG002
            return PollReader(fetch, accounts, since, now)

    return Poll


def poll_stream(spark: SparkSession, provider: type[DataSource]) -> DataFrame:
    """The provider's rows as a stream; a processing-time trigger is the interval between ticks."""
    spark.dataSource.register(provider)
    return spark.readStream.format(provider.name()).load()
