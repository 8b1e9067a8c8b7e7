"""Catalogue services as a Python data source that replays recorded JSON answers.

``spark.read.format("replay").option("path", folder).option("kind", "scenes")`` reads one file of answers for each
request; filters on the cloud cover are applied at the source. A live client would replace ``answers``.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan

SCHEMAS = {
    "scenes": "region_id string, scene_id string, visual_href string, cloud double",
    "catalogue": "id string, year int, page int, pos int, type string, date string, record string",
    "annotations": "url string, plate int, annotation string",
}
#: Attempts, the first wait in seconds, and answers that are worth another attempt.
ATTEMPTS, WAIT, AGAIN = 4, 2.0, (429, 503)


def retried(call: Callable[[], tuple[int, object]], wait: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> object:
    """The body of an answer; busy servers and network errors are tried again with doubled waits, other errors raise at once."""
    for i in range(attempts):
        try:
            status, body = call()
        except OSError:
            status, body = None, None
        if status == 200:
            return body
        if status is not None and status not in AGAIN:
            raise ValueError(f"answer {status}")
        if i + 1 < attempts:
            wait(WAIT * 2**i)
    return None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, kind: str):
        self.folder, self.kind, self.below = folder, kind, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if self.kind == "scenes" and isinstance(f, LessThan) and f.attribute == ("cloud",):
                self.below = f.value if self.below is None else min(self.below, f.value)
            else:
                yield f

    def partitions(self) -> list[_File]:
        return [_File(os.path.join(self.folder, x)) for x in sorted(os.listdir(self.folder)) if x.endswith(".json")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path) as f:
            found = json.load(f)
        names = [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
        for row in found:
            if self.below is None or (row.get("cloud") is not None and row["cloud"] < self.below):
                yield tuple(row.get(c) for c in names)


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options["kind"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Replay)
