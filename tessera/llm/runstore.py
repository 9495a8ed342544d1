"""A stored index of sorted runs: batches add to it, compaction merges what they added.

A commit is a small file that lists the parts in force. Parts are immutable: a
batch writes its runs, and its texts for the verification of later hits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..sources.checkpoint import checkpoint_root
from ..sources.commits import publish, read
from .common import partitions
from .runs import RUN_SCHEMA, compacted

#: Bytes of runs that a bucket may hold after a compaction; fuller stores get twice the buckets.
BUCKET_BYTES = 32 << 20

TEXTS = "k1 long, k2 long, t string"


@dataclass(frozen=True)
class Parts:
    """What a version holds; batches counts all that were ever added, runs and texts are folders."""

    version: int
    window: int
    buckets: int
    batches: int
    runs: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


class RunStore:
    """Runs of all batches so far in a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def scratch(spark: SparkSession) -> RunStore:
        """A store of its own in the checkpoint folder, which goes when the application ends."""
        store = RunStore(spark, f"{checkpoint_root(spark)}/runs-{uuid.uuid4().hex}")
        store.fs.deleteOnExit(store._path())
        return store

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def latest(self) -> Parts | None:
        """The last commit; None before the first."""
        at = self._path("commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        if not (done := sorted(n for n in names if n.endswith(".json") and not n.startswith("."))):
            return None
        j = json.loads(read(self.spark, f"{self.path}/commits/{done[-1]}"))
        return Parts(**j | {"runs": tuple(j["runs"]), "texts": tuple(j["texts"])})

    def state(self, window: int, buckets: int) -> Parts:
        """The last commit, or an empty one for windows of so many words in so many buckets."""
        found = self.latest() or Parts(0, window, buckets, 0)
        if found.window != window:
            raise ValueError(f"the store's windows have {found.window} words, not {window}")
        return found

    def runs(self, parts: tuple[str, ...]) -> DataFrame:
        return self._read(RUN_SCHEMA, parts)

    def texts(self, parts: tuple[str, ...]) -> DataFrame:
        return self._read(TEXTS, parts)

    def _read(self, ddl: str, parts: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(*(f"{self.path}/{x}" for x in parts))

    def write(self, runs: DataFrame, texts: DataFrame) -> Parts:
        """Write parts that no version names yet."""
        name = uuid.uuid4().hex
        for df, kind in ((runs, "runs"), (texts, "texts")):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{kind}/{name}")
        return Parts(0, 0, 0, 1, (f"runs/{name}",), (f"texts/{name}",))

    def commit(self, past: Parts, added: Parts, instead: bool = False) -> None:
        """Make past with what was added, or what was added instead of past's parts, the next version; raise CommitConflict if there is one."""
        new = replace(past, version=past.version + 1, batches=past.batches + added.batches, runs=added.runs if instead else past.runs + added.runs, texts=added.texts if instead else past.texts + added.texts)
        publish(self.spark, f"{self.path}/commits", f"{new.version:012d}.json", json.dumps(asdict(new)).encode())

    def compact(self) -> None:
        """Merge the runs of all batches bucket by bucket, and their texts, into one part each; the parts before go.

        Buckets are ranges, so a store that has outgrown them gets finer ones here.
        """
        past = self.latest()
        if past is None or len(past.runs) < 2:
            return
        size, buckets = sum(self.fs.getContentSummary(self._path(x)).getLength() for x in past.runs), past.buckets
        while size > buckets * BUCKET_BYTES:
            buckets *= 2
        texts = self.texts(past.texts).repartition(partitions(self.spark), "k1", "k2").dropDuplicates(["k1", "k2"])
        added = replace(self.write(compacted(self.runs(past.runs), 1, buckets), texts), batches=0)
        self.commit(replace(past, buckets=buckets), added, instead=True)
        for x in past.runs + past.texts:
            self.fs.delete(self._path(x), True)
