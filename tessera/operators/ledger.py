"""A ledger of steps in versions: appended, rewound and restored through one pointer that is moved at the end.

Records lie in folders of their own. A version is a small file that lists the folders it holds and, for a folder that a
rewind cut, up to which step; the ledger is what the highest version says. A version is written under another name first
and renamed, which either happens or doesn't. What a crash leaves, records without a version, nothing reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Records (step long, ...) below ``path``, all of ``schema``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(context._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._fs(f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The highest version, 0 where there is none."""
        return max(self._versions(), default=0)

    def parts(self, version: int | None = None) -> list[list]:
        """[folder, last step or None] of a version."""
        v = self.version() if version is None else version
        if not v:
            return []
        rows = self.spark.read.text(f"{self.path}/versions/{v}").collect()
        return json.loads(rows[0]["value"])

    def _commit(self, parts: list[list], after: int) -> int:
        new = after + 1
        part, fs = self._fs(f"{self.path}/versions/.new-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/versions/{new}")
        if fs.exists(final) or not fs.rename(part, final):
            raise RuntimeError(f"version {new} is there already: another writer")
        return new

    def write(self, records: DataFrame) -> str:
        """Write records without committing them; gives their folder."""
        folder = f"records/{uuid.uuid4().hex}"
        records.write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, records: DataFrame) -> int:
        """Add records; gives the version that holds them."""
        before = self.version()
        return self._commit([*self.parts(before), [self.write(records), None]], before)

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version; an empty table where there are none."""
        out = self.spark.createDataFrame([], self.schema)
        for folder, last in self.parts(version):
            rows = self.spark.read.schema(out.schema).parquet(f"{self.path}/{folder}")
            out = out.union(rows if last is None else rows.where(F.col("step") <= last))
        return out

    def rewind(self, step: int) -> int:
        """Drop records after ``step`` without rewriting any: they stay in their folders, and versions before still have them."""
        before = self.version()
        parts = [[folder, step if last is None else min(step, last)] for folder, last in self.parts(before)]
        return self._commit(parts, before)


def state_of(records: DataFrame, by: list[str], amount: str) -> DataFrame:
    """One row: next_step, records and a hash of the sums of ``amount`` by ``by``; sums are made before a row a group meets."""
    sums = records.groupBy(*by).agg(F.sum(amount).cast("long").alias("x"), F.count(F.lit(1)).alias("n"), F.max("step").alias("last"))
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by], F.col("x").cast("string"))
    all_sums = F.array_join(F.array_sort(F.collect_list(text)), "|")
    return sums.agg((F.coalesce(F.max("last"), F.lit(-1)) + 1).cast("long").alias("next_step"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sha2(all_sums, 256).alias("state_hash"))


def checkpoint(ledger: Ledger, by: list[str], amount: str, bindings: dict[str, str]) -> dict:
    """What a restore needs: the version, the state recomputed from its records, and what the run is bound to."""
    return {"version": ledger.version(), "state": state_of(ledger.read(), by, amount).first().asDict(), "bindings": dict(bindings), "by": by, "amount": amount}


def restore(ledger: Ledger, saved: dict, bindings: dict[str, str]) -> list[str]:
    """Rewind ``ledger`` to a checkpoint; gives the problems, and leaves the ledger alone if there are any.

    The run must be bound to the same things, and the state recomputed from the checkpoint's version must be the one it
    kept.
    """
    problems = [f"{k} differs" for k in sorted({*saved["bindings"], *bindings}) if saved["bindings"].get(k) != bindings.get(k)]
    if state_of(ledger.read(saved["version"]), saved["by"], saved["amount"]).first().asDict() != saved["state"]:
        problems.append("the state is not that of the records")
    if not problems:
        ledger._commit(ledger.parts(saved["version"]), ledger.version())
    return problems
