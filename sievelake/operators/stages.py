"""A stage machine over samples that keeps its state in versions.

A state is a table with a row a sample: the stage that it has reached, the fingerprint of its input, a status, its metrics,
and how often each stage ran. A new version is written aside and takes its name by a rename that fails if that name is
taken, so a cut-off write is never read, and of two writers that began from one version the second is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stages of a sample in their order. ``Failed`` stands beside the last.
STAGES = ("Pending", "FastpRunning", "FastpComplete", "DepletionRunning", "DepletionComplete", "Validating", "Completed")
FAILED = "Failed"
_REST = "stage int, fingerprint long, status string, metrics map<string,double>, runs int"


class Moved(RuntimeError):
    """Another writer has promoted a version since this state was read."""


class State:
    """The versions of a state in one folder. ``key``: names and types of what tells samples apart."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{key}, {_REST}"
        self.keys = [x.split()[0] for x in key.split(", ")]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        return max([0, *(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName()[:1] == "v")])

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(self.schema).json(f"{self.path}/v{v:08d}") if v else self.spark.createDataFrame([], self.schema)

    def promote(self, rows: DataFrame, after: int) -> int:
        """Write ``rows`` as the version behind ``after``; :class:`Moved` if that isn't the newest any more."""
        aside = f"aside-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.json(f"{self.path}/{aside}")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(aside).getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        source = jvm.org.apache.hadoop.fs.Path
        full = self._at(aside).getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(self._at(aside)).toString()
        target = full.removesuffix(aside) + f"v{after + 1:08d}"
        try:
            if self.version() != after:
                raise Moved(f"version {after} of {self.path} isn't the newest any more")
            fc.rename(source(full), source(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            fc.delete(source(full), True)
            if "FileAlreadyExists" in str(e):
                raise Moved(f"version {after + 1} of {self.path} was written by another") from None
            raise
        return after + 1


def todo(state: DataFrame, plan: DataFrame, keys: list[str], stage: int) -> DataFrame:
    """Rows of ``plan`` that ``stage`` is still to be run for: those that haven't reached it, have no state, or had another
    fingerprint then. Failed samples are left alone until their input changes."""
    seen = state.select(*keys, F.col("stage").alias("__s"), F.col("fingerprint").alias("__f"), F.col("status").alias("__t"))
    both = plan.join(seen, keys, "left")
    same = F.col("fingerprint").eqNullSafe(F.col("__f"))
    done = same & ((F.col("__s") >= stage) | (F.col("__t") == FAILED))
    return both.filter(~F.coalesce(done, F.lit(False))).drop("__s", "__f", "__t")


def run(state: State, plan: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Bring all samples of ``plan`` (keys and ``fingerprint``) through ``steps`` and return their state.

    A step gets the samples that it is to run for and returns their keys with ``ok`` (those that aren't fail and go no further)
    and ``metrics``; it stands for the stage of its name. Its results are promoted before the next one begins. So a run that
    is cut off goes on where it was: only samples that haven't reached a stage run it, and all stages of those whose
    fingerprint has changed. Samples that ``plan`` lacks keep their state. Keys are unique and not null."""
    for name, step in steps:
        stage, version = STAGES.index(name), state.version()
        old = state.read(version)
        left = todo(old, plan, state.keys, stage)
        if left.isEmpty():
            continue
        got = step(left).select(*state.keys, "ok", F.col("metrics").alias("__m"))
        before = old.select(*state.keys, F.col("fingerprint").alias("__f"), F.col("metrics").alias("__old"), F.col("runs").alias("__runs"))
        same = F.col("fingerprint").eqNullSafe(F.col("__f"))
        none = F.create_map().cast("map<string,double>")
        kept = F.map_filter(F.coalesce(F.when(same, F.col("__old")), none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("__m", none)), k))
        ok = F.coalesce("ok", F.lit(False))
        new = left.select(*state.keys, "fingerprint").join(got, state.keys).join(before, state.keys, "left").select(
            *state.keys, F.lit(stage).alias("stage"), "fingerprint", F.when(ok, F.lit(name)).otherwise(F.lit(FAILED)).alias("status"),
            F.map_concat(kept, F.coalesce("__m", none)).alias("metrics"), (F.coalesce("__runs", F.lit(0)) + 1).alias("runs"),
        )
        state.promote(old.join(left.select(*state.keys), state.keys, "left_anti").unionByName(new), version)
    return state.read()
