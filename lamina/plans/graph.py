"""Runs of stages that depend on each other, each done once.

The key of a stage is a digest of its name, its version, its parameters and the keys of what it reads; that of a source, of its
files' names, lengths and times. A stage's output lies in a folder of its key. It is written first and its record (rows and an order-free
digest of the output) after it, so what a killed run leaves is either whole or made again. Stages whose record is there are
kept; a changed parameter or source changes the keys of what depends on it, and only that is made anew.

Stages are DataFrames: the driver orders them, starts those that are ready beside each other, and holds one record a stage.

Defined cases: an empty output is an output, of no rows; a stage that fails is retried by the next run, as are those that wait for
it, while others are still made; a stage that reads itself, or something unknown, is an error before anything runs.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import storage

RECORD = T.StructType([T.StructField(n, t) for n, t in (("stage", T.StringType()), ("key", T.StringType()), ("rows", T.LongType()), ("digest", T.StringType()), ("seconds", T.DoubleType()))])


@dataclass(frozen=True)
class Stage:
    """``make`` gets the DataFrames of ``inputs`` by position, then the parameters by name. ``version`` stands for its code."""

    name: str
    make: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    version: int = 1


class RunFailed(RuntimeError):
    """Names of the stages that failed, with their errors."""

    def __init__(self, failures: dict[str, Exception]):
        super().__init__("; ".join(f"{name}: {type(e).__name__}: {str(e)[:300]}" for name, e in failures.items()))
        self.failures = failures


def source_key(spark: SparkSession, path: str) -> str:
    """Of a table's files by name, length and time; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.xxhash64(F.regexp_extract("path", "[^/]+$", 0), "length", F.unix_micros("modificationTime"))
    found = files.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("h"), F.sum("length").alias("b")).first()
    return f"{found['n']}:{found['b']}:{found['h']}"


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a digest that doesn't depend on their order."""
    one = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in sorted(df.columns)])
    found = df.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("h")).first()
    return found["n"], str(found["h"] or 0)


class Graph:
    def __init__(self, spark: SparkSession, folder: str, sources: dict[str, str], stages: list[Stage]):
        self.spark, self.folder, self.sources = spark, folder.rstrip("/"), dict(sources)
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages) or set(self.stages) & set(sources):
            raise ValueError("two stages or sources of one name")
        self.order = self._ordered()
        self.keys: dict[str, str] = {}
        self.records: dict[str, dict] = {}
        self.made: set[str] = set()

    def _ordered(self) -> list[str]:
        done, order, open_ = set(self.sources), [], []

        def visit(name: str) -> None:
            if name in done:
                return
            if name not in self.stages:
                raise ValueError(f"nothing is named {name}")
            if name in open_:
                raise ValueError(f"{name} reads itself")
            open_.append(name)
            for i in self.stages[name].inputs:
                visit(i)
            open_.pop()
            done.add(name)
            order.append(name)

        for name in self.stages:
            visit(name)
        return order

    def _find_keys(self) -> None:
        keys = {name: source_key(self.spark, path) for name, path in self.sources.items()}
        for name in self.order:
            s = self.stages[name]
            known = {"name": name, "version": s.version, "parameters": s.parameters, "inputs": [[i, keys[i]] for i in s.inputs]}
            keys[name] = hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()[:32]
        self.keys = keys

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}/{self.keys[name]}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.sources[name] if name in self.sources else f"{self._path(name)}/data")

    def _make(self, name: str) -> dict:
        s, path, begun = self.stages[name], self._path(name), time.time()
        if storage.exists(self.spark, f"{path}/record/_SUCCESS"):
            return self.spark.read.schema(RECORD).json(f"{path}/record").first().asDict()
        s.make(*[self.table(i) for i in s.inputs], **s.parameters).write.mode("overwrite").parquet(f"{path}/data")
        rows, found = digest(self.spark.read.parquet(f"{path}/data"))
        record = {"stage": name, "key": self.keys[name], "rows": rows, "digest": found, "seconds": time.time() - begun}
        self.spark.createDataFrame([record], RECORD).coalesce(1).write.mode("overwrite").json(f"{path}/record")
        self.made.add(name)
        return record

    def _needed(self, targets: tuple[str, ...] | None) -> list[str]:
        wanted, open_ = set(), list(self.order if targets is None else targets)
        while open_:
            name = open_.pop()
            if name in self.stages and name not in wanted:
                wanted.add(name)
                open_ += self.stages[name].inputs
        return [n for n in self.order if n in wanted]

    def run(self, targets: tuple[str, ...] | None = None, workers: int = 4) -> dict[str, DataFrame]:
        """The outputs of all stages, or of ``targets`` and what they need; ``made`` says which of them this run made, ``records`` has a record of each."""
        self._find_keys()
        self.records, self.made, failures, active = {}, set(), {}, {}
        waiting = self._needed(targets)
        with ThreadPoolExecutor(max_workers=workers) as pool:
            while True:
                for name in [n for n in waiting if all(i in self.sources or i in self.records for i in self.stages[n].inputs)]:
                    waiting.remove(name)
                    active[pool.submit(self._make, name)] = name
                if not active:
                    break
                for future in wait(active, return_when=FIRST_COMPLETED)[0]:
                    name = active.pop(future)
                    if error := future.exception():
                        failures[name] = error
                    else:
                        self.records[name] = future.result()
        if failures:
            raise RunFailed(failures)
        return {name: self.table(name) for name in self.records}

    def manifest(self) -> DataFrame:
        """stage, key, rows, digest, status (made or kept) of the last run, and what it reads."""
        rows = [(n, self.keys[n], r["rows"], r["digest"], "made" if n in self.made else "kept", ",".join(self.stages[n].inputs)) for n, r in self.records.items()]
        return self.spark.createDataFrame(rows, "stage string, key string, rows long, digest string, status string, inputs string")

    def changed(self) -> list[str]:
        """Stages whose output isn't what their record says."""
        return [n for n, r in self.records.items() if digest(self.table(n)) != (r["rows"], r["digest"])]

    def prune(self) -> list[str]:
        """Deletes outputs of other keys than the last run's, and names them."""
        gone = [f"{name}/{key}" for name in self.order for key in storage.names(self.spark, f"{self.folder}/{name}") if key != self.keys[name]]
        for path in gone:
            storage.delete(self.spark, f"{self.folder}/{path}")
        return gone
