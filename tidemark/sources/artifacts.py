"""Sealed folders: written beside their place, described by a manifest, renamed into it, never changed.

All goes through Hadoop's file system, so any store that Spark reads will do. A folder
without its seal is what a writer that died has left; ``collect_orphans`` removes it.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEAL, MANIFEST, TRIAL = "_SEALED", "manifest.json", ".trial-"


class Store:
    """A root folder in a store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(where)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def sealed(self, name: str) -> bool:
        return self.exists(f"{name}/{SEAL}")

    def put(self, name: str, data: bytes) -> None:
        """Under a trial name first, then renamed; a file that is there is replaced whole."""
        trial = self._path(self.at(f"{name}{TRIAL}{uuid.uuid4().hex}"))
        self.fs.mkdirs(trial.getParent())
        out = self.fs.create(trial, True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        if self.fs.exists(self._path(self.at(name))):
            self.fs.delete(self._path(self.at(name)), False)
        if not self.fs.rename(trial, self._path(self.at(name))):
            raise OSError(f"{name} could not be put in its place")

    def get(self, name: str) -> bytes:
        return self.spark.read.format("binaryFile").load(self.at(name)).first().content

    def drop(self, name: str) -> bool:
        return self.fs.delete(self._path(self.at(name)), True)

    def rename(self, a: str, b: str) -> bool:
        self.fs.mkdirs(self._path(self.at(b)).getParent())
        return self.fs.rename(self._path(self.at(a)), self._path(self.at(b)))

    def folders(self, below: str = "") -> list[tuple[str, int]]:
        """(name, time of change) of the folders right below."""
        base = self.at(below) if below else self.root
        if not self.fs.exists(self._path(base)):
            return []
        return [(x.getPath().getName(), x.getModificationTime()) for x in self.fs.listStatus(self._path(base)) if x.isDirectory()]


def write_report(spark: SparkSession, path: str, payload: dict) -> None:
    """JSON with sorted keys, seen whole or not at all."""
    root, _, name = path.rpartition("/")
    Store(spark, root).put(name, json.dumps(payload, sort_keys=True, indent=2).encode())


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a hash that does not depend on their order or partitions: sums of row hashes, equal rows counted."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    again = F.xxhash64(row, F.lit(1))
    n, a, b = df.select(row.alias("a"), again.alias("b")).agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return n, hashlib.sha256(f"{n} {a} {b} {df.schema.json()}".encode()).hexdigest()


def seal(store: Store, name: str, write, manifest: dict) -> dict:
    """write(folder) fills a trial folder, which then takes its place with its manifest and seal. One that is there raises."""
    if store.sealed(name):
        raise FileExistsError(f"{name} is sealed and stays as it is")
    head, _, tail = name.rpartition("/")
    trial = f"{head}/{TRIAL}{tail}-{uuid.uuid4().hex}".lstrip("/")
    try:
        manifest = {**manifest, **(write(trial) or {}), "created_at_ms": int(time.time() * 1000)}
        store.put(f"{trial}/{MANIFEST}", json.dumps(manifest, sort_keys=True, indent=2).encode())
        store.put(f"{trial}/{SEAL}", b"")
        if store.exists(name):  # without a seal: left by a writer that died
            store.drop(name)
        if not store.rename(trial, name):
            raise OSError(f"{name} could not be put in its place")
    except Exception:
        store.drop(trial)
        raise
    return manifest


def manifest_of(store: Store, name: str) -> dict:
    if not store.sealed(name):
        raise FileNotFoundError(f"no sealed folder {name}")
    return json.loads(store.get(f"{name}/{MANIFEST}"))


def write_table(store: Store, name: str, df: DataFrame, about: dict) -> dict:
    """A table under name/rows; the manifest has its schema, row count and content hash."""

    def write(trial: str) -> dict:
        df.write.parquet(store.at(f"{trial}/rows"))
        n, content = content_hash(store.spark.read.schema(df.schema).parquet(store.at(f"{trial}/rows")))
        return {"rows": n, "content_hash": content, "schema": json.loads(df.schema.json())}

    return seal(store, name, write, about)


def read_table(store: Store, name: str, verify: bool = False) -> DataFrame:
    from pyspark.sql import types as T

    about = manifest_of(store, name)
    df = store.spark.read.schema(T.StructType.fromJson(about["schema"])).parquet(store.at(f"{name}/rows"))
    if verify and content_hash(df) != (about["rows"], about["content_hash"]):
        raise ValueError(f"{name} does not hold what its manifest says")
    return df


def write_model(store: Store, name: str, model, knots: list[tuple[float, float]], features: list[str], about: dict) -> dict:
    """A fitted pipeline with its calibration curve; the manifest has features, their hash and the curve's hash."""
    curve = json.dumps({"knots": [list(map(float, k)) for k in knots]}, sort_keys=True).encode()

    def write(trial: str) -> dict:
        model.save(store.at(f"{trial}/model"))
        store.put(f"{trial}/calibrator.json", curve)
        return {"features": list(features), "features_hash": hashlib.sha256(",".join(sorted(features)).encode()).hexdigest(), "calibrator_sha256": hashlib.sha256(curve).hexdigest(), "model_class": type(model).__name__}

    return seal(store, name, write, about)


def read_model(store: Store, name: str):
    """(fitted pipeline, knots, manifest); raises where the curve or the model's inputs are not those of the manifest."""
    from pyspark.ml import PipelineModel

    about = manifest_of(store, name)
    curve = store.get(f"{name}/calibrator.json")
    if hashlib.sha256(curve).hexdigest() != about["calibrator_sha256"]:
        raise ValueError(f"the calibrator of {name} was changed")
    model = PipelineModel.load(store.at(f"{name}/model"))
    inputs = [list(s.getInputCols()) for s in model.stages if s.hasParam("inputCols") and s.isDefined("inputCols")]
    if inputs and inputs[0] != about["features"]:
        raise ValueError(f"the model of {name} takes {inputs[0]}, its manifest says {about['features']}")
    return model, [tuple(k) for k in json.loads(curve)["knots"]], about


def collect_orphans(store: Store, below: str = "", older_than_ms: int = 3_600_000, now_ms: int | None = None) -> list[str]:
    """Removes trial folders that no writer has touched for a while; their names. Sealed folders stay."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    gone = []
    for name, changed in store.folders(below):
        where = f"{below}/{name}".lstrip("/")
        if name.startswith(TRIAL):
            if now - changed >= older_than_ms:
                store.drop(where)
                gone.append(where)
        elif not store.sealed(where):
            gone += collect_orphans(store, where, older_than_ms, now)
    return gone


def append_experiment(store: Store, entry: dict, name: str = "experiments", most: int = 1_000_000) -> int:
    """Writes an entry under the next free number. The number is claimed by creating its file, which only one writer can: no two share one."""
    start = 1 + max([int(x.getPath().getName().split(".")[0]) for x in (store.fs.listStatus(store._path(store.at(name))) if store.exists(name) else [])], default=0)
    for number in range(start, most):
        where = store._path(store.at(f"{name}/{number:09}.json"))
        try:
            out = store.fs.create(where, False)
        except Exception as e:  # another writer was first
            if "exist" in str(e).lower():
                continue
            raise
        try:
            out.write(bytearray(json.dumps({"experiment_id": number, **entry}, sort_keys=True).encode()))
        finally:
            out.close()
        return number
    raise OSError("no number is free")


def experiments(store: Store, schema: str, name: str = "experiments") -> DataFrame:
    return store.spark.read.schema(f"experiment_id long, {schema}").json(store.at(name))


def remaining(trials: DataFrame, log: DataFrame, key) -> DataFrame:
    """Trials that the log does not hold yet: a search that was cut off goes on with these."""
    return trials.join(log.select(*key).distinct(), list(key), "left_anti")
