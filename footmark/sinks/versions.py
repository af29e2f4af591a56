"""Versioned tables, model bundles and resumable runs on a shared folder.

Nothing here needs a server: data are written beside what is there, and one small file, created only if it is
not there yet, makes them count. Two writers that start from one version cannot both create the next one's
file, so the second learns that it was late. File systems with an atomic create (HDFS, local) give that
guarantee; an object store without one does not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.operators.quality import row_digest


class StaleWrite(ValueError):
    """The table has moved on since the writer read it."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a small JSON file unless one is there; whether this call wrote it."""
    place, system = _place(spark, path)
    try:
        stream = system.create(place, False)
    except Exception as error:  # the JVM's exception tells a file that is there from other trouble
        if "FileAlreadyExists" in str(error):
            return False
        raise
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The entries of a folder in order; none if it is not there."""
    place, system = _place(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def read_small(spark: SparkSession, path: str) -> dict:
    """A file of ``create_once``."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


# ---- versioned table ----------------------------------------------------------------------


@dataclass(frozen=True)
class Version:
    """What a reader or writer has seen: the version's number and its rows (None before the first one)."""

    number: int
    rows: DataFrame | None


def current(spark: SparkSession, root: str) -> Version:
    """The newest committed version."""
    log = names(spark, f"{root}/log")
    if not log:
        return Version(0, None)
    entry = read_small(spark, f"{root}/log/{log[-1]}")
    return Version(entry["version"], spark.read.parquet(entry["path"]))


def commit(rows: DataFrame, root: str, seen: Version, note: str = "") -> int:
    """Make ``rows`` the version after ``seen``, or raise ``StaleWrite`` if another writer has done so first."""
    spark, number, path = rows.sparkSession, seen.number + 1, f"{root}/data/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    if not create_once(spark, f"{root}/log/{number:012d}", {"version": number, "path": path, "note": note}):
        raise StaleWrite(f"Version {number} was written by another writer; read again and merge anew.")
    return number


def upsert(known: DataFrame | None, incoming: DataFrame, keys: Sequence[str],
           combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``incoming`` merged into ``known`` by key, with ``revision``: 1 when inserted, one more with every update.

    ``combine`` makes a value from the known and the incoming one; keys only in the known table stay as they are.
    """
    if known is None:
        return incoming.select(*keys, *combine, F.lit(1).alias("revision"))
    old = known.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in combine], "revision")
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in combine], F.lit(True).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old_{c}")).when(
        F.col("revision").isNull(), F.col(f"_new_{c}")).otherwise(combine[c](F.col(f"_old_{c}"), F.col(f"_new_{c}")))
    return both.select(*keys, *[value(c).alias(c) for c in combine], (
        F.coalesce("revision", F.lit(0)) + F.col("_new").isNotNull().cast("int")).alias("revision"))


# ---- model bundles ------------------------------------------------------------------------


@dataclass(frozen=True)
class Bundle:
    """Tables that belong together. ``revision`` names the training rows, ``parent`` the bundle it goes back to."""

    parts: dict[str, DataFrame]
    revision: str
    parent: str | None = None


def _manifest(root: str, name: str) -> str:
    return f"{root}/{name}/manifest.json"


def _digests(rows: dict[str, DataFrame]) -> DataFrame:
    """(part, rows, digest) of several tables in one job; what is empty has no rows and no digest."""
    out = None
    for part, df in rows.items():
        one = row_digest(df.withColumn("_part", F.lit(part)), ["_part"]).select(F.col("_part").alias("part"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _listed(spark: SparkSession, digests: DataFrame, parts: Sequence[str]) -> dict[str, dict]:
    """A few numbers for each part, as they stand in a manifest."""
    found = digests.agg(F.to_json(F.collect_list(F.struct("part", "rows", "digest")))).first()[0]
    by_part = {row["part"]: {"rows": row["rows"], "digest": row["digest"]} for row in json.loads(found)}
    return {part: by_part.get(part, {"rows": 0, "digest": ""}) for part in parts}


def write_parts(spark: SparkSession, root: str, name: str, bundle: Bundle) -> dict:
    """The first phase: write the tables and read them back for their digests. Nobody can load them yet."""
    for part, df in bundle.parts.items():
        df.write.parquet(f"{root}/{name}/{part}")
    stored = {part: spark.read.parquet(f"{root}/{name}/{part}") for part in bundle.parts}
    parent = None if bundle.parent is None else {
        "name": bundle.parent, "parts": read_small(spark, _manifest(root, bundle.parent))["parts"]}
    return {"name": name, "status": "complete", "revision": bundle.revision, "parent": parent,
            "parts": _listed(spark, _digests(stored), list(bundle.parts))}


def publish_bundle(spark: SparkSession, root: str, name: str, bundle: Bundle) -> None:
    """Both phases: the parts, and last the manifest that makes them a bundle."""
    manifest = write_parts(spark, root, name, bundle)
    if not create_once(spark, _manifest(root, name), manifest):
        raise StaleWrite(f"A bundle {name} has been published already.")


def bundle_problem(spark: SparkSession, root: str, name: str, revision: str) -> str | None:
    """Why a bundle must not be used, or None: every part is read and its digest worked out again."""
    if not exists(spark, _manifest(root, name)):
        return "no manifest"
    manifest = read_small(spark, _manifest(root, name))
    absent = [part for part in manifest["parts"] if not exists(spark, f"{root}/{name}/{part}")]
    if absent:
        return f"missing part: {absent[0]}"
    stored = {part: spark.read.parquet(f"{root}/{name}/{part}") for part in manifest["parts"]}
    found = _listed(spark, _digests(stored), list(stored))
    changed = [part for part in stored if found[part] != manifest["parts"][part]]
    if changed:
        return f"changed part: {changed[0]}"
    parent = manifest["parent"]
    if parent is not None:
        path = _manifest(root, parent["name"])
        if not exists(spark, path) or read_small(spark, path)["parts"] != parent["parts"]:
            return "changed parent"
        trouble = bundle_problem(spark, root, parent["name"], read_small(spark, path)["revision"])
        if trouble:
            return f"parent: {trouble}"
    if manifest["revision"] != revision:
        return "stale revision"
    return None


def load_bundle(spark: SparkSession, root: str, name: str, revision: str) -> dict[str, DataFrame]:
    """The parts of a bundle that is whole, unchanged and made from the newest training rows."""
    problem = bundle_problem(spark, root, name, revision)
    if problem:
        raise ValueError(f"Bundle {name} cannot be used: {problem}.")
    return {part: spark.read.parquet(f"{root}/{name}/{part}") for part in read_small(spark, _manifest(root, name))["parts"]}


def table_revision(rows: DataFrame) -> str:
    """A name for the content of a table: its order-free digest."""
    found = row_digest(rows.withColumn("_all", F.lit(0)), ["_all"]).select("rows", "digest").first()
    return "empty" if found is None else f"{found['rows']}-{found['digest']}"


# ---- resumable runs -----------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """A run's stages in a versioned table (stage, state, attempts, selected, path), one row a stage.

    A stage goes from started to complete; a rerun takes up after the last complete one. What a stage has
    selected is frozen: a later attempt to select otherwise is refused.
    """

    spark: SparkSession
    root: str
    stages: tuple[str, ...] = field(default=())

    SCHEMA = "stage string, state string, attempts int, selected string, path string"

    def states(self) -> Version:
        return current(self.spark, f"{self.root}/stages")

    def known(self) -> dict[str, dict]:
        seen = self.states()
        if seen.rows is None:
            return {}
        rows = seen.rows.agg(F.to_json(F.collect_list(F.struct(*seen.rows.columns)))).first()[0]
        return {r["stage"]: r for r in json.loads(rows)}

    def _record(self, stage: str, state: str, attempts: int, selected: str | None = None, path: str | None = None) -> None:
        seen, known = self.states(), self.known()
        frozen = known.get(stage, {}).get("selected")
        if frozen is not None and selected != frozen:
            raise StaleWrite(f"Stage {stage} has selected {frozen}; the choice is frozen.")
        known[stage] = {"stage": stage, "state": state, "attempts": attempts, "selected": selected, "path": path}
        rows = [[k.get(c) for c in ("stage", "state", "attempts", "selected", "path")] for k in known.values()]
        commit(self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1), f"{self.root}/stages", seen, f"{stage}: {state}")

    def select(self, stage: str, choice: str) -> None:
        """Record a choice for a complete stage; a second, different one raises ``StaleWrite``."""
        known = self.known()[stage]
        if known["state"] != "complete":
            raise ValueError(f"Stage {stage} is not complete.")
        if known.get("selected") != choice:
            self._record(stage, "complete", known["attempts"], choice, known["path"])

    def resume(self, work: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """The stages' tables, in order; complete ones are read, the others are worked out and written."""
        out = {}
        for stage, make in work.items():
            known = self.known().get(stage, {"state": "new", "attempts": 0})
            if known["state"] != "complete":
                self._record(stage, "started", known["attempts"] + 1)
                path = f"{self.root}/{stage}-{known['attempts'] + 1}"
                make().write.parquet(path)
                self._record(stage, "complete", known["attempts"] + 1, path=path)
            out[stage] = self.spark.read.parquet(self.known()[stage]["path"])
        return out
