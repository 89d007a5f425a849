"""A keyed table on disk whose changes rewrite only the partitions that they hit.

Rows lie in Parquet folders by partition: a hash of the key, or a column as a day. A version is a manifest, a small
JSON file that names each partition's folder; a change writes new folders for its partitions and then the next
version's manifest. Until that file is there readers see the old version, so a run that is killed leaves nothing but
folders that vacuum removes, and of two runs that change the same version one fails and may begin again. A manifest also
holds notes (the last batch of a stream, a cursor), which change with the rows or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources.shared import Files

PART = "store_part"


class Conflict(RuntimeError):
    """Another run has written the next version first."""


@dataclass
class Manifest:
    """Number of the version, folder by partition, and notes."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


@dataclass
class Written:
    """What a change did: its version, the partitions it read and those it wrote."""

    version: int
    read: list[str]
    written: list[str]


class Store:
    """Rows of a schema by key columns, in buckets by their hash or in partitions by an expression."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64, part: Column | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        # the hash of a null key counts as any other
        self.part = part if part is not None else F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
        self.files = Files(spark, self.path)

    # ------------------------------------------------------------ versions

    def manifest(self, number: int | None = None) -> Manifest:
        """The given version, or the last."""
        known = sorted(int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json"))
        if not known:
            return Manifest()
        number = known[-1] if number is None else number
        found = json.loads(self.files.read(f"versions/{number}.json"))
        return Manifest(number, found["parts"], found["notes"])

    def _commit(self, old: Manifest, parts: dict[str, str], notes: dict[str, str]) -> int:
        text = json.dumps({"parts": parts, "notes": old.notes | notes})
        if not self.files.write_new(f"versions/{old.number + 1}.json", text):
            raise Conflict(f"version {old.number + 1} of {self.path} is there already")
        return old.number + 1

    def note(self, name: str) -> str | None:
        return self.manifest().notes.get(name)

    def set_note(self, name: str, value: str, expected: str | None) -> bool:
        """Compare and set: whether the note was as expected and now is value."""
        old = self.manifest()
        if old.notes.get(name) != expected:
            return False
        try:
            self._commit(old, old.parts, {name: value})
        except Conflict:
            return False
        return True

    # ------------------------------------------------------------ rows

    def read(self, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its partitions: only their files are listed."""
        return self._rows(self.manifest(version), parts)

    def _rows(self, m: Manifest, parts: list[str] | None) -> DataFrame:
        at = [f"{self.path}/data/{m.parts[p]}" for p in (m.parts if parts is None else parts) if p in m.parts]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], notes: dict[str, str] | None = None, parts: list[str] | None = None) -> Written:
        """apply(current rows of the partitions that changes hit, changes) takes the place of these rows.

        changes has the columns that partitions are made of and is computed twice, for its partitions and for its rows;
        parts names the partitions instead. All rows of a partition must belong to it afterwards as well.
        """
        old = self.manifest()
        if parts is None:
            parts = [r[0] for r in changes.select(self.part.alias(PART)).distinct().collect()]  # as many as there are partitions
        if not parts:
            return Written(self._commit(old, old.parts, notes) if notes else old.number, [], [])
        new = apply(self._rows(old, parts), changes).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        run = uuid.uuid4().hex
        at = f"{self.path}/data/{run}"
        new.withColumn(PART, self.part).repartition(PART).write.partitionBy(PART).parquet(at)
        made = {self._value(n): f"{run}/{n}" for n in self.files.names(f"data/{run}") if n.startswith(f"{PART}=")}
        if strange := set(made) - set(parts):
            raise ValueError(f"rows of partitions that the change doesn't hit: {sorted(strange)[:5]}")
        kept = {p: at for p, at in old.parts.items() if p not in parts}
        return Written(self._commit(old, kept | made, notes or {}), [p for p in parts if p in old.parts], sorted(made))

    @staticmethod
    def _value(folder: str) -> str:
        return folder.split("=", 1)[1]

    def drop_parts(self, gone: Callable[[str], bool]) -> Written:
        """A version without the partitions of which gone holds; no row is read."""
        old = self.manifest()
        kept = {p: at for p, at in old.parts.items() if not gone(p)}
        return Written(old.number if len(kept) == len(old.parts) else self._commit(old, kept, {}), [], [])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all versions but the last ones, and the folders that none of these names; not while a change runs."""
        known = sorted(int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json"))
        used = {at for n in known[-keep:] for at in self.manifest(n).parts.values()}
        gone = [f"{run}/{p}" for run in self.files.names("data") for p in self.files.names(f"data/{run}") if p.startswith(f"{PART}=") and f"{run}/{p}" not in used]
        for at in gone:
            self.files.remove(f"data/{at}")
        for run in self.files.names("data"):
            if not any(at.startswith(f"{run}/") for at in used):
                self.files.remove(f"data/{run}")
        for n in known[:-keep]:
            self.files.remove(f"versions/{n}.json")
        return gone
