"""Keyed tables kept in hash buckets, so that an update rewrites what it touches only."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convoy.settings import discard

BUCKETS = 64
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Committed:
    """One state of all tables: the version that last wrote each bucket, and some facts."""

    version: int = 0
    facts: dict = field(default_factory=dict)
    places: dict[str, dict[int, int]] = field(default_factory=dict)

    @classmethod
    def parse(cls, found: dict) -> Committed:
        places = {t: {int(b): v for b, v in where.items()} for t, where in found["places"].items()}
        return cls(found["version"], found["facts"], places)

    def folders(self) -> set[tuple[str, int, int]]:
        return {(t, v, b) for t, where in self.places.items() for b, v in where.items()}


class BucketStore:
    """Tables with one key, dealt into hash buckets and committed together.

    A commit writes the touched buckets into a folder of its version and then replaces one
    small pointer file, which names the folder of every bucket; so readers see all tables of a
    commit or none. The pointer keeps the state before as well, for a batch that is handed in
    again; folders that neither names are deleted. What a commit reads, writes and deletes
    depends on the touched buckets, the pointer on the number of buckets. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], buckets: int = BUCKETS, key: str = "entity_id"):
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key
        self.tables = {name: StructType.fromDDL(ddl) for name, ddl in tables.items()}

    def bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most one row per bucket

    def state(self, below: int | None = None) -> Committed:
        """The newest committed state, or the newest one older than version ``below``."""
        states = self._states()
        usable = [s for s in states if below is None or s.version < below]
        if not usable:
            raise LookupError(f"no state below version {below} is kept")
        return usable[0]

    def read(self, table: str, state: Committed | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        where = (state or self.state()).places.get(table, {})
        wanted = where if buckets is None else [b for b in buckets if b in where]
        folders = [self._folder(table, where[b], b) for b in wanted]
        if not folders:
            return self.spark.createDataFrame([], self.tables[table])
        return self.spark.read.schema(self.tables[table]).parquet(*folders)

    def commit(self, version: int, base: Committed, touched: Iterable[int], tables: dict[str, DataFrame], facts: dict) -> Committed:
        """Replace the touched buckets of the given tables; the other buckets and tables stay as in ``base``."""
        touched, places = set(touched), dict(base.places)
        for name, rows in tables.items():
            shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.tables[name]], self.bucket().alias(_BUCKET))
            target = f"{self.path}/{name}/version={version}"
            shaped.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(target)
            written = self._written(target)
            kept = {b: v for b, v in base.places.get(name, {}).items() if b not in touched}
            places[name] = kept | {b: version for b in written}
        done = Committed(version, facts, places)
        before = self._states()
        self._point([done, base])
        named = done.folders() | base.folders()
        for name, v, b in {f for s in before for f in s.folders()} - named:
            discard(self.spark, self._folder(name, v, b))
        return done

    # --- files ---

    def _folder(self, table: str, version: int, bucket: int) -> str:
        return f"{self.path}/{table}/version={version}/{_BUCKET}={bucket}"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path, name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, target: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        names = [e.getPath().getName() for e in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")]

    def _states(self) -> list[Committed]:
        """The two kept states, newest first; before the first commit one empty state."""
        path, fs = self._file("pointer.json")
        if not fs.exists(path):
            return [Committed()]
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Committed.parse(s) for s in json.loads(text)]

    def _point(self, states: list[Committed]) -> None:
        """Replace the pointer file in one step."""
        (path, fs), (draft, _) = self._file("pointer.json"), self._file("pointer.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps([{"version": s.version, "facts": s.facts, "places": s.places} for s in states]).encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(draft), fs.makeQualified(path), options
        )
