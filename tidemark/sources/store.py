"""A store of facts: Parquet snapshots in one folder and a numbered pointer to the current one.

Readers see the snapshot that the highest pointer names. Appends add a part folder to it. A rewrite
builds a new snapshot from the parts it has listed and then claims the next pointer number, which only
one writer can create; the loser starts again from the new snapshot, so no rewrite is lost. Parts
appended to the old snapshot meanwhile are carried over, by the rewriter before and after the claim and by an
appender that finds the pointer moved; carrying a file twice changes nothing, as its name stays. All
goes through Spark's file system layer, so any store that Spark writes will do whose ``create`` without
overwriting is atomic.

Rows may also be held in memory (:meth:`FactStore.hold`): single searches see them at once, and
:meth:`FactStore.flush` appends them as one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import maintain
from tidemark.schema import FACTS


class StoreClosed(RuntimeError):
    """A write after close."""


class Conflict(RuntimeError):
    """Another writer claimed the pointer first."""


class FactStore:
    #: How often a rewrite starts again when others move the pointer.
    ATTEMPTS = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._closed, self._held = spark, path.rstrip("/"), False, []

    # -- file system -------------------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(target)) if n[0] not in "_.") if fs.exists(target) else []

    def _head(self) -> tuple[int, str | None]:
        """The number and the snapshot of the current pointer. A number claimed but not yet written does not count."""
        numbers = self._names(f"{self.path}/_pointers")
        for name in reversed(numbers):
            fs, target = self._fs(f"{self.path}/_pointers/{name}")
            stream = fs.open(target)
            try:
                snapshot = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if snapshot:
                return int(numbers[-1]), snapshot
        return int(numbers[-1]) if numbers else 0, None

    def _claim(self, number: int, snapshot: str) -> None:
        fs, target = self._fs(f"{self.path}/_pointers/{number:012d}")
        try:
            stream = fs.create(target, False)
        except Py4JJavaError as e:
            if fs.exists(target):
                raise Conflict(f"pointer {number} of {self.path} is taken") from e
            raise
        stream.write(bytearray(snapshot.encode()))
        stream.close()

    def _parts(self, snapshot: str | None) -> list[str]:
        """The parts of a snapshot that are written to the end."""
        parts = self._names(f"{self.path}/{snapshot}") if snapshot else []
        return [p for p in parts if (lambda fs, done: fs.exists(done))(*self._fs(f"{self.path}/{snapshot}/{p}/_SUCCESS"))]

    def _carry(self, base: str, parts: set[str], new: str) -> None:
        """Copies the finished parts of ``base`` beside ``parts`` into ``new``, file by file; files that are there already stay."""
        for part in set(self._parts(base)) - parts:
            for name in self._names(f"{self.path}/{base}/{part}"):
                fs, target = self._fs(f"{self.path}/{new}/{part}/{name}")
                if fs.exists(target):
                    continue
                _, source = self._fs(f"{self.path}/{base}/{part}/{name}")
                _, draft = self._fs(f"{self.path}/{new}/{part}/_{uuid.uuid4().hex}")
                self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, draft, False, self.spark._jsc.hadoopConfiguration())
                if not fs.rename(draft, target):
                    fs.delete(draft, False)  # another writer carried it
            fs, done = self._fs(f"{self.path}/{new}/{part}/_SUCCESS")
            fs.create(done, True).close()

    def _read(self, snapshot: str | None, parts: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{snapshot}/{p}" for p in (self._parts(snapshot) if parts is None else parts)]
        return self.spark.read.schema(FACTS).parquet(*paths) if paths else self.spark.createDataFrame([], FACTS)

    # -- reading -----------------------------------------------------------------------------
    def facts(self, pending: bool = True) -> DataFrame:
        """All rows of the current snapshot (none of a new store) and, with ``pending``, those held in memory."""
        rows = self._read(self._head()[1])
        for held in self._held if pending else ():
            rows = rows.unionByName(held)
        return rows

    def state(self) -> tuple[str | None, tuple[str, ...]]:
        """What a reader has seen: the snapshot and its parts."""
        snapshot = self._head()[1]
        return snapshot, tuple(self._parts(snapshot))

    def reload(self, seen: tuple[str | None, tuple[str, ...]]) -> tuple[str, DataFrame]:
        """``same``, ``appended`` or ``replaced`` since ``seen``, and the rows to read: none, the new parts', or all."""
        snapshot, parts = self.state()
        if snapshot != seen[0]:
            return "replaced", self._read(snapshot, list(parts))
        new = [p for p in parts if p not in seen[1]]
        return "appended" if new else "same", self._read(snapshot, new)

    def stream(self) -> DataFrame:
        """The appends to the current snapshot as a stream. After a rewrite :meth:`reload` tells that it was replaced."""
        return self.spark.readStream.schema(FACTS).option("recursiveFileLookup", "true").parquet(f"{self.path}/{self._head()[1]}")

    def count(self) -> int:
        return self.facts().count()

    def exists(self, doc_id: str) -> bool:
        return not maintain.get(self.facts(), doc_id).isEmpty()

    def get(self, doc_id: str) -> DataFrame:
        return maintain.get(self.facts(), doc_id)

    # -- writing -----------------------------------------------------------------------------
    def _open(self) -> None:
        if self._closed:
            raise StoreClosed(self.path)

    def hold(self, rows: DataFrame) -> None:
        """Keeps rows in memory: searches see them, :meth:`flush` stores them. They must stay readable until then."""
        self._open()
        self._held.append(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACTS]))

    def flush(self) -> None:
        """Appends what is held as one part."""
        held, self._held = self._held, []
        if held:
            rows = held[0]
            for more in held[1:]:
                rows = rows.unionByName(more)
            self.append(rows)

    def append(self, rows: DataFrame) -> None:
        """Adds rows as one part of the current snapshot. Row ids are the caller's; :meth:`next_row` is the first free one."""
        self._open()
        number, now = self._head()
        while now is None:
            try:
                self._claim(number + 1, f"snapshot-{uuid.uuid4().hex}")
            except Conflict:
                pass
            number, now = self._head()
        part = f"part-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACTS]).write.parquet(f"{self.path}/{now}/{part}")
        while (current := self._head()[1]) != now:
            others = set(self._parts(now)) - {part}
            self._carry(now, others, current)
            now = current

    def next_row(self) -> int:
        return self.facts().agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("n")).first().n

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows by ``change(rows)``. If another rewrite comes first, ``change`` is applied again to its result."""
        self._open()
        self.flush()
        for _ in range(self.ATTEMPTS):
            number, base = self._head()
            parts = self._parts(base)
            new = f"snapshot-{uuid.uuid4().hex}"
            rows = change(self._read(base, parts))
            rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACTS]).write.parquet(f"{self.path}/{new}/part-{uuid.uuid4().hex}")
            if base:
                self._carry(base, set(parts), new)
            try:
                self._claim(number + 1, new)
            except Conflict:
                fs, target = self._fs(f"{self.path}/{new}")
                fs.delete(target, True)
                continue
            if base:
                self._carry(base, set(parts), new)  # what was appended between the two
            return
        raise Conflict(f"{self.path} was rewritten by others {self.ATTEMPTS} times")

    def replace(self, rows: DataFrame) -> None:
        """A full rewrite with rows that don't depend on the stored ones."""
        self.rewrite(lambda _: rows)

    def delete(self, **criteria) -> int:
        """Rewrites without the rows that meet all criteria; how many went."""
        gone = self.facts().where(maintain.delete_predicate(**criteria)).count()
        if gone:
            self.rewrite(lambda facts: maintain.delete(facts, **criteria))
        return gone

    def forget_superseded(self, dry_run: bool = False, **rules) -> DataFrame:
        """The rows that retention drops; they are dropped unless ``dry_run``."""
        dropped = maintain.forget_superseded(self.facts(), **rules)
        if not dry_run:
            self.rewrite(lambda facts: facts.join(maintain.forget_superseded(facts, **rules).select("row_id"), "row_id", "left_anti"))
        return dropped

    def compact(self, partitions: int, by_cell: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rewrites as so many files, by row id or by the ``cell`` that ``by_cell`` adds."""
        order = ["row_id"] if by_cell is None else ["cell", "row_id"]
        self.rewrite(lambda facts: (facts if by_cell is None else by_cell(facts)).repartitionByRange(partitions, *order).sortWithinPartitions(*order))

    def export(self, target: FactStore, purge: bool = False, **criteria) -> int:
        """Appends the matching rows to another store; ``purge`` removes them here."""
        match, _ = maintain.export(self.facts(), **criteria)
        n = match.count()
        target.append(match)
        if purge and n:
            self.rewrite(lambda facts: maintain.export(facts, **criteria)[1])
        return n

    def merge(self, incoming: DataFrame, origin: str, **options) -> dict:
        """Appends another store's rows; ``incoming``, ``added`` and ``duplicates_skipped`` counts."""
        rows = maintain.merge(self.facts(), incoming, origin, **options)
        n, before = incoming.count(), self.count()
        self.append(rows)
        added = self.count() - before
        return {"incoming": n, "added": added, "duplicates_skipped": n - added}

    def close(self) -> None:
        self._closed = True


def profile_path(root: str, user: str) -> str:
    """The folder of a user's store: letters, digits, dots, dashes and underscores only."""
    name = maintain.file_name(user)
    if name in (".", "..", ""):
        raise ValueError(f"no profile can be named {user!r}")
    return f"{root.rstrip('/')}/{name}"
