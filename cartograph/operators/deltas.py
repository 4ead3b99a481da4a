"""Tables kept up to date by appended changes: a base, and the deltas since.

A batch of changes is merged to one row per key and written as a folder of its
own; nothing that is stored is rewritten. Readers merge the newest base with
the deltas after it. :meth:`DeltaTable.compact` folds the deltas into the next
base. The merge must not depend on how rows are grouped (a sum, the row of the
greatest number).

Every step can be lost and run again:

* a folder counts once its writer has committed (``_SUCCESS``), so a half
  written delta or base is never read;
* a batch that is replayed overwrites its own folder, and one that the base
  holds already is passed over, so it is never counted twice;
* a base is named after the last batch in it, and deltas up to that one are
  ignored whether or not they have been deleted yet;
* files that only an older base needs are deleted one compaction later, so
  readers that began before can finish.

Batches are numbered upwards and written by one writer, as a stream does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class DeltaTable:
    """``merge`` takes rows of ``schema`` to one row per key; see the module."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the committed folders of a kind, ascending."""
        p, fs = self._fs(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if fs.exists(self._fs(f"{self.path}/{kind}/{n}/_SUCCESS")[0])]
        return sorted(int(n[1:]) for n in done)

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/n{number:019d}"

    def _read(self, *folders: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def folded(self) -> int:
        """The last batch that the base holds; -1 before the first compaction."""
        return max(self._numbers("base"), default=-1)

    def append(self, batch: int, rows: DataFrame) -> None:
        """Add the changes of a batch (any number of rows per key)."""
        if batch > self.folded():
            columns = self._read().columns
            self.merge(rows.select(*columns)).select(*columns).write.mode("overwrite").parquet(self._folder("delta", batch))

    def _upto(self, last: int | None = None) -> DataFrame:
        base = self.folded()
        folders = [self._folder("base", base)] if base >= 0 else []
        folders += [self._folder("delta", b) for b in self._numbers("delta") if b > base and (last is None or b <= last)]
        return self.merge(self._read(*folders))

    def current(self) -> DataFrame:
        """One row per key: the base and all deltas after it, merged."""
        return self._upto()

    def compact(self) -> None:
        """Fold all deltas into a new base and delete what the one before
        replaced. Safe to stop anywhere and to run again."""
        bases, deltas = self._numbers("base"), self._numbers("delta")
        last = deltas[-1] if deltas else -1
        if last > (bases[-1] if bases else -1):
            self._upto(last).write.mode("overwrite").parquet(self._folder("base", last))
            bases.append(last)
        if len(bases) > 1:
            for kind, old in [("base", b) for b in bases[:-2]] + [("delta", d) for d in deltas if d <= bases[-2]]:
                p, fs = self._fs(self._folder(kind, old))
                fs.delete(p, True)
