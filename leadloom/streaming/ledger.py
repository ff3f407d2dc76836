"""Tables that change by committed batches: a batch replayed after a failure changes nothing.

A table is a folder with files of rows and a ledger.  An entry of the ledger names the
batches that are in and the files that are the table; it appears whole or not at all,
by a rename that never replaces.  Rows are dealt to buckets by key, and a batch
rewrites the buckets that it touches alone.  What a failed batch has written is named
by no entry and never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LedgerTable:
    """A keyed table under ``path``; ``schema`` is that of its rows.

    ``keep`` batch ids are remembered: a stream replays its last batch only, so
    that many are more than enough.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *, buckets: int = 16, keep: int = 1000):
        self.spark, self.path, self.schema, self.key, self.buckets, self.keep = spark, path.rstrip("/"), schema, key, buckets, keep

    def _files(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        return jvm.org.apache.hadoop.fs, where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entry(self) -> dict:
        """The last entry: its number, the batches that are in and the files of each bucket."""
        _, where, system = self._files()
        names = sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return {"number": -1, "batches": [], "files": {}}
        return json.loads(self.spark.read.text(f"{self.path}/ledger/{names[-1]}", wholetext=True).first()[0])

    def read(self) -> DataFrame:
        """The rows of the last entry."""
        return self._rows(list(self.entry()["files"].values()))

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/rows/{f}" for f in sorted(files)))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commit(self, batch: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Merge a batch's rows into the buckets that they touch; false, and nothing done, if the batch is in already.

        ``merge`` takes the old and the new rows of these buckets and gives their rows
        from now on; each of its rows has to keep to its key's bucket.
        """
        now = self.entry()
        if batch in now["batches"]:
            return False
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` rows
        files = dict(now["files"])
        if touched:
            columns = [c.split()[0] for c in self.schema.split(", ")]
            old = self._rows([files[str(b)] for b in touched if str(b) in files])
            folder = f"{now['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            rows = merge(old, new).select(*columns).withColumn("bucket", self._bucket())
            rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")
            files = {b: f for b, f in files.items() if int(b) not in touched}
            fs, _, system = self._files()
            for b in touched:
                if system.exists(fs.Path(f"{self.path}/rows/{folder}/bucket={b}")):
                    files[str(b)] = f"{folder}/bucket={b}"
        self._publish({"number": now["number"] + 1, "batches": [*now["batches"], batch][-self.keep :], "files": files})
        return True

    def _publish(self, entry: dict) -> None:
        """Write the entry aside and rename it into place; fails if another writer took its number."""
        fs, where, system = self._files()
        system.mkdirs(where)
        aside, place = fs.Path(where, f".{uuid.uuid4().hex}"), fs.Path(where, f"{entry['number']:012d}.json")
        out = system.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(context.makeQualified(aside), context.makeQualified(place), options)

    def sink(self, merge: Callable[[DataFrame, DataFrame], DataFrame], source: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: commits every batch of the named source once."""

        def put(rows: DataFrame, number: int) -> None:
            rows.persist()
            try:
                self.commit(f"{source}-{number}", rows, merge)
            finally:
                rows.unpersist()

        return put


def state_counters(key: str, state: str, at: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge for states with counters: key, state, since, last, n and failures.

    Rows are taken in order of time.  The same state again keeps since and counts on; another
    one starts at 1.  failures counts error states in a row and is 0 after any other.
    Rows older than what the table knows of their key are late and change nothing.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        known = old.select(key, F.col("last").alias("_last"))
        fresh = new.join(known, key, "left").where(F.col("_last").isNull() | (F.col(at) > F.col("_last"))).select(key, F.col(state).alias("_state"), F.struct(F.col(at).alias("at"), F.col(state).alias("state")).alias("_o"))
        # The batch's last run by aggregates alone: its state, the last row of another state, and the rows behind that.
        ends = fresh.groupBy(key).agg(F.max("_o").alias("_end"))
        other = ~F.col("_state").eqNullSafe(F.col("_end.state"))
        turns = fresh.join(ends, key).groupBy(key, "_end").agg(F.max(F.when(other, F.col("_o"))).alias("_turn"), F.max(F.when(~F.col("_state").eqNullSafe(F.lit("error")), F.col("_o"))).alias("_good"))
        behind = lambda mark: F.col(mark).isNull() | (F.col("_o") > F.col(mark))
        runs = fresh.join(turns, key).groupBy(key, "_end", "_turn", "_good").agg(F.count_if(behind("_turn")).alias("_n"), F.min(F.when(behind("_turn"), F.col("_o.at"))).alias("_since"), F.count_if(behind("_good")).alias("_bad"))
        both = old.join(runs, key, "full_outer")
        came, goes_on = F.col("_end").isNotNull(), F.col("_turn").isNull() & F.col("n").isNotNull() & F.col("state").eqNullSafe(F.col("_end.state"))
        failures = F.when(~F.col("_end.state").eqNullSafe(F.lit("error")), 0).otherwise(F.col("_bad") + F.when(F.col("_good").isNull(), F.coalesce("failures", F.lit(0))).otherwise(0))
        return both.select(
            key,
            F.when(came, F.col("_end.state")).otherwise(F.col("state")).alias("state"),
            F.when(came & ~goes_on, F.col("_since")).otherwise(F.col("since")).alias("since"),
            F.when(came, F.col("_end.at")).otherwise(F.col("last")).alias("last"),
            F.when(came, F.col("_n") + F.when(goes_on, F.col("n")).otherwise(0)).otherwise(F.col("n")).cast("long").alias("n"),
            F.when(came, failures).otherwise(F.col("failures")).cast("long").alias("failures"),
        )

    return merge


def append_absent(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that adds rows of unknown keys; of several new rows of a key the least stays."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c != key]
        one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_x")).select(key, "_x.*")
        return old.unionByName(one.join(old.select(key), key, "left_anti").select(*old.columns))

    return merge
