"""The chunk store: bucketed parquet tables, one partition per ingest run, and a log of commits.

A run writes its chunks, then its state rows, then an empty file into the log, which makes it
visible. State rows name the run whose chunks are current for their document, so chunks become
visible only with the state that points to them, replaced and deleted chunks drop out of every
read at once, and a retried run overwrites its own folders only. Which runs are live is read
from one listing of the log, however many there were. ``fold`` writes all current rows as one
run that replaces every run before it; ``compact`` writes a trimmed copy elsewhere.

Chunks and state are dealt into the same number of buckets by document, so the newest state of each
document and its chunks meet without a shuffle of either. The tables are external ones of the session's catalog,
named after the store's folder; everything about them can be made again from the folder. Applications
that share a store take run numbers by creating a file that only one of them can create.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioseek.plans import sizing
from folioseek.sources.schemas import SCHEMAS

STATE = T.StructType([
    *[f for f in SCHEMAS["sources"].fields if f.name != "id"],
    T.StructField("chunk_run", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
])
CHUNKS = T.StructType([*SCHEMAS["chunks"].fields, T.StructField("error", T.StringType())])


_writers: dict[str, threading.RLock] = {}


class RunTaken(Exception):
    """Another writer has committed the run."""


class ChunkStore:
    """``buckets`` counts for a new store only (the number of shuffle partitions unless given); it is kept in the folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._added: dict[str, set[int]] = {}

    def writing(self) -> threading.RLock:
        """Held by each writer of this application: a store takes one run at a time."""
        return _writers.setdefault(self.root, threading.RLock())

    def _path(self, *parts: str):
        """A folder of the store and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _log(self) -> dict[int, str]:
        """Kind of each live run: ``state`` without chunks of its own, ``chunks``, or ``base``.

        A base holds everything before it, so the runs before the last base are not live.
        """
        fs, folder = self._path("commits")
        if not fs.exists(folder):
            return {}
        names = [status.getPath().getName().split(".") for status in fs.listStatus(folder)]
        runs = {int(run): kind for run, kind in names if run.isdigit()}
        base = max((run for run, kind in runs.items() if kind == "base"), default=-1)
        return {run: runs[run] for run in sorted(runs) if run >= base}

    def committed_runs(self) -> list[int]:
        """Live runs."""
        return list(self._log())

    def is_committed(self, run: int) -> bool:
        """Whether a run is live or was folded into a later one."""
        log = self._log()
        return run in log or any(kind == "base" and run < other for other, kind in log.items())

    def next_run(self) -> int:
        """The lowest number above all that are live or taken."""
        fs, folder = self._path("claims")
        taken = [int(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([*self._log(), *taken], default=-1) + 1

    def claim_run(self) -> int:
        """A run number that no other writer has or gets, in this application or another."""
        run = self.next_run()
        while True:
            fs, claim = self._path("claims", str(run))
            if fs.createNewFile(claim):
                return run
            run += 1

    def _bucket_count(self, create: bool) -> int | None:
        """Buckets of the store; with ``create`` a new store gets them. None for folders without any."""
        fs, layout = self._path("layout")
        if create and not fs.exists(layout):
            wanted = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            if fs.createNewFile(self._path("layout.claim")[1]):
                draft = self._path(f"layout.{uuid.uuid4().hex}")[1]
                stream = fs.create(draft, True)
                stream.write(str(wanted).encode())
                stream.close()
                fs.rename(draft, layout)  # whole or not there
        for _ in range(100):
            if fs.exists(layout):
                stream = fs.open(layout)
                try:
                    return int(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
            if not create:
                return None
            time.sleep(0.1)  # another writer is making it
        raise ValueError(f"the layout of {self.root} was begun and not finished; remove layout.claim")

    def _table(self, table: str, schema: T.StructType, buckets: int) -> str:
        """The catalog's name of a table of this store."""
        name = f"folioseek_{hashlib.md5(self.root.encode()).hexdigest()}_{table}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        path = f"{self.root}/{table}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, run BIGINT) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return name

    def _read(self, table: str, schema: T.StructType, runs: list[int]) -> DataFrame:
        wide = T.StructType([*schema.fields, T.StructField("run", T.LongType())])
        if not runs:
            return self.spark.createDataFrame([], wide)
        buckets = self._bucket_count(create=False)
        if buckets is None:
            paths = [f"{self.root}/{table}/run={run}" for run in runs]
            return self.spark.read.schema(wide).option("basePath", f"{self.root}/{table}").parquet(*paths)
        name = self._table(table, schema, buckets)
        added = self._added.setdefault(table, set())
        new = [run for run in runs if run not in added]
        if new:
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (run={run})" for run in new))
            added.update(new)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).filter(F.col("run").isin(runs)).select(*wide.fieldNames())

    def _write(self, table: str, schema: T.StructType, run: int, rows: DataFrame) -> None:
        """Store rows as one run's partition, in place of what an earlier try left there."""
        from folioseek.sources.tables import conform

        buckets = self._bucket_count(create=True)
        name = self._table(table, schema, buckets)
        fs, folder = self._path(table, f"run={run}")
        fs.delete(folder, True)
        view = f"folioseek_{uuid.uuid4().hex}"
        conform(rows, schema).repartition(buckets, "doc_id").createOrReplaceTempView(view)
        session = rows.sparkSession  # the view is that session's own
        try:
            with sizing.shuffle_files_removed(session):
                session.sql(f"INSERT INTO TABLE {name} PARTITION (run={run}) SELECT * FROM {view}")
        finally:
            session.catalog.dropTempView(view)
        if not fs.exists(folder):
            fs.mkdirs(folder)  # a run without rows

    def _versions(self) -> DataFrame:
        rows = self._read("state", STATE, self.committed_runs())
        newest = F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "run")
        return rows.groupBy("doc_id").agg(newest.alias("_v")).select("doc_id", "_v.*").filter(~F.col("deleted"))

    def run_state(self, run: int) -> DataFrame:
        """State rows that one run wrote; none if it is not committed."""
        return self._read("state", STATE, [run] if run in self.committed_runs() else []).drop("run")

    def sources(self) -> DataFrame:
        """Current state, one row per document."""
        return self._versions().drop("run", "deleted")

    def chunks(self, status: str | None = None, limit: int = sizing.BROADCAST_BYTES) -> DataFrame:
        """Current chunks: those of the run that each document's state points to.

        ``status="DONE"`` gives the searchable ones with the same single join. The state is broadcast within
        ``limit``; past it both sides are read by bucket and joined where they are, without a shuffle.
        """
        state = self._versions()
        if status is not None:
            state = state.filter(F.col("status") == status)
        runs = [run for run, kind in self._log().items() if kind != "state"]
        rows = self._read("chunks", CHUNKS, runs)
        current = state.filter(F.col("chunk_run").isNotNull()).select(F.col("doc_id").alias("_doc"), F.col("chunk_run").alias("_run"))
        if sizing.fits_broadcast(current, limit, measure=True):
            same = (F.col("doc_id") == F.col("_doc")) & (F.col("run") == F.col("_run"))
            return rows.join(F.broadcast(current), same, "left_semi").select(*SCHEMAS["chunks"].fieldNames())
        # the runs are compared as a condition on the side, so that the document alone is the key, as in the buckets
        same = (F.col("doc_id") == F.col("_doc")) & (F.col("run") - F.col("_run") == 0)
        return rows.join(current.hint("merge"), same, "left_semi").select(*SCHEMAS["chunks"].fieldNames())

    def write_chunks(self, run: int, chunks: DataFrame) -> DataFrame:
        """Store the chunks of a run and read them back, errors included."""
        self._write("chunks", CHUNKS, run, chunks)
        return self._read("chunks", CHUNKS, [run]).drop("run")

    def commit(self, run: int, state: DataFrame, base: bool = False) -> None:
        """Store the state rows of a run, which makes the run visible; ``RunTaken`` if it is committed already."""
        if run in self._log():
            raise RunTaken(f"run {run} of {self.root} is committed")
        self._write("state", STATE, run, state)
        fs, chunks = self._path("chunks", f"run={run}")
        kind = "base" if base else "chunks" if fs.exists(chunks) else "state"
        if not fs.createNewFile(self._path("commits", f"{run}.{kind}")[1]):
            raise RunTaken(f"run {run} of {self.root} is committed")

    def fold(self) -> int:
        """Rewrite all current rows as one run, and remove the folders of the runs it replaces.

        A reader that began before may still read removed folders and fail; it reads again. A run that another
        writer had begun before the fold and commits after it is not live; its documents are due again.
        """
        with self.writing():
            old, run = self.committed_runs(), self.claim_run()
            self.write_chunks(run, self.chunks())
            held = F.when(F.col("chunk_run").isNotNull(), F.lit(run))
            self.commit(run, self.sources().withColumns({"chunk_run": held, "deleted": F.lit(False)}), base=True)
            buckets = self._bucket_count(create=False)
            for done in old:
                for table, schema in (("chunks", CHUNKS), ("state", STATE)):
                    fs, folder = self._path(table, f"run={done}")
                    fs.delete(folder, True)
                    if buckets is not None:
                        self.spark.sql(f"ALTER TABLE {self._table(table, schema, buckets)} DROP IF EXISTS PARTITION (run={done})")
                    self._added.get(table, set()).discard(done)
                for kind in ("state", "chunks", "base"):
                    fs, entry = self._path("commits", f"{done}.{kind}")
                    fs.delete(entry, False)
            return run

    def compact(self, root: str) -> ChunkStore:
        """A copy below a new root that holds current rows only, in one run."""
        target = ChunkStore(self.spark, root)
        target.write_chunks(0, self.chunks())
        target.commit(0, self.sources().withColumns({"chunk_run": F.lit(0), "deleted": F.lit(False)}))
        return target
