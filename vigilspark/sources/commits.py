"""One commit for the rows of several tables, and a key index that keeps replays out.

A batch is written under names that nobody reads yet; one manifest, renamed into place
without overwriting, makes all of it visible at once. Readers see the paths of committed
manifests only, so a run that dies between any two writes leaves nothing but unread
files, and its replay writes the batch anew. Two writers that commit at once race for one
manifest number; the loser looks at the winner's keys and tries again.

The index holds the keys of every commit in buckets with a Bloom filter each; up to
FILES_PER_DAY buckets of a day have a file each, more share them. A batch asks the filters of
its own days and reads only those index files that may hold one of its keys.

<folder>/_commits/<number>.json    manifests; every SNAPSHOT-th also lists all before it
<folder>/data/<table>/<stage>/     rows
<folder>/index/<stage>/day=/bucket=/   keys
<folder>/filters/<stage>/          day, bucket, bits of each index file
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Keys that share a Bloom filter on average, its bits and its hash functions: about 1 in 200 answers is a false yes.
KEYS_PER_FILTER, FILTER_BITS, HASHES = 2000, 32768, 4
#: Index files of one day in one commit, at most: the buckets share them, so a large batch has larger files, not more.
FILES_PER_DAY = 32
SNAPSHOT = 50
_KEY = "spark.checkpoint.dir"


class Conflict(Exception):
    """Another writer has taken the manifest's number."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share; a local session that names none gets one of its own."""
    top = spark.conf.get(_KEY, None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="vigilspark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: its lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """The few file operations a commit needs, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file appears whole or not at all, and never over another."""
        staged = self._at(f"_staged/{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(staged, self._at(name), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self._fs.delete(staged, False)
                raise Conflict(name) from e
            raise


def identity(key: str) -> Column:
    """The key as text; a row without one is known by the hash of its content."""
    return F.coalesce(F.col(key).cast("string"), F.sha2(F.to_json(F.struct("*")), 256))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with _key, of rows of one key the first by `order` (then by content)."""
    marked = rows.withColumn("_key", identity(key)).withColumn("_text", F.to_json(F.struct(*sorted(rows.columns))))
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(order, "_text"))
    return marked.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_text")


class Store:
    """Tables under one folder that are written together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)
        #: index files that the last commit read, and how many there were
        self.probed: list[str] = []
        self.index_files = 0

    # -- what is committed

    def manifests(self) -> list[dict]:
        """Committed manifests in order."""
        names = self.folder.names("_commits")
        at = max((i for i, n in enumerate(names) if int(n[:20]) % SNAPSHOT == 0), default=None)
        if at is None:
            return [json.loads(self.folder.text(f"_commits/{n}")) for n in names]
        last = json.loads(self.folder.text(f"_commits/{names[at]}"))
        return [*last.pop("before"), last, *(json.loads(self.folder.text(f"_commits/{n}")) for n in names[at + 1 :])]

    def read(self, name: str) -> DataFrame:
        """The committed rows of a table."""
        done = [m for m in self.manifests() if name in m["tables"]]
        if not done:
            raise KeyError(name)
        schema = T.StructType.fromJson(json.loads(done[-1]["schemas"][name]))
        paths = [f"{self.folder.path}/{m['tables'][name]}" for m in done if m["rows"].get(name)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -- keys

    def _known(self, keys: DataFrame, manifests: list[dict]) -> DataFrame | None:
        """Keys (_key, _day) that are committed; None if no index file may hold any."""
        runs = [m for m in manifests if m.get("buckets")]
        self.probed, self.index_files = [], sum(m["files"] for m in runs)
        if not runs:
            return None
        filters = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.folder.path}/filters/{m['stage']}").withColumns({"run": F.lit(m["stage"]), "of": F.lit(m["buckets"])}) for m in runs))
        sizes = sorted({m["buckets"] for m in runs})  # powers of two, so few
        asked = keys.select("_day", "_key", F.explode(F.array(*map(F.lit, sizes))).alias("of")).withColumn("bucket", _bucket(F.col("of")))
        byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        all_set = reduce(lambda a, b: a & b, (F.getbit(byte(p), (p % 8).cast("int")) == 1 for p in _positions()))
        hits = asked.join(filters, ["_day", "bucket", "of"]).where(all_set).select("run", "_day", _file()).distinct().collect()  # names of files, FILES_PER_DAY a day and commit at most
        self.probed = sorted(f"index/{r['run']}/_day={r['_day']}/bucket={r['bucket']}" for r in hits)
        if not self.probed:
            return None
        return self.spark.read.schema("_key string").parquet(*(f"{self.folder.path}/{p}" for p in self.probed))

    # -- commits

    def _write(self, df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
        out = df.write.partitionBy(*by) if by else df.write
        out.parquet(f"{self.folder.path}/{path}")

    def commit(self, batch: str, groups: dict[str, tuple[DataFrame, str, str | None]], derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None, attempts: int = 5) -> dict[str, int]:
        """Write the rows of a batch whose key is new, all tables or none; returns the rows of each table.

        groups: table -> (rows, key, column of the day's time or None); derived: table -> (group, function of the group's new
        rows). Rows of one key must always have the same day, as keys that are derived from the time do; without a day they
        are looked up in the whole index. A batch that is committed already writes nothing.
        """
        derived = derived or {}
        for _ in range(attempts):
            before = self.manifests()
            if any(m["batch"] == batch for m in before):
                return dict.fromkeys([*groups, *derived], 0)
            try:
                return self._try(batch, groups, derived, before)
            except Conflict:
                continue
        raise Conflict(f"{batch}: other writers came first {attempts} times")

    def _try(self, batch: str, groups: dict, derived: dict, before: list[dict]) -> dict[str, int]:
        stage, top = uuid.uuid4().hex, self.folder.path
        day = lambda c: F.coalesce(F.date_format(F.to_date(F.timestamp_seconds(F.floor(F.unix_micros(c) / 1e6))), "yyyy-MM-dd"), F.lit("none")) if c else F.lit("all")
        fresh = {}
        for name, (rows, key, at) in groups.items():
            first = first_rows(rows, key, at or key).withColumn("_key", F.concat(F.lit(f"{name}:"), "_key")).withColumn("_day", day(at))
            self._write(first, f"data/_arrived/{stage}-{name}")  # the batch may be dear to compute, and is read three times
            fresh[name] = self.spark.read.schema(first.schema).parquet(f"{top}/data/_arrived/{stage}-{name}")
        known = self._known(reduce(DataFrame.unionByName, (f.select("_key", "_day") for f in fresh.values())), before)
        tables, schemas, counts, keys = {}, {}, {}, []
        for name, rows in fresh.items():
            new = rows.join(known, "_key", "left_anti") if known is not None else rows
            self._write(new, f"data/{name}/{stage}")
            staged = self.spark.read.schema(rows.schema).parquet(f"{top}/data/{name}/{stage}")
            keys.append(staged.select("_key", "_day"))
            fresh[name] = staged.drop("_key", "_day")
            counts[name] = staged.count()
        for name, (group, fn) in derived.items():
            fresh[name] = fn(fresh[group])
            self._write(fresh[name], f"data/{name}/{stage}")
            counts[name] = self.spark.read.parquet(f"{top}/data/{name}/{stage}").count()
        for name in counts:
            tables[name], schemas[name] = f"data/{name}/{stage}", fresh[name].schema.json()
        n = sum(counts[g] for g in groups)
        manifest = {"batch": batch, "stage": stage, "tables": tables, "schemas": schemas, "rows": counts, "buckets": 0, "files": 0}
        if n:
            all_keys = reduce(DataFrame.unionByName, keys)
            days = all_keys.select("_day").distinct().count()
            buckets = 1
            while buckets * KEYS_PER_FILTER * days < n:  # every day has as many
                buckets *= 2
            all_keys = all_keys.withColumn("bucket", _bucket(F.lit(buckets)))
            self._write(all_keys.select("_key", "_day", _file()).repartition("_day", "bucket"), f"index/{stage}", ("_day", "bucket"))
            # keys are dealt before they are aggregated: a bitmap of each task and bucket would be far more than the keys
            bits = all_keys.repartition("_day", "bucket").select("_day", "bucket", F.explode(F.array(*_positions())).alias("p")).groupBy("_day", "bucket").agg(F.bitmap_construct_agg("p").alias("bits"))
            self._write(bits, f"filters/{stage}")
            manifest |= {"buckets": buckets, "files": self.spark.read.parquet(f"{top}/filters/{stage}").select("_day", _file()).distinct().count()}
        number = len(before) + 1
        if number % SNAPSHOT == 0:
            manifest["before"] = before
        self.folder.publish(f"_commits/{number:020d}.json", json.dumps(manifest))
        for name in groups:
            self.folder.delete(f"data/_arrived/{stage}-{name}")
        return counts

    def vacuum(self, older_than_seconds: float = 7 * 86400.0) -> list[str]:
        """Remove what dead runs left: stages that no manifest names and that are older than any run lasts."""
        live, gone = {m["stage"] for m in self.manifests()}, []
        for top in (*(f"data/{t}" for t in self.folder.names("data")), "index", "filters", "_staged"):
            for name in self.folder.names(top):
                if name.split("-")[0] not in live and self.folder.age(f"{top}/{name}") >= older_than_seconds:
                    self.folder.delete(f"{top}/{name}")
                    gone.append(f"{top}/{name}")
        return gone


def _bucket(of: Column) -> Column:
    return F.pmod(F.xxhash64("_key"), of).cast("int")


def _file() -> Column:
    """The file of a bucket of its day."""
    return (F.col("bucket") % FILES_PER_DAY).alias("bucket")


def _positions() -> list[Column]:
    return [F.pmod(F.xxhash64("_key", F.lit(i)), F.lit(FILTER_BITS)) for i in range(HASHES)]


def persist_operational(facts: DataFrame, events: DataFrame, folder: str, actor: str, batch: str | None = None) -> dict[str, int]:
    """Fact, event, audit and outbox rows of what is new, in one commit; read them by Store(spark, folder).read(table).

    Facts and events are keyed by event_id, which binds the event's time; without a batch id the content alone keeps replays out.
    """
    audit = lambda e: e.select("event_id", "event_type", "event_time", F.lit(actor).alias("actor"), F.lit("operational_event.persisted").alias("action"))
    outbox = lambda e: e.select("event_id", "event_type", "event_time", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    store = Store(events.sparkSession, folder)
    return store.commit(batch or uuid.uuid4().hex, {"facts": (facts, "event_id", "event_time"), "events": (events, "event_id", "event_time")}, {"audit": ("events", audit), "outbox": ("events", outbox)})
