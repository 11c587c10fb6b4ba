"""The five tables of the model, read as written or derived from the documents of the test data."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import caption_end, drop_empty_interval
from .scratch import cut, drop

SCHEMAS = {
    "programs": "program_id long, title string, normalized_title string",
    "ts_files": "ts_file_id long, path string, filename string, status string, error_msg string, ingested_at timestamp_ntz, program_id long, episode_number int, episode_title string, air_date date, pes_regen int",
    "captions": "caption_id long, ts_file_id long, pos long, pts_start long, pts_end long, text string",
    "tags": "caption_id long, tag string",
    "thumbnails": "caption_id long, selected_frame int",
}
STATUSES = ("pending", "ingesting", "done", "error")


@dataclass
class Tables:
    programs: DataFrame
    ts_files: DataFrame
    captions: DataFrame
    tags: DataFrame
    thumbnails: DataFrame
    raw: dict[str, DataFrame]

    def with_(self, **changed: DataFrame) -> Tables:
        return Tables(**{k: changed.get(k, getattr(self, k)) for k in SCHEMAS}, raw=self.raw)

    def register(self) -> None:
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)


class Conflict(Exception):
    """Another writer has published a version meanwhile."""


class Store:
    """The tables under a path, as a series of versions.

    A version is a small file that names, for each table, the folders with rows that were put and with keys that are gone.
    Folders are written first and never changed; the version file then appears under its number by one rename, or not at
    all.  So a reader sees a whole version, a writer that dies leaves the last one, and of two writers that started from
    one version the second gets a Conflict.  A commit writes the rows it changes and no others.

    Rows are gone for whom a later folder holds their key: KEYS names the column, which for captions is that of their file.
    """

    KEYS = {"programs": "program_id", "ts_files": "ts_file_id", "captions": "ts_file_id", "tags": "caption_id", "thumbnails": "caption_id"}
    IDS = {"programs": "program_id", "ts_files": "ts_file_id", "captions": "caption_id"}

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] | None = None, keys: dict[str, str] | None = None):
        """Of the five tables, or of others with a key each."""
        self.spark, self.path = spark, path
        self.schemas, self.keys, self.ids = schemas or SCHEMAS, keys or self.KEYS, {} if schemas else self.IDS
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the latest version; 0 if there is none."""
        folder = self.hadoop.Path(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": {t: [] for t in self.schemas}, "top": {}, "marks": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:010d}.json", wholetext=True).first()[0])

    def load(self, version: int | None = None) -> Tables:
        """The five tables of a version, the latest if none is named."""
        parts = self.manifest(version)["parts"]
        return Tables(**{t: self.rows(t, parts[t]) for t in SCHEMAS}, raw={})

    def rows(self, table: str, parts: list[dict] | None = None) -> DataFrame:
        """The rows of a table that count, in the latest version if no parts are named."""
        parts = self.manifest()["parts"][table] if parts is None else parts
        key = self.keys[table]
        kind = dict(self.spark.createDataFrame([], self.schemas[table]).dtypes)[key]
        put = self.read(table, "put", self.schemas[table], parts)
        if all(p["kind"] == "put" for p in parts):
            return put.drop("_v")
        gone = self.read(table, "gone", f"{key} {kind}", parts).groupBy(key).agg(F.max("_v").alias("_gone"))
        return put.join(gone, key, "left").where("_gone is null or _v >= _gone").select(*[c for c in put.columns if c != "_v"])

    def read(self, table: str, kind: str, schema: str, parts: list[dict]) -> DataFrame:
        folders = [f"{self.path}/{table}/{kind}/_v={p['version']}/_u={p['name']}" for p in parts if p["kind"] == kind]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, _v long")
        return self.spark.read.schema(f"{schema}, _v long, _u string").option("basePath", f"{self.path}/{table}/{kind}").parquet(*folders).drop("_u")

    def top(self, table: str) -> DataFrame:
        """One row with the largest id that the table ever had, for mutate.next_ids(); the table is not read."""
        most = self.manifest()["top"].get(table, -1)
        return self.spark.range(1).select(F.lit(most).cast("long").alias(self.ids[table]))

    def commit(self, put: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, based_on: int | None = None, mark: tuple[str, int] | None = None) -> int:
        """Publishes a version in which the keys in gone are without their former rows and the rows in put are there.

        based_on: the version that the changes were made from, the latest if none is named.  mark: a writer's name and the
        number of its step; a step that is not above the writer's last one was committed before, and nothing happens.
        """
        based_on = self.version() if based_on is None else based_on
        m = self.manifest(based_on)
        if mark and m["marks"].get(mark[0], -1) >= mark[1]:
            return based_on
        number = based_on + 1
        for kind, changes in (("gone", gone or {}), ("put", put)):
            for table, df in changes.items():
                name = uuid.uuid4().hex
                df = df.select(self.keys[table]).distinct() if kind == "gone" else df.select(*[F.col(f.split()[0]) for f in self.schemas[table].split(", ")])
                most = Observation()
                if kind == "put" and table in self.ids:
                    df = df.observe(most, F.max(self.ids[table]).alias("top"))
                df.write.parquet(f"{self.path}/{table}/{kind}/_v={number}/_u={name}")
                m["parts"][table].append({"kind": kind, "version": number, "name": name})
                if kind == "put" and table in self.ids and (top := most.get["top"]) is not None:
                    m["top"][table] = max(top, m["top"].get(table, -1))
        if mark:
            m["marks"][mark[0]] = mark[1]
        return self.publish(m, number)

    def publish(self, m: dict, number: int) -> int:
        m["version"] = number
        folder = f"{self.path}/_versions"
        new, final = self.hadoop.Path(f"{folder}/{uuid.uuid4().hex}.new"), self.hadoop.Path(f"{folder}/{number:010d}.json")
        self.fs.mkdirs(self.hadoop.Path(folder))
        out = self.fs.create(new, False)
        out.write(json.dumps(m).encode())
        out.close()
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(new), self.fs.makeQualified(final), how)
        except Py4JJavaError as e:
            self.fs.delete(new, False)
            if self.fs.exists(final):
                raise Conflict(f"version {number} of {self.path} is there already") from e
            raise
        return number

    def advance(self, before: Tables, after: Tables, based_on: int, mark: tuple[str, int] | None = None) -> int:
        """Commits the difference of two states.  Tables that are the same object in both are not read; where no row
        differs and there is no mark, no version is made."""
        put, gone, kept = {}, {}, []
        for table, key in self.keys.items():
            a, b = getattr(before, table), getattr(after, table)
            if a is b:
                continue
            b = b.select(*a.columns)
            touched = cut(a.exceptAll(b).select(key).union(b.exceptAll(a).select(key)).distinct())
            kept.append(touched)
            if not touched.isEmpty():
                put[table] = b.join(touched, key, "left_semi")
                replaced = touched.join(a, key, "left_semi")
                if not replaced.isEmpty():
                    gone[table] = replaced
        try:
            return self.commit(put, gone, based_on, mark) if put or mark else based_on
        finally:
            for df in kept:
                drop(df)

    def change(self, transform: Callable[[Tables], Tables], tries: int = 5) -> int:
        """Loads, transforms and advances; from the start again if another writer came first."""
        for left in range(tries, 0, -1):
            version = self.version()
            before = self.load(version)
            try:
                return self.advance(before, transform(before), version)
            except Conflict:
                if left == 1:
                    raise
        return self.version()

    def compact(self, most_parts: int = 20) -> int:
        """Tables of more than most_parts folders get a single one with the rows that count; left out if another writer
        publishes meanwhile."""
        version = self.version()
        m = self.manifest(version)
        number = version + 1
        due = [t for t, parts in m["parts"].items() if len(parts) > most_parts]
        for table in due:
            name = uuid.uuid4().hex
            self.rows(table, m["parts"][table]).write.parquet(f"{self.path}/{table}/put/_v={number}/_u={name}")
            m["parts"][table] = [{"kind": "put", "version": number, "name": name}]
        try:
            return self.publish(m, number) if due else version
        except Conflict:
            return self.version()

    def vacuum(self, keep: int = 10) -> int:
        """Deletes versions before the last `keep`, and folders that none of those name: of former versions, and of commits
        that failed.  Returns the number of folders.  To be called while no writer is at work."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1) if self.fs.exists(self.hadoop.Path(f"{self.path}/_versions/{v:010d}.json"))]
        used = {(t, p["kind"], p["version"], p["name"]) for v in kept for t, parts in self.manifest(v)["parts"].items() for p in parts}
        n = 0
        for table in self.schemas:
            for kind in ("put", "gone"):
                for f in self.fs.globStatus(self.hadoop.Path(f"{self.path}/{table}/{kind}/_v=*/_u=*")) or ():
                    folder = f.getPath()
                    number, name = (x.getName().split("=")[1] for x in (folder.getParent(), folder))
                    if (table, kind, int(number), name) not in used:
                        n += self.fs.delete(folder, True)
        for v in range(1, last - keep + 1):
            self.fs.delete(self.hadoop.Path(f"{self.path}/_versions/{v:010d}.json"), False)
        return n


def load(spark: SparkSession, path: str) -> Tables:
    """Tables stored under path, in their latest version."""
    return Store(spark, path).load()


def store(tables: Tables, path: str) -> None:
    """All tables as the first version of a new store."""
    new = Store(tables.ts_files.sparkSession, path)
    if new.version():
        raise FileExistsError(path)
    new.commit({t: getattr(tables, t) for t in SCHEMAS})


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """A document is a recording, its lines are captions, its source is the programme.

    Only scans, projections and two joins on document ids: nothing is shuffled until a query asks for it.
    """
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "events", "orders", "conversations")}
    d = raw["documents"]
    i = F.col("doc_id")
    number = F.substr("source", F.lit(4)).cast("long") + 1
    ts_files = d.select(
        i.alias("ts_file_id"),
        F.concat(F.lit("/rec/"), "source", F.lit("/"), i.cast("string"), F.lit(".ts")).alias("path"),
        F.concat(i.cast("string"), F.lit(".ts")).alias("filename"),
        F.when(i % 20 == 0, "error").when(i % 20 == 1, "pending").when(i % 20 == 2, "ingesting").otherwise("done").alias("status"),
        F.when(i % 40 == 0, "decode failed").alias("error_msg"),
        F.when(i % 20 > 2, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)")).alias("ingested_at"),
        F.when(i % 17 != 0, number).alias("program_id"),
        F.when((number % 5 != 0) & (i % 7 != 0), (i % 13).cast("int")).alias("episode_number"),
        F.when(i % 3 != 0, F.concat("lang", F.lit(" "), (i % 4).cast("string"))).alias("episode_title"),
        F.when(i % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))).alias("air_date"),
        F.when(i % 50 == 3, 1).when(i % 50 == 4, 2).otherwise(0).cast("int").alias("pes_regen"),
    )
    programs = d.select(number.alias("program_id"), F.col("source").alias("title"), F.lower("source").alias("normalized_title")).distinct()
    lines = d.where(i % 20 > 2).select(i.alias("ts_file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.select("ts_file_id", F.col("pos").cast("long").alias("pos"), F.btrim("text", F.lit(" \t\r")).alias("text")).where("text <> ''")
    pos = F.col("pos")
    lines = lines.select((F.col("ts_file_id") * 100000 + pos).alias("caption_id"), "ts_file_id", "pos", (pos * 2500 + F.col("ts_file_id") % 1000).alias("pts_start"), F.when(pos % 4 == 0, 2000).when(pos % 9 == 8, 0).alias("duration"), "text")
    captions = drop_empty_interval(caption_end(lines, "ts_file_id", "pos")).select("caption_id", "ts_file_id", "pos", "pts_start", "pts_end", "text")
    c = captions.select("caption_id", F.col("ts_file_id").alias("doc_id"), "pos")
    tags = c.where(pos % 5 == 0).join(d.select("doc_id", "lang"), "doc_id").select("caption_id", F.col("lang").alias("tag"))
    labels = raw["labels"]
    for name, column, every in (("quality", "quality", 2), ("toxic", "toxic", 3)):
        some = labels.where(F.col(column) == 1).select("doc_id")
        tags = tags.unionByName(c.where(pos % every == 0).join(some, "doc_id").select("caption_id", F.lit(name).alias("tag")))
    thumbnails = c.where(pos % 3 == 0).join(labels.select("doc_id"), "doc_id").select("caption_id", (pos % 6).cast("int").alias("selected_frame"))
    return Tables(programs, ts_files, captions, tags, thumbnails, raw)
