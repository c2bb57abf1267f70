"""Stage tables of a run under declared schemas, and a manifest of what was committed that a crash can't spoil."""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlineage.config import Settings
from textlineage.sources import artifacts

log = logging.getLogger(__name__)

VECTORS = "id string, yr int, term string, term_id int, tf long, idf double, w double"
#: Columns of each stage's table. A table without rows is read by them, as is one that has no folder for a year.
SCHEMAS = {
    "docs_per_year": "yr int, docs long",
    "term_df": "yr int, term string, df long",
    "vocab": "term string, df long, term_id int",
    "vectors": VECTORS,
    "vectors_filtered": VECTORS,
    "postings": "yr int, term_id int, part int, n_docs long, docs array<struct<id: string, w: double>>, max_w double",
    "pairs": "yr_x int, yr_y int, side string, id string, contrib double, hits long, touched long, ops long",
    "pair_meta": "yr_x int, yr_y int, nx long, ny long, avg_touched double, max_touched long, hits long, ops long, thr double, window_size int, method_version string, vectors_dir string",
    "bsfs": "id string, yr int, bs double, fs double",
}


def schema_of(stage: str, s: Settings) -> T.StructType:
    strings = lambda names: [T.StructField(c, T.StringType()) for c in names]
    if stage == "tokens":
        return T.StructType(T.StructType.fromDDL("id string, yr int, title string, tokens array<string>").fields + strings(s.extra_cols))
    if stage == "final":
        return T.StructType(strings([s.col_id, s.col_year, s.col_title, "BS", "FS", "Quality_q", *s.extra_cols]))
    return T.StructType.fromDDL(SCHEMAS[stage])


#: Columns that later stages see nothing of, so that a change of them alone makes nothing anew.
UNSEEN = {"vocab": ("df",)}


def content_of(name: str, schema: T.StructType) -> Column:
    """A sum over rows that tells contents apart, whatever their order and the last digits of sums."""
    cols = [F.round(f"`{f.name}`", 9) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in schema if f.name not in UNSEEN.get(name, ())]
    # Nulls change no hash, so whether a column is null is hashed too.
    return F.coalesce(F.sum(F.xxhash64(*cols, *[c.isNull() for c in cols]).cast("decimal(38,0)")), F.lit(0)).cast("string")


class Manifest:
    """What was committed: by stage its key and, by part ("" of a table without years), files, bytes, rows, a sum of the rows' hashes, and a hash of what it was made from.

    Each version is a file of its own, written under another name and renamed to the next number, so a crash leaves the version before. Reading takes the
    highest that is whole. Only names and sizes of part folders are listed, never files one by one.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.folder, self.path_of, self.text_of = folder, jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils.toString
        self.at = self.path_of(f"{folder}/manifest")
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.stages: dict[str, dict] = {}
        self.version = 0
        for n in sorted(self.versions(), reverse=True):
            self.version = max(self.version, n)
            if (found := self.read(n)) is not None:
                self.stages = found
                break

    def versions(self) -> list[int]:
        if not self.fs.exists(self.at):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.at)]
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]

    def read(self, n: int) -> dict | None:
        stream = self.fs.open(self.path_of(f"{self.folder}/manifest/{n:08d}.json"))
        try:
            return json.loads(self.text_of(stream, "UTF-8"))
        except ValueError:  # half written on a file system whose rename isn't atomic
            return None
        finally:
            stream.close()

    def save(self) -> None:
        new = self.path_of(f"{self.folder}/manifest/{self.version + 1:08d}.json")
        part = self.path_of(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(json.dumps(self.stages).encode())
        stream.close()
        if not self.fs.rename(part, new):
            raise OSError(f"can't rename {part} to {new}")
        self.version += 1
        for n in self.versions():
            if n <= self.version - self.KEPT:
                self.fs.delete(self.path_of(f"{self.folder}/manifest/{n:08d}.json"), False)

    def size(self, stage: str, part: str) -> list[int]:
        """Files and bytes that are there of a part; none of one without rows."""
        at = self.path_of(f"{self.folder}/{stage}/{part}" if part else f"{self.folder}/{stage}")
        if not self.fs.exists(at):
            return [0, 0]
        got = self.fs.getContentSummary(at)
        return [got.getFileCount(), got.getLength()]

    def commit(self, stage: str, key: str, found: dict[str, tuple[int, str, str]]) -> None:
        """Marks parts as written: rows, content, and what they were made from."""
        state = self.stages.setdefault(stage, {"key": key, "parts": {}})
        for part, (rows, content, made_from) in found.items():
            state["parts"][part] = {"size": self.size(stage, part), "rows": rows, "content": content, "from": made_from}
        self.save()

    def parts(self, stage: str) -> dict[str, dict]:
        return self.stages.get(stage, {"parts": {}})["parts"]

    def sound(self, stage: str) -> set[str]:
        """The parts that are there as they were committed."""
        return {p for p, x in self.parts(stage).items() if self.size(stage, p) == x["size"]}

    def contents(self, stage: str, years: Iterable[int] | None = None) -> list:
        """Contents of a stage's parts, or of those of some years."""
        return sorted((p, x["content"]) for p, x in self.parts(stage).items() if years is None or int(p.partition("=")[2]) in years)

    def lose(self, stage: str, parts: Iterable[str]) -> None:
        for p in parts:
            self.parts(stage).pop(p, None)

    def begun(self, stage: str, key: str) -> bool:
        return self.stages.get(stage, {}).get("key") == key

    def forget(self, stage: str) -> None:
        """Removes a stage: from the manifest first, so that no crash leaves a mark without its table."""
        if self.stages.pop(stage, None):
            self.save()
        self.fs.delete(self.path_of(f"{self.folder}/{stage}"), True)

    def only(self, stage: str, parts: Iterable[str]) -> None:
        """Removes folders of a stage that are none of these parts: what a crash left between writing and marking."""
        at, known = self.path_of(f"{self.folder}/{stage}"), set(parts)
        for f in self.fs.listStatus(at) if self.fs.exists(at) else []:
            name = f.getPath().getName()
            if f.isDirectory() and name not in known:
                self.fs.delete(f.getPath(), True)

    def clear(self) -> None:
        for stage in list(self.stages):
            self.forget(stage)


#: Contents that a part of a stage was made from: a function of the manifest and the part's year.
Needs = Callable[[Manifest, int], list]


class Stages:
    """Makes stages in order, each part (a year, or a whole table) at most once.

    A part is made anew if the settings of its stage or of one before changed, if it is lost, damaged or half written, or if the contents of what
    it is made from changed. So an interrupted run goes on where it was, and a year that is added to the input, which its list of files, sizes and times shows, makes
    only such years anew as depend on it; the vocabulary is of all years, and as long as its terms are the same so are the vectors of the years before.
    """

    def __init__(self, spark: SparkSession, s: Settings):
        self.spark, self.s, self.manifest = spark, s, Manifest(spark, s.artifacts_dir)

    def path(self, name: str) -> str:
        return f"{self.s.artifacts_dir}/{name}"

    def read(self, name: str) -> DataFrame:
        at = self.manifest.path_of(self.path(name))
        if not self.manifest.fs.exists(at):  # no year of it has rows
            self.manifest.fs.mkdirs(at)
        return self.spark.read.schema(schema_of(name, self.s)).parquet(self.path(name))

    def summed(self, name: str, df: DataFrame, by: str | None) -> dict[str, tuple[int, str]]:
        """Rows and content of each part of a table."""
        sums = [F.count("*").alias("n"), content_of(name, schema_of(name, self.s)).alias("c")]
        if by is None:
            r = df.agg(*sums).first()
            return {"": (r.n, r.c)}
        return {f"{by}={r[by]}": (r.n, r.c) for r in df.groupBy(by).agg(*sums).collect()}  # a row a year

    def write(self, name: str, df: DataFrame, by: str | None, key: str, made_from: dict[str, str] | None) -> None:
        """Writes a table, or the years of `made_from`, adds up what is there, and commits that."""
        df = self.shaped(name, df)
        years = None if by is None or made_from is None else [int(p.partition("=")[2]) for p in made_from]
        artifacts.write_table(df if years is None else df.filter(F.col(by).isin(years)), self.path(name), by)
        there = self.read(name)
        found = self.summed(name, there if years is None else there.filter(F.col(by).isin(years)), by)
        self.manifest.commit(name, key, {p: (*found.get(p, (0, "0")), (made_from or {}).get(p, "")) for p in (made_from if made_from is not None else found)})
        log.info("stage %s: %d rows", name, sum(n for n, _ in found.values()))

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema_of(name, self.s)])

    def begin(self, name: str, of: str | None) -> str:
        """The stage's key; a stage that was made under another is removed."""
        key = self.s.stage_key(of or name)
        if not self.manifest.begun(name, key):
            self.manifest.forget(name)
        return key

    def source(self, name: str, make: Callable[[], DataFrame], state: str | None, by: str = "yr") -> DataFrame:
        """The table of the first stage, which finds the years. state: a text that changes with the input; None if the input is not there.

        When it changed, all is read, and only years whose contents did are written.
        """
        key, manifest = self.begin(name, None), self.manifest
        if name not in manifest.stages:
            self.write(name, make(), by, key, None)
        else:
            todo = set(manifest.parts(name)) - manifest.sound(name)
            if state is not None and manifest.stages[name].get("input") != state:
                now, before = self.summed(name, self.shaped(name, make()), by), manifest.parts(name)
                gone = set(before) - set(now)
                todo = {p for p in todo - gone} | {p for p, x in now.items() if p not in before or [before[p]["rows"], before[p]["content"]] != [*x]}
                manifest.lose(name, gone)
            if todo:
                log.info("stage %s: %s", name, sorted(todo))
                self.drop(name, todo)
                self.write(name, make(), by, key, dict.fromkeys(sorted(todo), ""))
        if state is not None and manifest.stages[name].get("input") != state:
            manifest.stages[name]["input"] = state
            manifest.save()
        manifest.only(name, manifest.parts(name))
        return self.read(name)

    def stage(self, name: str, make: Callable[[], DataFrame], needs: Needs, by: str | None = None, of: str | None = None, years: list[int] | None = None) -> DataFrame:
        """The table of a stage, whole or, with by and years, year by year."""
        key, manifest = self.begin(name, of), self.manifest
        wanted = {f"{by}={y}" if by else "": self.hashed(needs(manifest, y)) for y in (years if by else [0])}
        sound, known = manifest.sound(name), manifest.parts(name)
        todo = [p for p, h in wanted.items() if p not in sound or known[p]["from"] != h]
        if todo and not by:
            self.write(name, make(), None, key, wanted)
        elif todo:
            df = make()
            self.drop(name, todo)
            for i in range(0, len(todo), self.s.years_per_write):
                some = todo[i : i + self.s.years_per_write]
                log.info("stage %s: %s", name, some)
                self.write(name, df, by, key, {p: wanted[p] for p in some})
        if by:
            manifest.lose(name, set(manifest.parts(name)) - set(wanted))
            manifest.only(name, wanted)
        return self.read(name)

    @staticmethod
    def hashed(needs: list) -> str:
        return hashlib.sha256(json.dumps(needs).encode()).hexdigest()[:16]

    def drop(self, name: str, parts: Iterable[str]) -> None:
        """Removes folders of years that are made again, as a year that has no rows now would keep its old ones."""
        for p in parts:
            self.manifest.fs.delete(self.manifest.path_of(f"{self.path(name)}/{p}"), True)
