"""Atomic exports: tab-separated files with a typed header, in ordered parts that appear all at once.

    spark.dataSource.register(Atomic)
    df.write.format("atomic").mode("overwrite").save("/exports/ml/ml.inter")

The target is a folder. ``part-00000`` holds the header (``user_id:token``, ``timestamp:float``, ``item_id_list:token_seq``), the other parts the rows of the
partitions in their order, so that the parts one after another are the file that trainers expect. Tasks write below a staging
folder beside the target, each under a name of its own; the commit numbers the parts of the tasks that finished and renames the
folder. A failed or repeated task leaves nothing in the target, and readers see the earlier export or the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

from larkspur.functions import text as T


def header_type(kind: DataType) -> str:
    if isinstance(kind, ArrayType):
        return f"{header_type(kind.elementType)}_seq"
    return "float" if isinstance(kind, NumericType) else "token"


def cell(value: object) -> str:
    """Text of a value: arrays by spaces, no tabs or line breaks; null is empty."""
    if value is None:
        return ""
    if isinstance(value, list | tuple):
        return " ".join(cell(v) for v in value)
    return str(value).replace("\t", " ").replace("\n", " ").replace("\r", " ")


@dataclass
class Done(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class Atomic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atomic"

    def writer(self, schema: StructType, overwrite: bool) -> AtomicWriter:
        return AtomicWriter(self.options["path"], schema, overwrite)


class AtomicWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        folder, _, name = self.path.rpartition("/")
        self.staging = f"{folder}/_staging-{name}-{uuid.uuid4().hex}"

    def _store(self, path: str) -> tuple[object, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)

    def write(self, iterator: Iterator[Row]) -> Done:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = self._store(self.staging)
        store.create_dir(base, recursive=True)
        name = f"task-{context.partitionId():05d}-{context.taskAttemptId()}"
        rows = 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for row in iterator:
                out.write(("\t".join(cell(v) for v in row) + "\n").encode())
                rows += 1
        return Done(context.partitionId(), name, rows)

    def commit(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        store, base = self._store(self.staging)
        _, target = self._store(self.path)
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        ready = f"{base}/ready"
        store.create_dir(ready, recursive=True)
        with store.open_output_stream(f"{ready}/part-00000") as out:
            out.write(("\t".join(f"{f.name}:{header_type(f.dataType)}" for f in self.schema) + "\n").encode())
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for n, message in enumerate(done, 1):
            store.move(f"{base}/{message.name}", f"{ready}/part-{n:05d}")
        with store.open_output_stream(f"{ready}/_rows.json") as out:
            out.write(json.dumps({"rows": sum(m.rows for m in done), "parts": len(done)}).encode())
        if there:
            store.move(target, f"{base}/before")
        store.move(ready, target)
        store.delete_dir(base)

    def abort(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        store, base = self._store(self.staging)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


def target_index(columns: list[str]) -> Column:
    """Place of an example's target in its user's timeline: metadata.target_index (a map), target_index, the number after the last colon of example_id, else the history's length."""
    found = []
    if "metadata" in columns:
        found.append(F.col("metadata")["target_index"].try_cast("int"))
    if "target_index" in columns:
        found.append(F.col("target_index").cast("string").try_cast("int"))
    last = F.substring_index("example_id", ":", -1).try_cast("int")
    length = F.when(F.size("history") > 0, F.size("history"))
    return F.coalesce(*found, F.when(F.contains(F.coalesce("example_id", F.lit("")), F.lit(":")), last).otherwise(length))


def interaction_rows(examples: DataFrame, timeline: DataFrame) -> DataFrame:
    """(split, user_id, item_id, timestamp, place) of the benchmark: what a user did up to the target of their longest train example, and the targets of the others.

    ``examples``: example_id, user_id, split, history, target. ``timeline``: user_id, item_id, idx (from 0), ts. Where the timeline doesn't have the
    target at its place, train rows are the history and target with their places as times, and held-out times the history's length.
    Without valid rows test rows stand in for them, and the other way round.
    """
    rows = examples.where("user_id is not null and user_id != ''").select(
        "example_id", "user_id", T.normalize_split(F.col("split")).alias("split"), F.coalesce("history", F.array().cast("array<string>")).alias("history"), "target", target_index(examples.columns).alias("at")
    )
    longest = rows.where("split = 'train'").groupBy("user_id").agg(F.max_by(F.struct("example_id", "history", "target", "at"), F.struct(F.size("history"), "example_id")).alias("x")).select("user_id", "x.*")
    wanted = longest.withColumn("split", F.lit("train")).unionByName(rows.where("split in ('valid', 'test')").select("user_id", "example_id", "history", "target", "at", "split"))
    spots = timeline.select("user_id", F.col("idx").alias("at"), F.col("item_id").alias("there"), "ts")
    placed = wanted.join(spots, ["user_id", "at"], "left").withColumn("known", F.coalesce(F.col("there") == F.coalesce("target", F.col("there")), F.lit(False)))
    train = placed.where("split = 'train'")
    past = timeline.join(train.where("known").select("user_id", "at"), "user_id").where("idx <= at").select("user_id", "item_id", F.col("ts").alias("timestamp"), F.col("idx").alias("place"))
    told = F.filter(F.concat("history", F.array("target")), lambda x: F.coalesce(x != "", F.lit(False)))
    guessed = train.where("not known").select("user_id", F.posexplode(told).alias("place", "item_id")).select("user_id", "item_id", F.col("place").cast("double").alias("timestamp"), "place")
    held = placed.where("split != 'train' and target is not null and target != ''").select(
        "split", "user_id", F.col("target").alias("item_id"), F.when(F.col("known"), F.col("ts")).otherwise(F.size("history").cast("double")).alias("timestamp"), F.size("history").alias("place")
    )
    out = past.unionByName(guessed).withColumn("split", F.lit("train")).select("split", "user_id", "item_id", "timestamp", "place").unionByName(held)
    have = held.agg(F.count_if(F.col("split") == "valid").alias("v"), F.count_if(F.col("split") == "test").alias("t"))  # one row
    spare = held.join(F.broadcast(have), F.lit(True)).where((F.col("v") == 0) | (F.col("t") == 0))
    return out.unionByName(spare.withColumn("split", F.when(F.col("split") == "test", "valid").otherwise("test")).select(out.columns))


def sequence_rows(examples: DataFrame, timeline: DataFrame, most: int = 50) -> DataFrame:
    """(split, user_id, item_id, item_id_list, timestamp): the last ``most`` items before every target; examples without history or target go."""
    rows = examples.select("user_id", T.normalize_split(F.col("split")).alias("split"), F.filter("history", lambda x: x != "").alias("history"), "target", target_index(examples.columns).alias("at"))
    rows = rows.where("user_id != '' and target != '' and size(history) > 0 and split in ('train', 'valid', 'test')")
    recent = F.slice("history", F.greatest(F.size("history") - most, F.lit(0)) + 1, most)
    # a timeline is one row and meets its examples by user alone: these lie by user already, so histories aren't moved again
    lines = timeline.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("item_id").alias("there"), "ts"))).alias("line"))
    placed = rows.withColumn("history", recent).join(lines, "user_id", "left")
    there = F.get("line", F.col("at"))
    there = F.when(there["idx"] == F.col("at"), there).otherwise(F.get(F.filter("line", lambda x: x["idx"] == F.col("at")), F.lit(0)))
    placed = placed.select("split", "user_id", "target", "history", there.alias("x"))
    ts = F.coalesce(F.when(F.col("x.there") == F.col("target"), F.col("x.ts")), F.size("history").cast("double"))
    return placed.select("split", "user_id", F.col("target").alias("item_id"), F.col("history").alias("item_id_list"), ts.alias("timestamp"))


def export(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write ``df`` to ``path`` as one atomic export, its rows in ``order`` (a total order by ranges, no single task)."""
    df.sparkSession.dataSource.register(Atomic)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.format("atomic").mode("overwrite").save(path)


def export_dataset(folder: str, name: str, examples: DataFrame, timeline: DataFrame, items: DataFrame, most: int = 50) -> None:
    """``.inter`` (whole and by split), sequence ``.inter``, ``.item`` and ``.user`` exports of a dataset below ``folder``."""
    base = f"{folder.rstrip('/')}/{name}/{name}"
    split_order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    inter = interaction_rows(examples, timeline).withColumn("s", split_order)
    keys = ["user_id", "item_id", "timestamp"]
    ordered = lambda df, by: df.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys)
    export(ordered(inter, ["s", "user_id", "place", "item_id"]), f"{base}.inter")
    seqs = sequence_rows(examples, timeline, most)
    for split in ("train", "valid", "test"):
        export(ordered(inter.where(F.col("split") == split), ["user_id", "place", "item_id"]), f"{base}.{split}.inter")
        export(seqs.where(F.col("split") == split).select("user_id", "item_id", "item_id_list", "timestamp"), f"{base}.sasrec_{split}.inter", ["user_id", "timestamp", "item_id"])
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    fields = items.select("item_id", words(F.col("title")).alias("title"), words(F.col("category")).alias("category"))
    export(fields, f"{base}.item", ["item_id"])
    export(examples.where("user_id != ''").select("user_id").distinct(), f"{base}.user", ["user_id"])
