"""Incremental synchronisation of the collection with its feeds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intro, model, search, upsert, users
from ..sources import state, store


def until_nothing_new(feed: DataFrame, known: DataFrame) -> DataFrame:
    """Replay of paged feeds (stage, page, pos, iid, …): each feed's pages up to and with the first
    that has no new id. An id is new at its first sight in its feed."""
    first = Window.partitionBy("stage", "iid").orderBy("page", "pos")
    fresh = feed.join(known.select("iid").withColumn("_known", F.lit(True)), "iid", "left").withColumn("_new", F.col("_known").isNull() & (F.row_number().over(first) == 1))
    pages = fresh.groupBy("stage", "page").agg(F.count_if("_new").alias("_n"))
    stop = pages.filter("_n = 0").groupBy("stage").agg(F.min("page").alias("_stop"))
    return fresh.join(stop, "stage", "left").filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_known", "_new", "_stop")


def with_intros(bronze: DataFrame) -> DataFrame:
    """Bronze -> records with primary names and intros."""
    parsed = model.parse_records(bronze)
    return intro.with_intro(users.with_primary(parsed, users.primary_names(parsed)))


#: What is stored of a record: its text as it came, whose it is, and the text that search runs over.
STORED = "seq long, iid long, raw string, user_id long, intro string"
_COLUMNS = [c.split()[0] for c in STORED.split(", ")]


class Collection:
    """A table under a path, kept up to date batch by batch. One writer at a time; readers see whole
    batches only.

    Search text is made when a record is put in, and made again only for records of the users that a batch
    touches, as their primary names may change. A batch is added as a delta, in proportion to itself;
    deltas are merged into the base once they have grown to a sixteenth of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame:
        """STORED, of each record the newest form. A search term on intro reaches the files."""
        base, deltas = store.current(self.spark, self.path)
        if base is None:
            return self.spark.createDataFrame([], STORED)
        table = self.spark.read.schema(STORED).parquet(base)
        if not deltas:
            return table
        newer = self._newer(deltas)
        return table.join(newer.select("iid"), "iid", "left_anti").select(*_COLUMNS).unionByName(newer)

    def _newer(self, deltas: list[tuple[int, str]]) -> DataFrame:
        read = [self.spark.read.schema(STORED).parquet(at).withColumn("part", F.lit(n)) for n, at in deltas]
        return upsert.latest(reduce(DataFrame.unionByName, read), ["iid"], "part").select(*_COLUMNS)

    def bronze(self) -> DataFrame:
        return self.stored().select("seq", "iid", "raw")

    def table(self) -> DataFrame:
        return with_intros(self.bronze())

    def select(self, filters=(), bans=(), **more) -> DataFrame:
        """Search over the stored text."""
        return search.select(self.stored(), filters, bans, **more)

    def apply(self, feed: DataFrame, last_batch: DataFrame | None = None) -> DataFrame:
        """Put one batch (stage, page, pos, raw) in: private (stage 0) before public (stage 1), both or
        neither. The classified batch comes back: iid, status, stage, page, pos, raw. last_batch (iid,
        raw) is the batch before, if it isn't the one that was applied last.

        Of several sights of an id in the batch the first one counts, as the feed is newest first.
        """
        old = self.stored()
        if last_batch is None:
            last_batch = store.read(self.spark, f"{self.path}.last", "iid long, raw string")
        order = F.struct("stage", "page", "pos")
        batch = feed.withColumn("iid", F.get_json_object("raw", "$.id").cast("long")).groupBy("iid").agg(F.min_by(F.struct("stage", "page", "pos", "raw"), order).alias("x")).select("iid", "x.*")
        # the filter makes the checks of pages run: without a use of them they would be pruned away
        parsed = model.parse_records(batch.withColumn("seq", F.lit(0).cast("long"))).filter(F.size("pages") > 0).select("iid", "visible", "user_id")
        rows = batch.join(parsed, "iid").persist()
        # names are looked at again where the batch has a record of the user, or had one of another user's
        touched = rows.select("user_id").unionByName(old.join(rows.select("iid"), "iid", "left_semi").select("user_id")).distinct()
        theirs = old.join(touched, "user_id", "left_semi").select("seq", "iid", "raw").persist()
        # intros as they will be: names count old records and the batch's new ones
        place = F.col("stage").cast("long") * (1 << 40) + F.col("page").cast("long") * (1 << 20) + F.col("pos")
        both = theirs.join(batch.select("iid"), "iid", "left_anti").unionByName(rows.select((F.lit(1 << 60) - place).cast("long").alias("seq"), "iid", "raw"))
        intros = with_intros(both).select("iid", "intro")
        status = upsert.classify(rows.join(intros, "iid"), old.select("iid", "intro"), last_batch).persist()
        put = status.filter(~F.col("status").isin("Hidden", "Skipped"))
        base = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        new = upsert.new_sequence(put.filter(F.col("status") == "New").withColumn("place", place), base, "place")
        changes = new.select("seq", "iid", "raw").unionByName(put.filter(F.col("status") != "New").select(F.lit(0).cast("long").alias("seq"), "iid", "raw"))
        final = upsert.upsert(theirs, changes).persist()
        made = final.join(with_intros(final).select("iid", "user_id", "intro"), "iid").select(*_COLUMNS)
        was = old.select("iid", F.struct("raw", "intro").alias("was"))
        delta = made.join(was, "iid", "left").filter(~F.col("was").eqNullSafe(F.struct("raw", "intro"))).select(*_COLUMNS)
        status.select("iid", "status", "stage", "page", "pos", "raw").write.mode("overwrite").parquet(self.path + ".report")
        store.put(delta, self.path, "base" if store.current(self.spark, self.path)[0] is None else "delta")
        store.put(batch.select("iid", "raw"), f"{self.path}.last")
        for held in (final, status, theirs, rows):
            held.unpersist()
        self.compact()
        return self.spark.read.parquet(self.path + ".report")

    def compact(self, ratio: int = 16) -> bool:
        """Merge the deltas into the base if they have grown enough."""
        base, deltas = store.current(self.spark, self.path)
        if not deltas:
            return False
        rows = lambda at: self.spark.read.schema(STORED).parquet(at).count()
        sizes = [rows(at) for _, at in deltas]
        if needs_compaction(rows(base), sum(sizes[:-1]), sizes[-1], ratio):
            store.put(self.stored(), self.path)
            return True
        return False

    def follow(self, stream: DataFrame, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None):
        """Apply every micro-batch of a feed stream; done gets each classified batch (the hook). What a
        batch repeats byte for byte from the one before is skipped."""

        def batch(df: DataFrame, epoch: int) -> None:
            report = Collection(df.sparkSession, self.path).apply(df)
            if done:
                done(report, epoch)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def update_then_download(self, feed: DataFrame, download: Callable[[DataFrame], None]) -> DataFrame:
        """Apply a batch, then have its new and changed records downloaded. The list (pos, iid) is kept
        until download has returned, and recover() takes it up again after a crash."""
        report = self.apply(feed)
        mine = hooked(report).select("pos", "iid")
        held = state.load(self.spark, self.path + ".state", "pending")
        after = held.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("after"))
        mine = mine.join(held.select("iid"), "iid", "left_anti").crossJoin(F.broadcast(after)).select((F.col("pos") + F.col("after")).alias("pos"), "iid")
        state.save(held.unionByName(mine), self.path + ".state", "pending")
        self.recover(download)
        return report

    def recover(self, download: Callable[[DataFrame], None]) -> None:
        """Download what is pending, in order."""
        pending = state.load(self.spark, self.path + ".state", "pending")
        if not pending.isEmpty():
            download(pending.orderBy("pos"))
            state.save(pending.limit(0), self.path + ".state", "pending")


def hooked(report: DataFrame) -> DataFrame:
    """(pos, iid, raw): the new and changed records of a classified batch as they came, numbered in the
    order of the feed."""
    put = report.filter(~F.col("status").isin("Hidden", "Skipped"))
    place = (F.col("stage").cast("long") * (1 << 40) + F.col("page").cast("long") * (1 << 20) + F.col("pos")).cast("long")
    return put.select(place.alias("pos"), "iid", "raw").orderBy("pos")


def needs_compaction(major: int, minor: int, new: int, ratio: int = 16) -> bool:
    """Whether the delta has grown enough to be merged into the base."""
    return (minor + new) * ratio > major
