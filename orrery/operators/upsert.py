"""Keyed changes: the latest version, classes of change, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, keys: list[str], version: str, seq: str | None = None) -> DataFrame:
    """The newest version of each key; with seq, at the key's first place. Versions combine before the
    shuffle."""
    rest = [c for c in versions.columns if c not in keys]
    best = F.max_by(F.struct(*rest), version).alias("_v")
    more = [F.min(seq).alias("_seq")] if seq else []
    out = versions.groupBy(*keys).agg(best, *more)
    return out.select(*keys, *(F.col("_seq").alias(c) if c == seq else F.col(f"_v.{c}").alias(c) for c in rest))


def classify(incoming: DataFrame, existing: DataFrame, last_batch: DataFrame | None = None, key: str = "iid") -> DataFrame:
    """incoming (key, raw, intro, visible, …) with status:

    New (not seen before, visible or not), IntroChanged, IntroUnchanged, Skipped (visible, seen, and
    byte for byte as in the last batch), Hidden (seen, now invisible: the old row stays and is marked).
    """
    old = existing.select(F.col(key).alias("_key"), F.col("intro").alias("_intro"))
    out = incoming.join(old, F.col(key) == F.col("_key"), "left")
    same = F.lit(False)
    if last_batch is not None:
        out = out.join(last_batch.select(F.col(key).alias("_last"), F.col("raw").alias("_raw")), F.col(key) == F.col("_last"), "left")
        same = F.coalesce(F.col("raw") == F.col("_raw"), F.lit(False))
    status = (
        F.when(F.col("_key").isNull(), "New").when(~F.col("visible"), "Hidden").when(same, "Skipped")
        .when(F.col("intro") == F.col("_intro"), "IntroUnchanged").otherwise("IntroChanged")
    )
    return out.withColumn("status", status).select(*incoming.columns, "status")


def new_sequence(new: DataFrame, base: int, pos: str = "pos", run: int = 100_000) -> DataFrame:
    """New rows come newest first and are appended newest last: seq from base + 1 up, by falling pos.
    Positions are counted inside runs of them and over the runs' sizes."""
    part = new.withColumn("_run", F.floor(F.col(pos) / run))
    sizes = part.groupBy("_run").agg(F.count("*").alias("_n"))
    later = Window.orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    sizes = sizes.select("_run", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_run").orderBy(F.desc(pos)))
    return part.withColumn("_rank", rank).join(sizes, "_run").withColumn("seq", (F.lit(base) + F.col("_before") + F.col("_rank")).cast("long")).drop("_run", "_rank", "_before")


def upsert(existing: DataFrame, changes: DataFrame, key: str = "iid", seq: str = "seq") -> DataFrame:
    """The table after the changes (key, seq for new keys, other columns): a changed key keeps its seq."""
    kept = existing.join(changes.select(key), key, "left_anti")
    held = existing.select(F.col(key), F.col(seq).alias("_old"))
    put = changes.join(held, key, "left").withColumn(seq, F.coalesce("_old", seq)).drop("_old")
    return kept.unionByName(put.select(*existing.columns))


def change_report(classified: DataFrame, pos: str = "pos", key: str = "iid") -> DataFrame:
    """For each status how many there are, and the ids, in order, of the bounded batch."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(pos, key))), lambda p: p[key])
    return classified.groupBy("status").agg(F.count("*").alias("n"), ids.alias("ids"))


def json_diff(old: DataFrame, new: DataFrame, key: str = "iid") -> DataFrame:
    """Line differences of each changed record, its JSON being sorted by key and indented."""
    both = old.select(key, F.col("raw").alias("_a")).join(new.select(key, F.col("raw").alias("_b")), key).filter("_a <> _b")

    def run(batches):
        import difflib
        import json

        pretty = lambda s: json.dumps(json.loads(s), sort_keys=True, indent=2, ensure_ascii=False).splitlines()
        for b in batches:
            lines = [[x for x in difflib.ndiff(pretty(a), pretty(c)) if x[0] in "+-"] for a, c in zip(b["_a"], b["_b"], strict=True)]
            yield b[[key]].assign(diff=lines)

    return both.mapInPandas(run, f"{key} long, diff array<string>").filter(F.size("diff") > 0)
