"""Sinks: result payloads, ledger, verified findings, snapshots, registered sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import numbered, running
from ..functions.text import file_name, file_stem
from ..session import cut_lineage
from .publish import publish


def write_payload(df: DataFrame, folder: str, run_id: str, name: str, fmt: str = "json") -> str:
    """One result table of one run below ``folder/name/run_id=...``; a rerun replaces only its own rows."""
    target = f"{folder}/{name}/run_id={run_id}"
    df.write.mode("overwrite").format(fmt).save(target)
    return target


def ledger_entries(events: DataFrame) -> DataFrame:
    """(event_id, event_type, ts) -> ledger rows."""
    return events.select(
        F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("kind"),
        F.concat_ws("/", F.lit("state/runs"), "event_type", F.concat(F.col("event_id").cast("string"), F.lit(".json"))).alias("artifact"),
        F.date_trunc("second", "ts").alias("created_at"),
    )


def append_ledger(entries: DataFrame, folder: str) -> None:
    entries.select("run_id", "kind", "artifact", "created_at").write.mode("append").parquet(folder)


def write_verified_findings(findings: DataFrame, folder: str) -> None:
    findings.write.mode("overwrite").partitionBy("batch_id").json(folder)


def write_latest_snapshot(snapshot: DataFrame, folder: str) -> None:
    """Replaces the latest snapshot in a plain folder.  The rows are written aside first, because they may be read from it."""
    cut_lineage(snapshot).write.mode("overwrite").parquet(folder)


def publish_findings(findings: DataFrame, folder: str) -> int:
    """Publishes the verified findings, a partition per batch; readers see all of them or those before."""
    return publish(findings, folder, ["batch_id"])


def publish_snapshot(snapshot: DataFrame, folder: str) -> int:
    """Replaces the latest snapshot in one step for readers of :func:`publish.published`; its rows may be read from the one before."""
    return publish(snapshot, folder)


def register_sources(incoming: DataFrame, existing: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, arrival, name, in_raw) -> the same rows with ``raw_path`` and ``copied``.

    Only enabled, writable roots take sources; rows without a name are left out.  A source that already lies in the raw
    folder stays; another one gets the i-th free name ``stem``, ``stem-2``, ``stem-3`` ... below ``raw/imports``.  With e_1 < e_2 ...
    the taken numbers, the i-th free one is i + #{j : e_j - j < i}: a running count, not a search.
    """
    writable = roots.where("enabled and mode = 'read_write'").select("root_id")
    taken = existing.select("root_id", "path")
    pending = incoming.where("name is not null").join(writable, "root_id", "left_semi")
    kept = pending.where("in_raw").select("*", F.concat(F.lit("raw/"), F.col("name")).alias("raw_path"), F.lit(False).alias("copied"))
    done = [kept]
    pending = pending.where("not in_raw")
    while True:
        named = cut_lineage(_free_names(pending, taken))
        first = W.partitionBy("root_id", "raw_path").orderBy("arrival")
        ranked = named.withColumn("rn", F.row_number().over(first))
        placed = ranked.where("rn = 1").drop("rn")
        done.append(placed)
        clash = ranked.where("rn > 1").drop("rn", "raw_path", "copied")
        if clash.isEmpty():
            break
        # A new name met a source of exactly that name; the later one looks again.
        taken = cut_lineage(taken.unionByName(placed.select("root_id", F.col("raw_path").alias("path"))))
        pending = cut_lineage(clash)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part.select(*result.columns))
    return result


def _free_names(pending: DataFrame, taken: DataFrame) -> DataFrame:
    """Numbers and running counts come from range partitions, so one name of a third of all sources is many tasks."""
    base = file_name(F.col("name"))
    stem = file_stem(F.col("name"))
    rows = pending.withColumn("stem", stem).withColumn("suffix", F.substring(base, F.char_length(stem) + 1, F.char_length(base)))
    key = ["root_id", "stem", "suffix"]
    names = taken.where(F.col("path").rlike("^raw/imports/[^/]+$")).select("root_id", file_name(F.col("path")).alias("n"))
    t_stem = file_stem(F.col("n"))
    t = names.withColumn("s", t_stem).withColumn("suffix", F.substring("n", F.char_length(t_stem) + 1, F.char_length("n")))
    count = F.regexp_extract("s", r"-([1-9][0-9]*)$", 1).try_cast("long")
    used = t.select("root_id", F.col("s").alias("stem"), "suffix", F.lit(1).cast("long").alias("e")).unionByName(
        t.where(count >= 2).select("root_id", F.regexp_replace("s", r"-[0-9]+$", "").alias("stem"), "suffix", count.alias("e"))
    ).distinct().join(rows.select(*key).distinct(), key, "left_semi")
    gaps = numbered(used, key, "e", "j").select(*key, (F.col("e") - F.col("j")).alias("v"), F.lit(1).alias("kind"))
    wanted = numbered(rows, key, "arrival", "i").select("*", F.col("i").alias("v"), F.lit(0).alias("kind"))
    placed = running(wanted.unionByName(gaps, allowMissingColumns=True), key, ["v", "kind"], "kind", "before").where("kind = 0")
    number = F.col("i") + F.col("before")
    free = F.concat("stem", F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit("")), F.col("suffix"))
    return placed.select(*pending.columns, F.concat(F.lit("raw/imports/"), free).alias("raw_path"), F.lit(True).alias("copied"))
