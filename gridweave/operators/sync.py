"""Upsert and sync operators.

None of them needs a MERGE target: each returns the new table, to be written to a
new path. Target rows meet the (unique) update keys in left joins, which Spark's
skew handling can split; the batch is cut to one row per key by an aggregate that
combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .headers import evolve_schema, quoted
from .ordering import number_rows


def has_key(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & quoted(k).isNotNull() & (quoted(k).cast("string") != "")
    return out


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, without sorting any group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[quoted(c) for c in rest]), F.struct(*[quoted(o) for o in order])).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[quoted(c) for c in rest]), F.struct(*[quoted(o) for o in order])).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: list[str],
    batch_order: str,
    target_order: str | None = None,
) -> DataFrame:
    """Change the cells named in ``updates`` of matching rows, append the others.

    * columns the update lacks keep their cells; columns the target lacks are added;
    * update rows without a key are skipped, the last one of a key wins;
    * with ``target_order`` only the last target row of a repeated key is matched.

    The column ``_action`` says ``inserted``, ``updated``, ``unchanged`` (matched,
    no cell differs) or ``kept`` (not matched).
    """
    fresh = last_per_key(updates.where(has_key(keys)), keys, [batch_order]).drop(batch_order)
    wide, fresh_wide = evolve_schema(target, fresh)
    given = [c for c in fresh.columns if c not in keys]
    keyed = wide.where(has_key(keys))
    unkeyed = wide.where(~F.coalesce(has_key(keys), F.lit(False)))

    if target_order is not None:
        last = keyed.groupBy(*keys).agg(F.max(quoted(target_order)).alias("_last"), F.count("*").alias("_n"))
        last = last.where("_n > 1").drop("_n")
        keyed = keyed.join(last, keys, "left").withColumn(
            "_match", F.col("_last").isNull() | (F.col("_last") == quoted(target_order))
        ).drop("_last")
    else:
        keyed = keyed.withColumn("_match", F.lit(True))

    side = fresh_wide.select(*keys, F.struct(*[quoted(c) for c in given]).alias("_new"))
    joined = keyed.join(side, keys, "left")
    hit = F.col("_new").isNotNull() & F.col("_match")
    same = F.lit(True)
    for c in given:
        same = same & quoted(c).eqNullSafe(F.col("_new")[c])
    cells = [
        F.when(hit, F.col("_new")[c]).otherwise(quoted(c)).alias(c) if c in given else quoted(c) for c in wide.columns
    ]
    action = F.when(~hit, "kept").when(same, "unchanged").otherwise("updated").alias("_action")
    changed = joined.select(*cells, action)
    added = fresh_wide.join(wide.where(has_key(keys)).select(*keys).distinct(), keys, "left_anti")
    return changed.unionByName(added.withColumn("_action", F.lit("inserted"))).unionByName(
        unkeyed.withColumn("_action", F.lit("kept"))
    )


def action_counts(upserted: DataFrame) -> DataFrame:
    """Rows per action of an :func:`upsert` result."""
    return upserted.groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("rows"))


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: one per new key combination, nothing for known ones."""
    return rows.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")


def get_or_create_key(
    dim: DataFrame, names: DataFrame, name: str, key: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """Natural key (trimmed, lower case) to id.

    Unknown names get the ids after the highest one, in order of their first
    appearance. Returns the grown dimension and ``names`` with the id joined. Names
    of the dimension are cleaned for the comparison; of several that clean to one
    name, the smallest id counts.
    Only new distinct names are numbered, in ranges, so no task sees them all.
    """
    clean = F.lower(F.trim(quoted(name)))
    asked = names.withColumn("_name", clean)
    first_seen = asked.where(F.col("_name").isNotNull()).groupBy("_name").agg(F.min(order).alias("_first"))
    held = dim.select(clean.alias("_name"), quoted(key).alias("_key")).groupBy("_name").agg(F.min("_key").alias("_key"))
    new = first_seen.join(held, "_name", "left_anti")
    top = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    numbered = number_rows(new, ["_first", "_name"], row_no="_no")
    added = numbered.select(
        (F.col("_no") + top.scalar()).cast(dim.schema[key].dataType).alias(key), F.col("_name").alias(name)
    )
    grown = dim.select(key, name).unionByName(added)
    ids = held.unionByName(added.select(quoted(name).alias("_name"), quoted(key).alias("_key")))
    looked_up = asked.join(ids, "_name", "left").drop("_name").withColumnRenamed("_key", key)
    return grown, looked_up


def slot_upsert(target: DataFrame, rows: DataFrame, keys: list[str], slot: str, order: str, slots: int | None = None) -> DataFrame:
    """Set the value of (owner, slot), insert a new slot; only slots up to ``slots`` when that is given."""
    return upsert(target, rows if slots is None else rows.where(F.col(slot) <= slots), [*keys, slot], order)


def latest_text_upsert(target: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """One text row per owner, replaced when present."""
    return upsert(target, rows, [key], order)


def replace_window(
    target: DataFrame,
    fresh: DataFrame,
    owner: Column,
    now: Column,
    start: str,
    end: str,
    owner_col: str,
    id_col: str,
    back_days: int = 7,
    forward_days: int = 7,
) -> DataFrame:
    """Drop the owner's rows that start after now - back, then add the fresh ones.

    Deleting has no upper bound. Fresh rows are the owner's events that overlap
    the window, one per event id. Days that are not above 0 fall back to 7.
    """
    back = back_days if back_days and back_days > 0 else 7
    forward = forward_days if forward_days and forward_days > 0 else 7
    low = now - F.expr(f"INTERVAL {back} DAYS")
    high = now + F.expr(f"INTERVAL {forward} DAYS")
    gone = F.coalesce((F.col(owner_col) == owner) & (F.col(start) > low), F.lit(False))
    overlapping = fresh.where((F.col(owner_col) == owner) & (F.col(end) > low) & (F.col(start) < high))
    return target.where(~gone).unionByName(first_per_key(overlapping, [id_col], [start]).select(*target.columns))


def replace_windows(
    target: DataFrame, fresh: DataFrame, control: DataFrame, now: Column, start: str, end: str, owner_col: str, id_col: str,
    back: str = "back_days", forward: str = "forward_days",
) -> DataFrame:
    """:func:`replace_window` for all owners of a control table at once, each with days of its own.

    ``control`` has the owner and the days back and forward; null or not above 0 they are 7, and
    of several rows of an owner the widest count. Owners that it doesn't name keep
    their rows, those with a null owner too. Both joins are on the owner, from the side of the
    events, which Spark can split for a hot owner.
    """
    days = lambda c: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(7)).cast("int")
    windows = control.where(F.col(owner_col).isNotNull()).groupBy(F.col(owner_col).alias("_owner")).agg(
        (now - F.make_dt_interval(F.max(days(back)))).alias("_low"), (now + F.make_dt_interval(F.max(days(forward)))).alias("_high")
    )
    mine = F.col(owner_col) == F.col("_owner")
    kept = target.join(windows, mine, "left").where(~F.coalesce(F.col(start) > F.col("_low"), F.lit(False)))
    overlapping = fresh.join(windows, mine).where((F.col(end) > F.col("_low")) & (F.col(start) < F.col("_high")))
    return kept.select(*target.columns).unionByName(first_per_key(overlapping, [owner_col, id_col], [start]).select(*target.columns))


def touch_last_sync(control: DataFrame, owners: DataFrame, now: Column, owner: str, stamp: str, slot: str, slots: int | None = 5) -> DataFrame:
    """Stamp known owners; put new ones in the free slots, in owner order.

    A control table has ``slots`` rows at most, as the sheet has no more room; owners
    beyond them are in :func:`without_slot`. With None there is room for all.
    """
    spark = control.sparkSession
    named = owners.select(owner).distinct()
    known = control.join(named.withColumn("_hit", F.lit(True)), owner, "left").select(
        owner, F.when(F.col("_hit"), now).otherwise(F.col(stamp)).alias(stamp), slot
    )
    new = named.join(control, owner, "left_anti")
    room = control.count() + new.count() if slots is None else slots
    free = spark.range(room).select(F.col("id").cast(control.schema[slot].dataType).alias(slot)).join(control, slot, "left_anti")
    if slots is None:
        # Numbering wants a number first: a text's first seven bytes, in the order of texts.
        text = control.schema[owner].dataType.typeName() == "string"
        lead = F.conv(F.rpad(F.hex(F.substring(F.encode(owner, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
        new = new.select(owner, F.coalesce(lead, F.lit(-1)).alias("_lead") if text else F.col(owner).alias("_lead"))
        new = number_rows(new, ["_lead", owner], row_no="_n").drop("_lead")
        free = number_rows(free, [slot], row_no="_n")
    else:
        # Both sides of the join have ``slots`` rows at most, and no more candidates leave a task.
        one = Window.partitionBy(F.lit(1))
        free = free.withColumn("_n", F.row_number().over(one.orderBy(slot)))
        new = new.orderBy(owner).limit(slots).withColumn("_n", F.row_number().over(one.orderBy(owner)))
    return known.unionByName(free.join(new, "_n").select(owner, now.alias(stamp), slot))


def without_slot(owners: DataFrame, synced: DataFrame, owner: str) -> DataFrame:
    """Owners that found no room in ``synced``, the table of :func:`touch_last_sync`."""
    held = synced.select(F.col(owner).alias("_held"))
    return owners.select(owner).distinct().join(held, F.col(owner).eqNullSafe(F.col("_held")), "left_anti")


def ingest_new_messages(target: DataFrame, batch: DataFrame, key: str, touched: str, now: Column, order: str) -> DataFrame:
    """Append unknown messages once; a known message only gets a new touch time."""
    incoming = first_per_key(batch, [key], [order])
    seen = incoming.select(key).withColumn("_seen", F.lit(True))
    kept = target.join(seen, key, "left").withColumn(
        touched, F.when(F.col("_seen"), now).otherwise(F.col(touched))
    ).drop("_seen")
    new = incoming.drop(order).join(target.select(key), key, "left_anti").withColumn(touched, now)
    return kept.unionByName(new.select(*target.columns))


def move_matching(
    box: DataFrame,
    folder: str,
    limit: int | None,
    order: list[str],
    unseen_only: bool = False,
    before: Column | None = None,
    since: Column | None = None,
    dest: str | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Mark up to ``limit`` messages of a folder (None: all) as seen, and move them when ``dest`` is given."""
    wanted = F.col("folder") == folder
    if unseen_only:
        wanted = wanted & ~F.col("seen")
    if before is not None:
        wanted = wanted & (F.col("ts") < before)
    if since is not None:
        wanted = wanted & (F.col("ts") >= since)
    if limit is None:
        marked = box.withColumn("_hit", wanted)
    else:
        picked = box.where(wanted).orderBy(*order).limit(limit).select(id_col).withColumn("_hit", F.lit(True))
        marked = box.join(F.broadcast(picked), id_col, "left")  # at most ``limit`` rows
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    moved = F.when(hit, F.lit(dest)).otherwise(F.col("folder")) if dest else F.col("folder")
    out = marked.withColumn("moved", hit).withColumn("folder", moved).withColumn("seen", F.col("seen") | hit)
    return out.select(*box.columns, "moved")


# The four mailbox runs (folder, limit, unseen only, before/since days, destination).
MAILBOX_RUNS = {
    "complete_month_old": dict(folder="INBOX", limit=500, before_days=10, dest="Auto Complete"),
    "notifications_complete": dict(folder="A-Notifications", limit=100, unseen_only=True),
    "auto_complete_complete": dict(folder="Auto Complete", limit=100, unseen_only=True),
    "completed_to_read": dict(folder="Completed", limit=50, unseen_only=True, since_days=2),
}


def mailbox_run(box: DataFrame, run: str, now: Column, order: list[str], **changed) -> DataFrame:
    """One of the preset runs at the time ``now``; ``limit=None`` takes all its messages."""
    spec = MAILBOX_RUNS[run] | changed
    before, since = spec.pop("before_days", None), spec.pop("since_days", None)
    return move_matching(
        box,
        order=order,
        before=now - F.expr(f"INTERVAL {before} DAYS") if before else None,
        since=now - F.expr(f"INTERVAL {since} DAYS") if since else None,
        **spec,
    )


def update_status(df: DataFrame, changes: DataFrame, key: str, field: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Set one field by id. Also returns the ids of ``changes`` that matched no row."""
    side = changes.select(quoted(key), F.struct(quoted(value)).alias("_v"))
    updated = df.join(side, key, "left").select(
        *[
            F.when(F.col("_v").isNotNull(), F.col("_v")[value]).otherwise(quoted(c)).cast(df.schema[c].dataType).alias(c)
            if c == field
            else quoted(c)
            for c in df.columns
        ]
    )
    unmatched = changes.select(key).join(df.select(key), key, "left_anti")
    return updated, unmatched


def require_matched(unmatched: DataFrame) -> None:
    """Raise when an update named an id that no row has (reads one row at most)."""
    if unmatched.limit(1).count():
        raise ValueError("No record updated. Please check the id.")


def merge_config(config: DataFrame, edits: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Overwrite the flags of known ids; edits of unknown ids are ignored."""
    side = broadcast_if_small(edits.select(key, F.struct(*flags).alias("_e")))
    return config.join(side, key, "left").select(
        *[F.when(F.col("_e").isNotNull(), F.col("_e")[c]).otherwise(F.col(c)).alias(c) if c in flags else quoted(c) for c in config.columns]
    )
