"""Reads, merges and snapshot writes of archive tables (S12-S16, J1, J2, J26, U*, W1-W7, W12, A12).

A write is a function from the current snapshot and a change set to the new
snapshot.  Keys are matched on narrow projections; record bodies are carried
only by the change set, and the base is never shuffled for a small change set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import records as R
from ..session import cut_lineage
from .sizing import is_small, lookup_join, shuffled

RECORD_COLUMNS = (
    "id checkout slug type scope title status severity body source_path tags applies_to supersedes "
    "superseded_by provenance_commit content_hash created_at updated_at"
).split()


# reads

def lookup(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is wanted."""
    return lookup_join(table, keys.select(on).distinct(), [on], "left_semi")


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("updated_at"), "id")


def get_records(records: DataFrame, keys: DataFrame, links: DataFrame | None = None,
                home: str | None = None) -> DataFrame:
    """Resolve ``keys[key]`` by id, then slug, then one hop through links.

    Returns ``[key, found_by, id]``.  A slug held by several records resolves to
    the smallest id.  With ``home``, the primary archive is that checkout plus
    the shared rows, and linked archives are tried in link order.
    """
    keys = keys.select("key").distinct()
    names = records.select("id", "slug", "checkout")
    primary = names if home is None else names.where(F.col("checkout").isin("", home))

    def resolve(source: DataFrame, extra: list[Column], rank: Column) -> DataFrame:
        by_id = source.select(*extra, F.col("id").alias("key"), "id", F.lit(0).alias("by"), rank.alias("rank"))
        by_slug = source.select(*extra, F.col("slug").alias("key"), "id", F.lit(1).alias("by"), rank.alias("rank"))
        return lookup_join(by_id.unionByName(by_slug), keys, ["key"], spread=F.xxhash64("id"))

    found = resolve(primary, [], F.lit(0))
    if links is not None and home is not None:
        order = links.where((F.col("from_checkout").isin("", home)) & (F.col("to_root") != "")).groupBy("to_root").agg(
            F.min(F.struct("kind", "from_checkout", "from_id", "to_root", "to_id")).alias("first")
        )
        peers = lookup_join(
            names.withColumnRenamed("checkout", "to_root"), order, ["to_root"], spread=F.xxhash64("id")
        ).where((F.col("to_root") != home))
        linked = resolve(peers, [F.col("first")], F.lit(1))
        found = found.withColumn("first", F.lit(None).cast(linked.schema["first"].dataType)).unionByName(linked)
    else:
        found = found.withColumn("first", F.lit(None).cast("string"))
    best = found.groupBy("key").agg(F.min(F.struct("rank", "first", "by", "id")).alias("b"))
    return best.select(
        "key",
        F.when(F.col("b.rank") == 1, "link").when(F.col("b.by") == 0, "id").otherwise("slug").alias("found_by"),
        F.col("b.id").alias("id"),
    )


def visible_counts(records: DataFrame) -> DataFrame:
    """Records each checkout can see: its own plus the shared ones.

    Counted from the per-checkout totals, so no row meets every checkout.
    """
    per = records.groupBy("checkout").agg(F.count("*").alias("own"))
    totals = per.agg(
        F.sum("own").alias("all"), F.sum(F.when(F.col("checkout") == "", F.col("own")).otherwise(0)).alias("shared")
    )
    return per.join(F.broadcast(totals)).select(  # totals is one row
        "checkout", F.when(F.col("checkout") == "", F.col("all")).otherwise(F.col("own") + F.col("shared")).alias("visible")
    )


def duplicate_ids(base: DataFrame, tenant: DataFrame) -> DataFrame:
    """Ids present on both sides of a merge."""
    return lookup_join(base.select("id"), tenant.select("id").distinct(), ["id"], "left_semi")


def merge_tenant(base: DataFrame, tenant: DataFrame, checkout: str) -> DataFrame:
    """Union a per-checkout archive into the shared one.

    A duplicate id raises, as keeping either row would lose the other.
    """
    clash = duplicate_ids(base, tenant).limit(1).collect()
    if clash:
        raise ValueError(f"record {clash[0]['id']} exists in both archives")
    return base.unionByName(tenant.withColumn("checkout", F.lit(checkout)), allowMissingColumns=True)


# set operations

def latest(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("_pos", pos).where("_pos = 1").drop("_pos")


def keep_only(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Delete what is not in the keep set; an empty keep set deletes everything."""
    return lookup_join(base, keys.select(*on).distinct(), on, "left_semi")


def drop_orphans(table: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows whose record still exists."""
    return table.join(records.select(F.col("id").alias(key)), key, "left_semi")


def prune_unseen(files: DataFrame, seen: DataFrame, scope: str = "") -> DataFrame:
    """Drop files inside the scope that the walk did not see (U4)."""
    inside = P.in_scope(F.col("path"), F.lit(scope))
    mark = seen.select("path").distinct().withColumn("_seen", F.lit(True))
    return files.join(shuffled(mark), "path", "left").where(~inside | F.col("_seen").isNotNull()).drop("_seen")


def insert_or_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key is new; a stored row is never changed."""
    fresh = delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh)


def merge_gaps(*lists: DataFrame) -> DataFrame:
    """Append gap lists, the first list that names an id wins."""
    parts = [d.select("id", "title", "archive", F.lit(n).alias("_n")) for n, d in enumerate(lists)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return latest(both, ["id"], [F.col("_n"), F.col("archive")]).drop("_n")


def latest_commits(commits: DataFrame, n: int = C.COMMIT_WINDOW) -> DataFrame:
    """The newest commits per checkout (N4); cut before the shuffle by the rank limit."""
    order = Window.partitionBy("checkout").orderBy(F.desc("authored_at"), "hash")
    return commits.withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") <= n).drop("_pos")


def index_commits(base: DataFrame, dump: DataFrame, n: int = C.COMMIT_WINDOW) -> DataFrame:
    """Insert unknown hashes, keep stored rows, keep the newest of the dump."""
    keep = latest_commits(dump, n)
    merged = insert_or_ignore(base, keep, ["checkout", "hash"])
    return merged.join(keep.select("checkout", "hash"), ["checkout", "hash"], "left_semi")


def delete_records(tables: dict[str, tuple[DataFrame, list[str]]], keys: DataFrame) -> dict[str, DataFrame]:
    """Remove keys from every table that depends on a record.

    ``tables`` maps a name to the table and its key columns; ``keys`` has them all.
    """
    return {
        name: lookup_join(table, keys.select(*on).distinct(), on, "left_anti") for name, (table, on) in tables.items()
    }


# record writes

def last_per(updates: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the last by ``seq``; ties, or all rows without ``seq``, by their columns in turn, so reruns agree.

    Only rows whose key is repeated are compared; the others stay where they lie, and their bodies are not shuffled.  The
    repeated keys are counted on the key columns alone.
    """
    content = [F.desc(c) for c in updates.columns]
    order = [F.desc("seq"), *content] if "seq" in updates.columns else content
    marks = [f"_repeated_{c}" for c in key]
    counts = updates.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = cut_lineage(counts.select(*[F.col(c).alias(m) for c, m in zip(key, marks)]))
    if repeated.isEmpty():
        return updates
    if not is_small(repeated):
        return latest(updates, key, order)
    same = [F.col(c).eqNullSafe(F.col(m)) for c, m in zip(key, marks)]
    few = latest(updates.join(F.broadcast(repeated), same, "left_semi"), key, order)
    return updates.join(F.broadcast(repeated), same, "left_anti").unionByName(few)


def plan_upserts(base: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Changed rows with an ``action`` of inserted, updated or unchanged.

    An update adopts the id and creation time of the row at its (checkout,
    source_path).  It is unchanged when the stored row of that id has the same
    content hash and path, so a change that touches only slug, supersedes,
    superseded_by or checkout is lost, as in the reference.
    """
    stored = base.select("id", "checkout", "source_path", "content_hash", "created_at")
    at_path = stored.select(
        "checkout", "source_path", F.col("id").alias("path_id"), F.col("created_at").alias("path_created")
    )
    at_id = stored.select(
        "id", F.col("content_hash").alias("old_hash"), F.col("source_path").alias("old_path"),
        F.col("created_at").alias("old_created"),
    )
    adopted = (
        last_per(updates, ["checkout", "source_path"])
        .join(at_path, ["checkout", "source_path"], "left")
        .withColumn("id", F.coalesce("path_id", "id"))
        .withColumn("created_at", F.coalesce("created_at", "path_created"))
    )
    same = (F.col("old_hash") == F.col("content_hash")) & F.col("old_path").eqNullSafe(F.col("source_path"))
    return (
        last_per(adopted, ["id"])
        .join(at_id, "id", "left")
        .withColumn("action", F.when(F.col("old_hash").isNull(), "inserted").when(same, "unchanged").otherwise("updated"))
        .withColumn("created_at", F.coalesce("old_created", "created_at", now))
        .withColumn("updated_at", now)
        .select(*RECORD_COLUMNS, "action")
    )


def apply_plan(base: DataFrame, plan: DataFrame) -> DataFrame:
    """New snapshot: base rows the plan did not touch, plus the plan's rows.

    The ids of the plan are written once, as they are measured and joined.
    """
    changed = plan.where("action <> 'unchanged'").drop("action")
    kept = lookup_join(base, cut_lineage(changed.select("id")), ["id"], "left_anti")
    return kept.select(*RECORD_COLUMNS).unionByName(changed.select(*RECORD_COLUMNS))


def upsert_records(base: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    return apply_plan(base, plan_upserts(base, updates, now))


def action_summary(plan: DataFrame) -> DataFrame:
    """How many rows each action has."""
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def complete_drafts(drafts: DataFrame, checkout: str, now: Column) -> DataFrame:
    """Defaults of a new record: slug, path, id, tenant, hash.

    The id is a hash of the content's key and the time instead of random bytes, so a
    recomputed partition gives the same id.
    """
    d = drafts.withColumn("slug", R.patched(F.col("slug"), R.slugify(F.col("title"))))
    d = d.withColumn("source_path", R.patched(F.col("source_path"), R.default_path(F.col("scope"), F.col("slug"))))
    d = d.withColumn(
        "checkout",
        F.when(F.col("scope") == "repo", R.patched(F.col("checkout"), F.lit(checkout))).otherwise(""),
    )
    made = F.concat(
        F.lit("rec_"),
        F.substr(F.sha2(F.concat_ws("\x1f", "checkout", "source_path", "title", now.cast("string")), 256), F.lit(1), F.lit(20)),
    )
    d = d.withColumn("id", R.patched(F.col("id"), made))
    return R.with_content_hash(d.withColumn("status", R.default_status(F.col("status"))))


def with_violations(records: DataFrame) -> DataFrame:
    """Add ``violations``, why a record is refused (P13); null or empty when it is valid."""
    cols = [F.col(c) for c in ("type", "scope", "status", "severity", "title", "slug")]
    return records.withColumn("violations", R.violations(*cols))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records to write, and refused ones with their ``violations``."""
    checked = records if "violations" in records.columns else with_violations(records)
    bad = F.coalesce(F.size("violations") > 0, F.lit(False))
    return checked.where(~bad).drop("violations"), checked.where(bad)


def not_found(base: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of patches or retirements that no record has."""
    return lookup_join(keys.select("id").distinct(), base.select("id"), ["id"], "left_anti")


def remember(base: DataFrame, drafts: DataFrame, checkout: str, now: Column) -> DataFrame:
    """Store valid drafts; ``split_valid`` of the completed drafts tells the refused ones."""
    accepted, _ = split_valid(complete_drafts(drafts, checkout, now))
    return upsert_records(base, accepted, now)


def plan_updates(base: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Patches ``[id, (title), (body), (status), (applies_to), (superseded_by)]`` on stored rows."""
    names = [c for c in ("title", "body", "status", "applies_to", "superseded_by") if c in patches.columns]
    new = patches.select("id", *[F.col(c).alias(f"new_{c}") for c in names])
    # the salt reads no body, as repeated keys are counted without bodies
    rows = lookup_join(base, new, ["id"], spread=F.xxhash64("checkout", "source_path", "created_at"))
    for c in names:
        put = R.patched_list if c == "applies_to" else R.patched
        rows = rows.withColumn(c, put(F.col(f"new_{c}"), F.col(c)))
    accepted, _ = split_valid(R.with_content_hash(rows).select(*RECORD_COLUMNS))
    return plan_upserts(base, accepted, now)


def retire(base: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """``targets[id, superseded_by]``: status superseded.

    Retiring a superseded record again, with another target, changes nothing.
    """
    plan = plan_updates(base, targets.withColumn("status", F.lit("superseded")), now)
    return apply_plan(base, plan)


def plan_import(base: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Merge parsed documents; actions imported, updated or skipped.

    Invalid documents take no part (``split_valid`` tells them).  Matched by id, else by (checkout, path).  A match keeps its id, creation
    time, path and checkout; nothing is ever deleted.
    """
    stored = base.select("id", "checkout", "source_path", "content_hash", "created_at")

    def renamed(prefix: str) -> DataFrame:
        return stored.select(*[F.col(c).alias(f"{prefix}_{c}") for c in stored.columns])

    docs = last_per(split_valid(docs)[0], ["id"])
    by_id = docs.join(renamed("i"), F.col("id") == F.col("i_id"), "left")
    both = by_id.join(
        renamed("p"),
        F.col("i_id").isNull() & (F.col("checkout") == F.col("p_checkout")) & (F.col("source_path") == F.col("p_source_path")),
        "left",
    )

    def old(col: str) -> Column:
        return F.coalesce(f"i_{col}", f"p_{col}")

    matched = old("id").isNotNull()
    action = (
        F.when(matched & (old("content_hash") == F.col("content_hash")), "skipped").when(matched, "updated").otherwise("imported")
    )
    return both.select(
        old("id").alias("old_id"), old("checkout").alias("old_checkout"), old("source_path").alias("old_path"),
        old("created_at").alias("old_created"), action.alias("action"), *[c for c in docs.columns],
    ).withColumn("id", F.coalesce("old_id", "id")).withColumn("checkout", F.coalesce("old_checkout", "checkout")).withColumn(
        "source_path", F.coalesce("old_path", "source_path")
    ).withColumn("created_at", F.coalesce("old_created", now)).withColumn("updated_at", now).select(*RECORD_COLUMNS, "action")


def import_merge(base: DataFrame, docs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New snapshot and the summary of actions."""
    plan = plan_import(base, docs, now)
    moves = plan.withColumn("action", F.when(F.col("action") == "skipped", "unchanged").otherwise(F.col("action")))
    return apply_plan(base, moves), action_summary(plan)


def index_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, tree: DataFrame, extract,
                scope: str = "", stale: bool = False) -> dict[str, DataFrame]:
    """Re-extract only changed files, keep the rest, prune vanished ones.

    ``tree[checkout, path, content_hash, content]``; ``extract(df)`` returns
    ``(symbols, edges)``.  ``stale`` forces every file, as a newer extractor does.
    """
    key = ["checkout", "path"]
    known = files.select(*key, "content_hash")
    changed = tree if stale else tree.join(shuffled(known), [*key, "content_hash"], "left_anti")
    new_symbols, new_edges = extract(changed)
    live = prune_unseen(files, tree, scope)
    touched = changed.select(*key)
    gone = files.select(*key).join(shuffled(live.select(*key)), key, "left_anti").unionByName(touched)
    stored = [c for c in files.columns if c in changed.columns]
    return {
        "files": lookup_join(live, touched, key, "left_anti").unionByName(
            changed.select(*stored), allowMissingColumns=True
        ),
        "symbols": lookup_join(
            symbols, gone.withColumnRenamed("path", "file_path"), ["checkout", "file_path"], "left_anti"
        ).unionByName(new_symbols, allowMissingColumns=True),
        "edges": lookup_join(
            edges, gone.withColumnRenamed("path", "from_file"), ["checkout", "from_file"], "left_anti"
        ).unionByName(new_edges, allowMissingColumns=True),
    }
