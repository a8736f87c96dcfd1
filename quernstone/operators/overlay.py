"""Authority layering: guarded patches, fills, inserts, projections, and comparisons of sources.

Nothing is changed in place: every operator returns the new rows and a report
with a status for each patch. Patches find their rows by an equi-join; all are
idempotent, the second run reports ``already``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.stats import cost
from ..functions.text import unit_key
from .lineage import cut
from .ordered import keep_last, numbered


def compare_and_set(base: DataFrame, patches: DataFrame, key: Sequence[str], column: str, guard=lambda c: c) -> tuple[DataFrame, DataFrame]:
    """Set ``column`` to ``to`` where it still reads ``from``, patch after patch.

    ``patches`` has the key and ``patch_id, from, to``. The patches of a row
    are folded in the order of patch_id (then of from and to), each on what the
    one before it left, so a chain 3 to 4 to 6 is applied and a second patch
    from 3 is a mismatch. Statuses: ``invalid`` (a part is missing),
    ``not_unique`` (no row, or several), ``already``, ``mismatch``, ``applied``.
    ``found`` is the value that the patch met. A null key meets no row.
    """
    target = base.groupBy(*key).agg(F.count("*").alias("_n"), F.min(column).cast("string").alias("_current"))
    wanted = F.array_sort(F.collect_list(F.struct("patch_id", F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))))
    met = patches.groupBy(*key).agg(wanted.alias("_wanted")).join(target, list(key), "left")
    of_patch = f"patch_id: {dict(patches.dtypes)['patch_id']}, `from`: string, `to`: string, found: string, status: string"

    def step(state: Column, patch: Column) -> Column:
        now = state["now"]
        status = (
            F.when(patch["from"].isNull() | patch["to"].isNull(), "invalid")
            .when(F.coalesce("_n", F.lit(0)) != 1, "not_unique")
            .when(guard(now) == guard(patch["to"]), "already")
            .when(guard(now) == guard(patch["from"]), "applied")
            .otherwise("mismatch")
        )
        told = F.struct(patch["patch_id"].alias("patch_id"), patch["from"].alias("from"), patch["to"].alias("to"), now.alias("found"), status.alias("status"))
        return F.struct(F.when(status == "applied", patch["to"]).otherwise(now).alias("now"), F.concat(state["told"], F.array(told)).alias("told"))

    start = F.struct(F.col("_current").alias("now"), F.array().cast(f"array<struct<{of_patch}>>").alias("told"))
    folded = met.select(*key, F.aggregate("_wanted", start, step).alias("_end"))
    report = folded.select(*key, F.explode("_end.told").alias("_told")).select("_told.patch_id", *key, "_told.from", "_told.to", "_told.found", "_told.status")
    done = folded.where(F.exists("_end.told", lambda t: t["status"] == "applied")).select(*key, F.col("_end.now").alias("_to"))
    changed = base.join(done, list(key), "left").withColumn(column, F.coalesce(F.col("_to").cast(dict(base.dtypes)[column]), column)).select(*base.columns)
    return changed, report


def edit_list(current: Column, remove: Column, add: Column) -> Column:
    """``current`` without the entries of ``remove`` (in any case), order kept, and what ``add`` has that is missing."""
    lowered = F.transform(remove, F.lower)
    kept = F.filter(current, lambda k: ~F.array_contains(lowered, F.lower(k)))
    return F.concat(kept, F.filter(F.array_distinct(add), lambda k: ~F.array_contains(F.transform(kept, F.lower), F.lower(k))))


def guarded_insert(base: DataFrame, rows: DataFrame, key: str, name: str, group: str, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Insert rows whose key and (name, group) are new, one after the other by ``order`` (then key, name, group).

    Statuses: ``invalid`` (no key or no name), ``exists`` (the key is there
    with that name), ``id_clash`` (with another or none), ``name_clash`` (the
    group has the name), ``inserted``. A row also meets those inserted before
    it, and only those: what is turned down takes neither key nor name. The
    outcome of that sequence is found in rounds. In each, a row that is the
    first of the undecided both for its key and for its name is inserted, and
    the undecided that it meets are turned down; reasons are told at the end. Columns of ``order`` that the
    base lacks are not inserted.
    """
    ids = base.groupBy(F.col(key).alias("_key")).agg(F.collect_set(name).alias("_names"))
    named = base.select(F.col(name).alias("_name"), F.col(group).alias("_group"), F.lit(True).alias("_taken")).distinct()
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    met = numbered.join(ids, F.col(key) == F.col("_key"), "left").join(named, (F.col(name) == F.col("_name")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    status = (
        F.when(F.col(key).isNull() | F.col(name).isNull(), "invalid")
        .when(F.array_contains("_names", F.col(name)), "exists")
        .when(F.col("_key").isNotNull(), "id_clash")
        .when(F.col("_taken"), "name_clash")
    )
    known = cut(met.withColumn("status", status).drop("_key", "_names", "_name", "_group", "_taken"))
    decided, undecided = known.where("status <> 'name_clash'"), known.where("status is null or status = 'name_clash'")
    rank = F.struct(*[F.col(c) for c in (*order, key, name, group, "_id")])
    open_ = undecided.where("status is null").drop("status")
    winners = open_.limit(0).withColumn("_rank", rank)
    while not open_.isEmpty():
        by_key = open_.groupBy(F.col(key).alias("_key")).agg(F.min(rank).alias("_k"))
        by_name = open_.groupBy(F.col(name).alias("_name"), F.col(group).alias("_group")).agg(F.min(rank).alias("_m"))
        ranked = open_.join(by_key, F.col(key) == F.col("_key")).join(by_name, (F.col(name) == F.col("_name")) & F.col(group).eqNullSafe(F.col("_group")))
        wins = cut(ranked.where((F.col("_k._id") == F.col("_id")) & (F.col("_m._id") == F.col("_id"))).select(*open_.columns).withColumn("_rank", rank))
        left = open_.join(wins.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
        taken = wins.select(F.col(name).alias("_name"), F.col(group).alias("_group"))
        open_ = cut(left.join(taken, (F.col(name) == F.col("_name")) & F.col(group).eqNullSafe(F.col("_group")), "left_anti"))
        winners = winners.unionByName(wins)
    before = winners.select(F.col(key).alias("_key"), F.col(name).alias("_other"), F.col("_id").alias("_by"), F.col("_rank").alias("_before"))
    met = undecided.withColumn("_rank", rank).join(before, (F.col(key) == F.col("_key")) & (F.col("_before") <= F.col("_rank")), "left")
    status = F.when(F.col("_by") == F.col("_id"), "inserted").when(F.col("_other") == F.col(name), "exists").when(F.col("_by").isNotNull(), "id_clash").otherwise("name_clash")
    decided = decided.unionByName(met.withColumn("status", status).select(*decided.columns))
    new = decided.where("status = 'inserted'").select(*[c for c in rows.columns if c in base.columns or c not in order])
    return base.unionByName(new, allowMissingColumns=True), decided.select(*dict.fromkeys([*order, key, name]), "status")


def insert_children(base: DataFrame, rows: DataFrame, report: DataFrame, key: str, parent: str) -> DataFrame:
    """``base`` and the rows whose parent (``parent`` in them, ``key`` in the report) has been inserted now."""
    inserted = report.where("status = 'inserted'").select(F.col(key).alias(parent)).distinct()
    return base.unionByName(rows.join(inserted, parent, "left_semi"), allowMissingColumns=True)


def fill_empty(current: Column, value: Column) -> tuple[Column, Column]:
    """The filled value, and its status: ``already``, ``mismatch``, ``filled``, ``no_source``."""
    empty = F.nullif(F.trim(current), F.lit("")).isNull()
    status = F.when(value.isNull(), "no_source").when(empty, "filled").when(current == value, "already").otherwise("mismatch")
    return F.when(empty, F.coalesce(value, current)).otherwise(current), status


def deactivate(base: DataFrame, marks: DataFrame, key: str, name: str, column: str = "state") -> tuple[DataFrame, DataFrame]:
    """Mark rows as removed if the name that the mark expects is theirs; the column is added if it is absent."""
    rows = base if column in base.columns else base.withColumn(column, F.lit(None).cast("string"))
    met = marks.select(key, F.col(name).alias("_expected"), F.col("mark").alias("_mark")).join(rows.select(key, name, column, F.lit(True).alias("_there")), key, "left")
    status = (
        F.when(F.col("_there").isNull(), "not_found")
        .when(~F.lower(name).eqNullSafe(F.lower("_expected")), "mismatch")
        .when(F.col(column) == F.col("_mark"), "already")
        .otherwise("applied")
    )
    report = met.withColumn("status", status).select(key, "_mark", "status")
    marked = rows.join(report.where("status = 'applied'").drop("status"), key, "left")
    return marked.withColumn(column, F.coalesce("_mark", column)).drop("_mark").select(*rows.columns), report.select(key, "status")


def fingerprinted(base: DataFrame, payloads: DataFrame, key: str, digest: Column) -> DataFrame:
    """``base`` with ``payload`` where the payload's fingerprint is that of the row's text now.

    Statuses: ``projected``, ``stale`` (the text has changed, the payload is
    cleared), ``none``.
    """
    met = base.withColumn("_digest", digest).join(payloads.select(key, F.col("fingerprint").alias("_print"), F.col("payload").alias("_payload")), key, "left")
    fresh = F.col("_print") == F.col("_digest")
    status = F.when(F.col("_print").isNull(), "none").when(fresh, "projected").otherwise("stale")
    return met.withColumn("payload", F.when(fresh, F.col("_payload"))).withColumn("status", status).drop("_digest", "_print", "_payload")


def replace_source(base: DataFrame, rows: DataFrame, source: str, name: str) -> DataFrame:
    """Rows of the source give way to the new ones."""
    return base.where(~F.col(source).eqNullSafe(F.lit(name))).unionByName(rows)


def manifest_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status``: added, removed, changed or unchanged."""
    o, n = old.select(key, F.col(value).alias("_old"), F.lit(1).alias("_o")), new.select(key, F.col(value).alias("_new"), F.lit(1).alias("_n"))
    status = (
        F.when(F.col("_o").isNull(), "added")
        .when(F.col("_n").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def regression_guard(old: DataFrame, new: DataFrame, key: str, least_share: float = 0.5) -> DataFrame:
    """``key, n_old, n_new, ok``: a source that lost too many rows must not replace the old one."""
    o, n = (d.groupBy(key).agg(F.count("*").alias(c)) for d, c in ((old, "n_old"), (new, "n_new")))
    both = o.join(n, key, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("long")))
    return both.withColumn("ok", F.col("n_new") >= least_share * F.col("n_old"))


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "field", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), variable, value)


def stat_differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], norm=lambda c: c) -> DataFrame:
    """``key, field, left_value, right_value, agrees`` for keys that both have."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").alias("left_value"), F.col(f"r.{f}").alias("right_value")) for f in fields])
    met = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    out = met.select(F.col(f"l.{key}").alias(key), F.explode(pairs).alias("p")).select(key, "p.*")
    return out.withColumn("agrees", norm(F.col("left_value")).eqNullSafe(norm(F.col("right_value"))))


def majority(df: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = Window.partitionBy(*group).orderBy(F.desc("votes"), "_first")
    return counted.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_first")


def price_tiers(items: DataFrame, key: Sequence[str], models: str, cost: str, qualified: str) -> DataFrame:
    """One price per key and model count: a plain one before qualified ones, and those only if they agree."""
    plain = F.max(F.when(~F.col(qualified), F.col(cost)))
    least, most = (f(F.when(F.col(qualified), F.col(cost))) for f in (F.min, F.max))
    return items.groupBy(*key, models).agg(plain.alias("_plain"), least.alias("_least"), most.alias("_most")).select(*key, models, F.coalesce("_plain", F.when(F.col("_least") == F.col("_most"), F.col("_least"))).alias(cost)).where(F.col(cost).isNotNull())


def price_lookup(listed: DataFrame, units: DataFrame, aliases: DataFrame) -> DataFrame:
    """``list_id, how, unit_id``: the units that a listed name means, by its name, its alias, or its singular if one name has it.

    ``listed``: list_id, faction, name. ``units``: unit_id, faction, name; all units of a name are meant.
    ``aliases``: alias, name. An alias of several names of the faction is ``ambiguous`` and means none.
    """
    own = units.select("unit_id", "faction", F.lower(F.trim("name")).alias("unit"))
    names = own.select("faction", "unit").distinct()
    single = names.groupBy("faction", unit_key(F.col("unit")).alias("single")).agg(F.min("unit").alias("by_single"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    wanted = listed.select("list_id", "faction", F.lower(F.trim("name")).alias("key")).withColumn("single", unit_key(F.col("key")))
    pairs = aliases.select(F.lower(F.trim("alias")).alias("key"), F.lower(F.trim("name")).alias("unit")).distinct()
    alias = pairs.join(names, "unit").groupBy("faction", "key").agg(F.min("unit").alias("by_alias"), F.count("*").alias("_aliases"))
    met = (
        wanted.join(names.select("faction", F.col("unit").alias("key"), F.col("unit").alias("by_name")), ["faction", "key"], "left")
        .join(alias, ["faction", "key"], "left")
        .join(single, ["faction", "single"], "left")
    )
    several = F.col("_aliases") > 1
    how = (
        F.when(F.col("by_name").isNotNull(), "exact").when(several, "ambiguous").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_single").isNotNull(), "singular").otherwise("none")
    )
    unit = F.when(F.col("by_name").isNotNull(), F.col("by_name")).when(several, F.lit(None)).otherwise(F.coalesce("by_alias", "by_single"))
    told = met.select("list_id", "faction", how.alias("how"), unit.alias("unit"))
    return told.join(own, ["faction", "unit"], "left").select("list_id", "how", "unit_id")


def told_tiers(listed: DataFrame, key: Sequence[str], models: str, cost: str) -> DataFrame:
    """``key, listed``: what a price list says of each key, ``array<struct<models, cost>>`` in the order of the counts.

    A count at several costs says nothing, entries without a count or a cost
    are passed over; so the array is as long as a key has counts, however
    often the list has the key.
    """
    counts = listed.where(F.col(models).isNotNull() & F.col(cost).isNotNull()).groupBy(*key, F.col(models).cast("int").alias("models")).agg(F.min(F.col(cost).cast("int")).alias("cost"), F.max(F.col(cost).cast("int")).alias("_most"))
    return counts.where("cost = _most").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("models", "cost"))).alias("listed"))


def merged_tiers(items: Column, listed: Column) -> Column:
    """Price items ``array<struct<models, cost>>`` with the listed costs: matching ones updated, missing ones added.

    Of a list, a model count with several costs says nothing, and entries
    without a count or a cost are passed over; null arrays count as empty.
    """
    kind = "array<struct<models: int, cost: int>>"
    own, given = F.coalesce(items.cast(kind), F.array().cast(kind)), F.coalesce(listed.cast(kind), F.array().cast(kind))
    whole = F.array_distinct(F.filter(given, lambda i: i["models"].isNotNull() & i["cost"].isNotNull()))
    told = F.filter(whole, lambda i: F.size(F.filter(whole, lambda x: x["models"] == i["models"])) == 1)
    price = lambda models: F.get(F.filter(told, lambda x: x["models"] == models), 0)["cost"]
    updated = F.transform(own, lambda i: F.struct(i["models"].alias("models"), F.coalesce(price(i["models"]), i["cost"]).alias("cost")))
    return F.concat(updated, F.filter(told, lambda i: ~F.exists(own, lambda x: x["models"].eqNullSafe(i["models"]))))


def imported(rows: DataFrame, key: str, renames: dict[str, str] | None = None) -> DataFrame:
    """The rows that have a key, under their new names."""
    return rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")).withColumnsRenamed(renames or {})


def import_counts(rows: DataFrame, key: str) -> DataFrame:
    """``kept, skipped``: rows with and without a key."""
    has = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
    return rows.agg(F.count_if(has).alias("kept"), F.count_if(~has).alias("skipped"))


def priced(ids: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    """``unit_id, points, options, note`` of every id asked for: its least price, how many prices it has, or why it has none.

    ``units``: unit_id. ``items``: unit_id, cost.
    """
    least = items.groupBy("unit_id").agg(F.min("cost").alias("points"), F.countDistinct("cost").alias("options"))
    met = ids.join(units.select("unit_id", F.lit(True).alias("_known")), "unit_id", "left").join(least, "unit_id", "left")
    note = F.when(F.col("_known").isNull(), "unknown unit").when(F.col("points").isNull(), "no price").otherwise("")
    return met.select("unit_id", "points", F.coalesce("options", F.lit(0).cast("bigint")).alias("options"), note.alias("note"))


def guarded_writes(pages: DataFrame, registered: DataFrame) -> DataFrame:
    """``page, status``: official pages and those a person has edited (their hash is not the registered one) stay, others are written.

    ``pages``: page, sha256, official. ``registered``: page, sha256.
    """
    met = pages.join(registered.select("page", F.col("sha256").alias("_own")), "page", "left")
    status = F.when(F.col("official"), "official").when(F.col("_own").isNull(), "new").when(F.col("_own") != F.col("sha256"), "edited").otherwise("write")
    return met.select("page", status.alias("status"))


def ability_rows(masters: DataFrame, links: DataFrame, order: Sequence[str]) -> DataFrame:
    """``id, owner, name, text``: abilities of their own (``id, name, text``, no owner) and those of units (``owner, name, text``), one row for each id.

    The rows of a unit are numbered within it by ``order`` (in both), which
    makes their ids, so an ability that several units share stays with each;
    rows without an owner or a name take no number. Of rows with one id the
    last counts, and links come after the masters.
    """
    own = masters.where("trim(coalesce(id, '')) <> ''").select("id", F.lit(None).cast("string").alias("owner"), "name", "text", F.lit(0).alias("_kind"), *order)
    named = links.where("trim(coalesce(owner, '')) <> '' and trim(coalesce(name, '')) <> ''").withColumn("name", F.trim("name"))
    of_units = numbered(named, ["owner"], order, "_nth").select(F.concat("owner", F.lit("_a"), F.col("_nth").cast("string")).alias("id"), "owner", "name", "text", F.lit(1).alias("_kind"), *order)
    return keep_last(own.unionByName(of_units), ["id"], ["_kind", *order]).select("id", "owner", "name", "text")


def unit_projection(datasheets: DataFrame, models: DataFrame, costs: DataFrame, terms: DataFrame, factions: DataFrame) -> DataFrame:
    """``unit_id, name, name_zh, faction_id, faction, points, items, models, first_m``: a unit for each datasheet that has an id.

    ``datasheets``: id, name, faction_id. ``models``: datasheet_id, line, M.
    ``costs``: datasheet_id, line, description, cost (text; what is no number
    is no cost). ``terms``: canonical_id, zh, ord; the last of an id counts.
    ``factions``: id, name. Children stand in the order of their lines; those
    without a datasheet, or of one without an id, are left out. Of several
    datasheets with one id each is a unit. What a unit lacks is null, its
    items empty.
    """
    line = F.col("line").try_cast("int").alias("line")
    named = terms.where("zh is not null").groupBy(F.col("canonical_id").alias("id")).agg(F.max_by("zh", F.struct("ord", "zh")).alias("name_zh"))
    priced_rows = imported(costs, "datasheet_id").select(F.col("datasheet_id").alias("id"), line, "description", cost(F.col("cost")).alias("cost"))
    items = priced_rows.groupBy("id").agg(F.min("cost").alias("points"), F.array_sort(F.collect_list(F.struct("line", "description", "cost"))).alias("items"))
    own = imported(models, "datasheet_id", {"M": "m"}).select(F.col("datasheet_id").alias("id"), line, "m").groupBy("id").agg(F.count("*").alias("models"), F.min_by("m", F.struct("line", "m")).alias("first_m"))
    sheets = imported(datasheets, "id").select("id", "name", "faction_id")
    met = sheets.join(named, "id", "left").join(items, "id", "left").join(own, "id", "left").join(factions.select(F.col("id").alias("faction_id"), F.col("name").alias("faction")), "faction_id", "left")
    listed = F.coalesce(F.transform("items", lambda x: F.struct(x["description"].alias("desc"), x["cost"].alias("cost"))), F.array().cast("array<struct<desc: string, cost: int>>"))
    return met.select(F.col("id").alias("unit_id"), "name", "name_zh", "faction_id", "faction", "points", listed.alias("items"), F.coalesce("models", F.lit(0).cast("long")).alias("models"), "first_m")
