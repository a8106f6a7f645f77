"""Finding the entity or event a record belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.functions.text import normalise_name, normalise_name_suffix
from entitystats.session import settled, settled_small
from entitystats.skew import Timeline, null_safe_join, whole_key

#: Sizes of the character grams that names are found by.
SIZES = (1, 2, 3, 6, 12, 24)


def numbered(df: DataFrame, order: Sequence[str], start: Column, name: str = "id") -> DataFrame:
    """Consecutive ids after ``start`` in the given order."""
    line = Timeline(df.withColumn("__all", whole_key(order[0])), "__all", order).running(__i=("count", F.lit(1), True))
    return line.result().withColumn(name, start + F.col("__i")).drop("__all", "__i")


def entity_changes(records: DataFrame, entities: DataFrame, seq: str, name: str = "name", ext: str = "ext_id") -> tuple[DataFrame, DataFrame]:
    """(records with ``entity_id``, entities of the batch that are new or got their external id).

    A record finds its entity by external id, else by name; what is left makes
    new entities, one per name, numbered after the largest id in the order of
    ``seq``. An entity without an external id takes the first one that arrives
    under its name. ``entities`` has id, name, ext_id. The same records and
    entities always give the same ids.
    """
    pairs, resolved = _paired(records, entities, seq, name, ext)
    created = _created(resolved, entities)
    assigned = (
        resolved.join(created.select(F.col("id").alias("__new"), F.col("name").alias("__nn")), resolved["__label"] == F.col("__nn"), "left")
        .select("n", "x", F.coalesce("__found", "__new").alias("entity_id"))
    )
    out = null_safe_join(records, assigned.withColumnsRenamed({"n": name, "x": ext}), [name, ext])
    took = resolved.filter("__owns AND __found IS NOT NULL").groupBy(F.col("__found").alias("id")).agg(F.min("x").alias("__x"))
    filled = entities.join(took, "id").select("id", "name", F.col("__x").alias("ext_id"))
    return out, filled.unionByName(created)


def _paired(records: DataFrame, entities: DataFrame, seq: str, name: str, ext: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (name, external id) pairs of the records, and what each resolves to; both settled."""
    known_names = entities.groupBy(F.col("name").alias("__kn")).agg(
        F.min_by("id", "id").alias("__id_n"), F.min_by("ext_id", "id").alias("__ext_n")
    )
    known_ext = entities.filter("ext_id IS NOT NULL").groupBy(F.col("ext_id").alias("__ke")).agg(F.min("id").alias("__id_e"))
    label = F.coalesce(F.col(name), F.concat(F.lit("player_"), F.col(ext).cast("string")))
    pairs = records.select(F.col(name).alias("n"), label.alias("label"), F.col(ext).alias("x"), F.col(seq).alias("s"))
    pairs = pairs.groupBy("n", "label", "x").agg(F.min("s").alias("s"))
    pairs = settled(pairs.join(known_ext, pairs["x"] == known_ext["__ke"], "left").drop("__ke"))
    # the external id each name owns: its known one, else the first to arrive
    # that nobody owns yet
    arriving = (
        pairs.filter("x IS NOT NULL AND __id_e IS NULL")
        .groupBy("label")
        .agg(F.min_by("x", "s").alias("__first_ext"), F.min("s").alias("__first_s"))
    )
    owners = arriving.join(known_names, arriving["label"] == known_names["__kn"], "left").filter("__ext_n IS NULL")
    owners = owners.groupBy(F.col("__first_ext").alias("__ox")).agg(F.min_by("label", "__first_s").alias("__owner"))
    resolved = (
        pairs.join(owners, pairs["x"] == owners["__ox"], "left")
        .withColumns({"__label": F.when(F.col("__id_e").isNull(), F.coalesce("__owner", "label")), "__owns": F.col("__id_e").isNull() & F.col("__owner").isNotNull()})
        .drop("__owner", "__ox")
    )
    resolved = resolved.join(known_names.select("__kn", "__id_n"), resolved["__label"] == known_names["__kn"], "left").drop("__kn")
    return pairs, settled(resolved.withColumn("__found", F.coalesce("__id_e", "__id_n")))


def _created(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    fresh = resolved.filter("__found IS NULL").groupBy("__label").agg(F.min("s").alias("s"), F.min(F.when(F.col("__owns"), F.col("x"))).alias("ext_id"))
    top = F.coalesce(entities.agg(F.max("id").alias("m")).scalar(), F.lit(0)).cast("bigint")
    return numbered(fresh, ["s", "__label"], top).select("id", F.col("__label").alias("name"), "ext_id")


def resolve_entities(records: DataFrame, entities: DataFrame, seq: str, name: str = "name", ext: str = "ext_id") -> tuple[DataFrame, DataFrame]:
    """(records with ``entity_id``, the entity table after the batch); see ``entity_changes``."""
    out, changes = entity_changes(records, entities, seq, name, ext)
    return out, _overlaid(entities, changes)


def _overlaid(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of a table, those in ``changes`` taken from there; ids are the keys."""
    return table.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def event_changes(
    records: DataFrame, events: DataFrame, seq: str, ts: str = "game_date", sides: Sequence[str] = ("home_team", "away_team"),
    scores: Sequence[str] = ("home_score", "away_score"), match: str = "full_key",
) -> tuple[DataFrame, DataFrame]:
    """(distinct (time, sides) of the records with ``event_id``, events of the batch that are new or changed).

    A record matches an event on (time, sides), else on time alone. Scores are
    replaced only where the record has one that differs. With
    ``match="date_only"`` new records at one time make one event; by default
    each (time, sides) makes its own. New events are numbered after the largest
    id in the order of ``seq``; changed ones have ``fresh`` false.
    """
    sides, scores = list(sides), list(scores)
    batch = records.filter(F.col(ts).isNotNull()).withColumns({s: F.coalesce(F.nullif(F.col(s), F.lit("")), F.lit("UNKNOWN")) for s in sides})
    # the last known score per (time, sides) is what the batch leaves behind
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in scores]
    batch = batch.groupBy(ts, *sides).agg(F.min(seq).alias("__s"), F.max(seq).alias("__last"), *latest)
    by_key = events.groupBy(ts, *sides).agg(F.min("id").alias("__id_k"))
    by_time = events.groupBy(ts).agg(F.min("id").alias("__id_t"))
    matched = settled(batch.join(by_key, [ts, *sides], "left").join(by_time, ts, "left").withColumn("__id", F.coalesce("__id_k", "__id_t")))
    new = matched.filter("__id IS NULL")
    if match == "date_only":
        new = new.groupBy(ts).agg(
            F.min("__s").alias("__s"),
            F.min_by(F.struct(*sides), "__s").alias("__side"),
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__last"))).alias(c) for c in scores],
        ).select(ts, "__side.*", "__s", *scores)
    top = F.coalesce(events.agg(F.max("id").alias("m")).scalar(), F.lit(0)).cast("bigint")
    created = settled(numbered(new.select(ts, *sides, *scores, "__s"), ["__s"], top).select("id", ts, *sides, *scores))
    key = [ts] if match == "date_only" else [ts, *sides]
    ids = matched.select(ts, *sides, "__id").join(created.select(*key, F.col("id").alias("__new")), key, "left")
    ids = ids.select(ts, *sides, F.coalesce("__id", "__new").alias("event_id"))
    change = matched.filter("__id IS NOT NULL").groupBy(F.col("__id").alias("id")).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__last"))).alias(f"__new_{c}") for c in scores]
    )
    differs = F.lit(False)
    for c in scores:
        differs = differs | (F.col(f"__new_{c}").isNotNull() & ~F.col(f"__new_{c}").eqNullSafe(F.col(c)))
    changed = events.join(change, "id").filter(differs).select("id", ts, *sides, *[F.coalesce(f"__new_{c}", c).alias(c) for c in scores])
    return ids, changed.withColumn("fresh", F.lit(False)).unionByName(created.withColumn("fresh", F.lit(True)))


def resolve_events(
    records: DataFrame, events: DataFrame, seq: str, ts: str = "game_date", sides: Sequence[str] = ("home_team", "away_team"),
    scores: Sequence[str] = ("home_score", "away_score"), match: str = "full_key",
) -> tuple[DataFrame, DataFrame]:
    """(event table after the batch, one row with inserted and updated counts); see ``event_changes``."""
    _, changes = event_changes(records, events, seq, ts, sides, scores, match)
    counts = changes.agg(F.count_if("fresh").alias("inserted"), F.count_if(~F.col("fresh")).alias("updated"))
    return _overlaid(events.select("id", ts, *sides, *scores), changes.drop("fresh")), counts


# -- names -----------------------------------------------------------------
def _grams(text: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def _every_gram(text: Column) -> Column:
    """Grams of all ``SIZES`` that fit."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(F.length(text) >= k, _grams(text, k)).otherwise(none) for k in SIZES]))


def _probes(text: Column) -> Column:
    """The text itself where its length is one of ``SIZES``, else its grams of the largest size that fits."""
    size = F.lit(SIZES[0])
    for k in SIZES[1:]:
        size = F.when(F.length(text) >= k, F.lit(k)).otherwise(size)
    return F.when(F.length(text).isin(*SIZES), F.array(text)).otherwise(_grams(text, size))


def _rarest(texts: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """Each text with the rarest of its probes; texts with a probe that occurs nowhere go."""
    return (
        texts.withColumn("__gram", F.explode(_probes(F.col(text))))
        .join(counts, "__gram", "left")
        .groupBy(text)
        .agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__gram").alias("gram"))).alias("r"))
        .filter("r.df > 0")
        .select(text, F.col("r.gram").alias("__gram"))
    )


def _containment(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(__needle, n, match): how many names contain the needle, and the smallest ``__value`` of them.

    Containment is an equality join on character grams of growing sizes. A
    needle whose length is one of them is itself a gram, whose statistics are
    counted once, so nothing is paired up for it. Another one meets only the
    names that have its rarest gram of the largest size that fits, at least
    half of the needle, and is then checked in full. Grams that no needle asks
    for are not shuffled where the needles are few.
    """
    grams = names.withColumn("__gram", F.explode(_every_gram(F.col("__name"))))
    stats = grams.groupBy("__gram").agg(F.count(F.lit(1)).alias("__df"), F.min("__value").alias("__any"))
    whole = F.length("__needle").isin(*SIZES)
    asked = settled_small(_rarest(needles.filter(~whole), "__needle", stats.select("__gram", "__df")))
    long = (
        grams.join(asked, "__gram")
        .filter(F.col("__name").contains(F.col("__needle")))
        .groupBy("__needle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__value").alias("match"))
    )
    short = needles.filter(whole).join(stats, F.col("__needle") == F.col("__gram")).select("__needle", F.col("__df").alias("n"), F.col("__any").alias("match"))
    return long.unionByName(short)


def containing_names(needles: DataFrame, needle: str, names: DataFrame, name: str) -> DataFrame:
    """Per needle: how many distinct names contain it, and the smallest such name."""
    pool = names.select(F.col(name).alias("__name")).filter(F.length("__name") > 0).distinct().withColumn("__value", F.col("__name"))
    wanted = needles.select(F.col(needle).alias("__needle")).filter(F.length("__needle") > 0).distinct()
    return _containment(wanted, pool).select(F.col("__needle").alias(needle), F.col("n").cast("bigint").alias("n"), "match")


def contained_names(haystacks: DataFrame, haystack: str, names: DataFrame, name: str) -> DataFrame:
    """Per haystack: how many distinct names occur inside it, and the smallest.

    The mirror of ``containing_names``: each name is posted once under its
    rarest gram (rarest among the haystacks), each haystack probes its grams.
    """
    pool = names.select(F.col(name).alias("__name")).filter(F.length("__name") > 0).distinct()
    hay = haystacks.select(F.col(haystack).alias("__hay")).filter(F.length("__hay") > 0).distinct()
    hay_grams = hay.withColumn("__gram", F.explode(_every_gram(F.col("__hay"))))
    stats = hay_grams.groupBy("__gram").agg(F.count(F.lit(1)).alias("__df"))
    posted = settled_small(_rarest(pool, "__name", stats))
    return (
        hay_grams.join(posted, "__gram")
        .filter(F.col("__hay").contains(F.col("__name")))
        .groupBy("__hay")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__name").alias("match"))
        .withColumnRenamed("__hay", haystack)
    )


def map_names(roster: DataFrame, roster_name: str, names: DataFrame, name: str, ids: DataFrame | None = None) -> DataFrame:
    """Each roster name with the one name it stands for, or null.

    Exact match first, then equal after normalising, then containment either
    way when exactly one name matches. ``ids`` (roster name -> canonical name
    of its id, columns ``roster_name`` and ``canonical``) adds the canonical
    name as a further candidate and drops mappings that disagree with it.
    """
    pool = names.select(F.col(name).alias("__name")).distinct().withColumn("__norm", normalise_name(F.col("__name")))
    by_norm = pool.filter("__norm <> ''").groupBy("__norm").agg(F.min("__name").alias("__by_norm"))
    want = roster.select(F.col(roster_name).alias("__r")).distinct().withColumn("__rn", normalise_name(F.col("__r")))
    if ids is not None:
        canon = ids.groupBy(F.col("roster_name").alias("__r")).agg(F.min("canonical").alias("__canon"), F.lit(True).alias("__has_id"))
        want = want.join(canon, "__r", "left")
    else:
        want = want.withColumns({"__canon": F.lit(None).cast("string"), "__has_id": F.lit(False)})
    want = want.withColumn("__cn", normalise_name(F.col("__canon")))

    def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str) -> DataFrame:
        side = table.select(F.col(table_key).alias("__k"), F.col(value).alias(out))
        return df.join(side, df[key] == side["__k"], "left").drop("__k")

    exact = pool.select(F.col("__name").alias("__key"), F.col("__name").alias("__hit"))
    out = lookup(want, "__canon", exact, "__key", "__hit", "__c1")
    out = lookup(out, "__cn", by_norm, "__norm", "__by_norm", "__c2")
    out = lookup(out, "__r", exact, "__key", "__hit", "__c3")
    out = lookup(out, "__rn", by_norm, "__norm", "__by_norm", "__c4")
    out = settled(out.withColumn("__strict", F.coalesce("__c1", "__c2", "__c3", "__c4")))
    rest = out.filter("__strict IS NULL AND __rn <> ''").select("__rn")
    norms = by_norm.select("__norm")
    inside = containing_names(rest, "__rn", norms, "__norm").select("__rn", F.col("n").alias("__n1"), F.col("match").alias("__m1"))
    around = contained_names(rest, "__rn", norms, "__norm").select("__rn", F.col("n").alias("__n2"), F.col("match").alias("__m2"))
    out = out.join(inside, "__rn", "left").join(around, "__rn", "left")
    hits = F.coalesce("__n1", F.lit(0)) + F.coalesce("__n2", F.lit(0))
    out = out.withColumn("__one", F.when(hits == 1, F.coalesce("__m1", "__m2")))
    out = lookup(out, "__one", by_norm, "__norm", "__by_norm", "__fuzzy")
    found = F.coalesce("__strict", "__fuzzy")
    agrees = F.col("__canon").isNotNull() & ((F.col("__canon") == found) | (F.col("__cn") == normalise_name(found)))
    mapped = F.when(~F.coalesce("__has_id", F.lit(False)) | F.coalesce(agrees, F.lit(False)), found)
    how = (
        F.when(mapped.isNull(), F.lit("none")).when(F.col("__strict").isNotNull(), F.lit("strict")).otherwise(F.lit("contains"))
    )
    return out.select(F.col("__r").alias(roster_name), mapped.alias("mapped"), how.alias("how"))


def names_to_ids(queries: DataFrame, query: str, entities: DataFrame, name: str = "name", ident: str = "id") -> DataFrame:
    """Id of each name: exact, ignoring case, normalised, else normalised part of a name.

    The first tier that matches wins, the smallest id inside it.
    """
    q = queries.select(F.col(query).alias("__q")).filter(F.length(F.trim("__q")) > 0).distinct()
    e = entities.select(F.col(ident).alias("__id"), F.col(name).alias("__name")).filter("__name IS NOT NULL")
    keys = {
        "exact": lambda c: c,
        "case": lambda c: F.lower(F.trim(c)),
        "normal": normalise_name_suffix,
    }
    out = q
    for tier, key in keys.items():
        side = e.groupBy(key(F.col("__name")).alias("__k")).agg(F.min("__id").alias(f"__{tier}"))
        out = out.join(side, key(out["__q"]) == side["__k"], "left").drop("__k")
    norm_ids = e.groupBy(normalise_name_suffix(F.col("__name")).alias("__norm")).agg(F.min("__id").alias("__nid"))
    out = settled(out)
    rest = out.filter("__exact IS NULL AND __case IS NULL AND __normal IS NULL").select(
        "__q", normalise_name_suffix(F.col("__q")).alias("__rn")
    )
    pool = norm_ids.filter(F.length("__norm") > 0).select(F.col("__norm").alias("__name"), F.col("__nid").alias("__value"))
    wanted = rest.select(F.col("__rn").alias("__needle")).filter(F.length("__needle") > 0).distinct()
    part = _containment(wanted, pool).select(F.col("__needle").alias("__rn"), F.col("match").alias("__part"))
    rest = rest.join(part, "__rn", "left").select("__q", "__part")
    out = out.join(rest, "__q", "left")
    tier = (
        F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__case").isNotNull(), "case")
        .when(F.col("__normal").isNotNull(), "normalised").when(F.col("__part").isNotNull(), "contains")
    )
    return out.select(F.col("__q").alias(query), F.coalesce("__exact", "__case", "__normal", "__part").alias("id"), tier.alias("tier"))


def mapping_method(roster: DataFrame, roster_name: str, aliases: DataFrame, mapped: DataFrame) -> DataFrame:
    """How each roster name was resolved: alias+manifest, alias, manifest or none.

    ``aliases`` has (roster_name, resolved_id, priority): the smallest priority
    wins. ``mapped`` has (roster_name, mapped).
    """
    ids = aliases.filter(F.length(F.trim(F.col("resolved_id").cast("string"))) > 0).groupBy(F.col("roster_name").alias(roster_name)).agg(
        F.min_by("resolved_id", "priority").alias("resolved_id")
    )
    hits = mapped.select(F.col("roster_name").alias(roster_name), "mapped")
    out = roster.select(roster_name).join(ids, roster_name, "left").join(hits, roster_name, "left")
    has_id, has_name = F.col("resolved_id").isNotNull(), F.col("mapped").isNotNull()
    method = (
        F.when(has_id & has_name, "alias+manifest").when(has_id, "alias").when(has_name, "manifest").otherwise("none")
    )
    return out.withColumn("mapping_method", method)


def fill_names(records: DataFrame, entities: DataFrame, ids: Sequence[str], name: str = "player_name", where: Column | None = None) -> DataFrame:
    """Fill a missing name from the first id column that is set; ``repaired`` marks the rows."""
    ident = F.coalesce(*[F.col(c).cast("bigint") for c in ids])
    lookup = entities.groupBy(F.col("id").cast("bigint").alias("__id")).agg(F.min("name").alias("__name"))
    blank = F.coalesce(F.col(name), F.lit("")) == ""
    wanted = blank if where is None else blank & where
    out = records.withColumn("__pid", F.when(wanted, ident))
    out = out.join(lookup, out["__pid"] == lookup["__id"], "left").withColumn("repaired", wanted & F.col("__name").isNotNull())
    return out.withColumn(name, F.when(F.col("repaired"), F.col("__name")).otherwise(F.col(name))).drop("__pid", "__id", "__name")


def fill_empty(target: DataFrame, source: DataFrame, keys: Sequence[str], version: str, column: str) -> DataFrame:
    """Fill null or empty ``column`` from ``source``; a null version there fits any."""
    exact = source.filter(F.col(version).isNotNull()).groupBy(*keys, version).agg(F.max(column).alias("__x"))
    any_version = source.filter(F.col(version).isNull()).groupBy(*keys).agg(F.max(column).alias("__a"))
    out = target.join(exact, [*keys, version], "left").join(any_version, list(keys), "left")
    old = F.nullif(F.col(column), F.lit(""))
    return out.withColumn(column, F.coalesce(old, "__x", "__a")).drop("__x", "__a").select(target.columns)


def prefer_first(catalog: DataFrame, key: str, kinds: Sequence[str], kind: str = "kind", path: str = "path") -> DataFrame:
    """Per key the entry whose kind comes first in ``kinds``."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    return (
        catalog.withColumn("__rank", rank)
        .filter("__rank > 0")
        .groupBy(key)
        .agg(F.min_by(F.struct(F.col(kind), F.col(path)), F.struct("__rank", F.col(path))).alias("__r"))
        .select(key, "__r.*")
    )
