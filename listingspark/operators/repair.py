"""Enrichment of listings from other tables: patches of weak fields, each with the reason of every change.

An operator joins its sources once and states each field's rule as a pair of columns (old, new). Patches are sparse: a row's `fields`
lists what changes, in the order of the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.functions import conditions as K
from listingspark.functions import rules as R

#: Words that say too little, which an overlay may replace.
GENERIC = {
    "transmission": ["automatic", "auto", "manual", "cvt", "n/a", "na", "-", "--", "tbd", "unknown", "unspecified"],
    "drivetrain": ["fwd", "rwd", "awd", "4wd", "4x4", "2wd", "n/a", "na", "-", "tbd", "unknown"],
    "fuel_type": ["gas", "gasoline", "unleaded", "flex fuel", "flex", "n/a", "na", "-", "tbd", "unknown"],
}
#: Keys under which a feed keeps its list of vehicles, and how deep they are looked for.
VEHICLE_LISTS, VEHICLE_DEPTH = ["inventory", "vehicles", "listings", "cars", "results", "hits", "data", "items"], 5


def is_generic(field: str, c: Column) -> Column:
    """Empty, a single character, or one of the field's words that say too little."""
    low = F.lower(F.trim(c))
    words = GENERIC.get(field)
    return R.is_empty(c) | (F.length(low) <= 1) | (low.isin(words) if words else F.lit(False))


def names_of(changes: dict[str, Column]) -> Column:
    """The fields whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, k) for k, c in changes.items()]))


def storage_repairs(rows: DataFrame, reference: DataFrame, on: list[str], texts: list[str], filled: list[str], number: str = "cylinders") -> DataFrame:
    """`rows` with repaired columns and `fields`, the repaired ones.

    Junk of `texts` becomes null. Empty ones of `filled` (also in `texts`) take the reference's value, if that isn't junk; the number
    does where it is null or 0. A real value of the listing is never replaced.
    """
    joined = rows.join(reference.withColumnsRenamed({c: f"_{c}" for c in reference.columns if c not in on}), on, "left")
    new = {c: F.when(~R.is_empty(F.col(c)), F.trim(c)).otherwise(R.placeholder_null(F.col(f"_{c}")) if c in filled else F.lit(None)) for c in texts}
    new[number] = F.when(F.col(number) != 0, F.col(number)).otherwise(F.coalesce(F.when(F.col(f"_{number}") >= 0, F.col(f"_{number}")), F.col(number)))
    fields = names_of({c: ~F.col(c).eqNullSafe(v) for c, v in new.items()})
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], fields.alias("fields"))


def storage_traits(rows: DataFrame, url: str, cpo: str) -> DataFrame:
    """`rows` after storage_repairs() with what else a stored row gets: a condition where it has none that says something, and the families of an interior colour that the repair changed.

    `fields` names them too. A condition that is there stays; `interior_families` is null where the interior stays as it was.
    """
    told = K.inferred(F.col("make"), F.col("title"), F.col(url), F.col(cpo), F.col("mileage"), F.col("year"))
    rows = rows.withColumn("_told", F.when(R.is_empty(F.col("condition")), told))
    families = F.when(F.array_contains("fields", "interior_color"), R.color_families(F.col("interior_color")))
    more = F.concat("fields", names_of({"condition": F.col("_told").isNotNull(), "interior_families": families.isNotNull()}))
    return rows.withColumns({"condition": F.coalesce("_told", "condition"), "interior_families": families, "fields": more}).drop("_told")


def decode_backfill(rows: DataFrame, cache: DataFrame, key: str, texts: list[str], overwrite: bool = False) -> DataFrame:
    """`rows` (with `fields` of an earlier repair) after the decoder's cached answers, and `decoded`, the columns that they gave.

    A text may be filled where it is empty, the year where it is null or not positive, the cylinders likewise unless the fuel says
    electric (but not plug-in). With `overwrite`, any value gives way. Rows whose key can't be decoded stay.
    """
    return decoded(rows.join(cache.withColumnsRenamed({c: f"_{c}" for c in cache.columns if c != key}), key, "left"), rows.columns, key, texts, overwrite)


def decoded(joined: DataFrame, columns: list[str], key: str, texts: list[str], overwrite: bool = False) -> DataFrame:
    """decode_backfill() of rows that hold their answers already, the answers' columns with `_` before their names; `columns` are kept."""
    fuel = F.lower(F.coalesce("fuel_type", F.lit("")))
    electric = fuel.contains("electric") & ~fuel.contains("plug")
    open_slot = {c: R.is_empty(F.col(c)) for c in texts} | {"year": ~F.coalesce(F.col("year") > 0, F.lit(False)), "cylinders": ~electric & ~F.coalesce(F.col("cylinders") > 0, F.lit(False))}
    if overwrite:
        open_slot = {c: ok | F.col(c).isNotNull() for c, ok in open_slot.items()}
    given = {c: R.is_decodable_vin(F.col(key)) & ok & ~R.is_empty(F.col(f"_{c}").cast("string")) for c, ok in open_slot.items()}
    given = {c: F.coalesce(ok, F.lit(False)) for c, ok in given.items()}
    return joined.select(*[F.when(given[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in columns], names_of(given).alias("decoded"))


def overlay_merge(rows: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """`rows` after a text overlay of the same columns: `filled`, and `skipped` where the overlay had something and the listing's value stayed.

    Specs replace empty or generic values, colours and body style empty ones only; a single colour word never replaces a richer text.
    """
    return overlaid(rows.join(overlay.withColumnsRenamed({c: f"_{c}" for c in overlay.columns if c != key}), key, "left"), rows.columns)


def overlaid(joined: DataFrame, columns: list[str]) -> DataFrame:
    """overlay_merge() of rows that hold their overlay already, its columns with `_` before their names; `columns` are kept."""
    specs, plain = list(GENERIC), ["interior_color", "exterior_color", "body_style"]
    normal = {"transmission": R.norm_transmission, "drivetrain": R.norm_drivetrain, "fuel_type": R.norm_fuel}
    value = {c: normal[c](F.col(f"_{c}")) for c in specs} | {c: R.placeholder_null(F.trim(f"_{c}")) for c in plain}
    weak = {c: is_generic(c, F.col(c)) for c in specs} | {c: R.is_empty(F.col(c)) for c in plain}
    # columns of their own, so that each rule runs once for a row
    joined = joined.withColumns({f"_new_{c}": v for c, v in value.items()} | {f"_weak_{c}": w for c, w in weak.items()})
    value, weak = {c: F.col(f"_new_{c}") for c in value}, {c: F.col(f"_weak_{c}") for c in weak}
    offered = {c: v.isNotNull() for c, v in value.items()}
    taken = {c: F.coalesce(offered[c] & weak[c], F.lit(False)) for c in value}
    kept = {c: F.coalesce(offered[c] & ~weak[c], F.lit(False)) for c in value}
    return joined.select(*[F.when(taken[c], value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in columns], names_of(taken).alias("filled"), names_of(kept).alias("skipped"))


def recovery_merge(rows: DataFrame, incoming: DataFrame, key: str, longer: list[str], if_empty: list[str], positive: list[str]) -> DataFrame:
    """`rows` after a second source: a longer text wins, other texts and numbers only fill gaps, images come only where there are none.

    `notes` lists what changed; `status` compares the fields that lack a value before and after: recovered, partially_recovered or unrecoverable.
    """
    joined = rows.join(incoming.withColumnsRenamed({c: f"_{c}" for c in incoming.columns if c != key}), key, "left")
    old = {c: R.placeholder_null(F.trim(c)) for c in (*longer, *if_empty)}
    new = {c: R.placeholder_null(F.trim(f"_{c}")) for c in (*longer, *if_empty)} | {c: F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")) for c in positive}
    wins = {c: new[c].isNotNull() & (old[c].isNull() | (F.length(new[c]) > F.length(old[c]))) for c in longer}
    wins |= {c: new[c].isNotNull() & old[c].isNull() for c in if_empty}
    wins |= {c: new[c].isNotNull() & ~F.coalesce(F.col(c) > 0, F.lit(False)) for c in positive}
    http = lambda g: F.filter(F.coalesce(g, F.array().cast("array<string>")), lambda u: F.trim(u).startswith("http"))
    mine, theirs = http(F.col("gallery")), http(F.col("_gallery"))
    pictures = (F.size(mine) == 0) & (F.size(theirs) > 0)
    wins = {c: F.coalesce(w, F.lit(False)) for c, w in wins.items()} | {"gallery": pictures}
    value = {c: new[c] for c in (*longer, *if_empty, *positive)} | {"gallery": F.slice(theirs, 1, 24)}
    lacking = {c: v.isNull() for c, v in old.items()} | {c: ~F.coalesce(F.col(c) > 0, F.lit(False)) for c in positive} | {"gallery": F.size(mine) == 0}
    count = lambda flags: reduce(lambda a, b: a + b, [F.when(f, 1).otherwise(0) for f in flags])
    before, after = count(lacking.values()), count([f & ~wins[c] for c, f in lacking.items()])
    notes = names_of(wins)
    status = F.when(F.size(notes) == 0, "unrecoverable").when(after == 0, "recovered").when(after < before, "partially_recovered").otherwise("unrecoverable")
    return joined.select(*[F.when(wins[c], value[c]).otherwise(F.col(c)).alias(c) if c in wins else F.col(c) for c in rows.columns], notes.alias("notes"), before.alias("missing_before"), after.alias("missing_after"), status.alias("status"))


#: Classes of a listing's images that stay and that go; the confidence from which an exterior colour counts.
GOOD_IMAGES = ["exterior", "interior", "window_sticker", "sticker", "monroney", "monroney_label", "window_label", "cabin"]
BAD_IMAGES = ["not_vehicle", "irrelevant", "dealership", "logo", "sign", "map", "building", "staff", "marketing"]
SURE = "high"
#: The least confidence of a guessed interior.
GUESS = 0.55


def united(old: Column, new: Column) -> Column:
    """Texts of both lists in order, once each in any case, without blank ones."""
    nothing = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(old, nothing), F.coalesce(new, nothing)), lambda x: F.trim(x))
    low = F.transform(both, F.lower)
    return F.filter(both, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1))


def stays(category: Column, keep: Column) -> Column:
    """Whether an image of this class stays: a known class decides; else `keep` (true or false, in words or digits); without a class or a word it does."""
    name = F.regexp_replace(F.lower(F.trim(category)), "[ -]", "_")
    said = F.lower(F.trim(keep))
    return F.when(name.isin(GOOD_IMAGES), True).when(name.isin(BAD_IMAGES), False).when(said.isin("false", "0", "no"), False).otherwise(True)


def kept_images(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """(key, gallery): each gallery in its order without the images that the class table (url, category, keep) tells to drop, see stays(); images without a row stay."""
    drop = classes.where(~stays(F.col("category"), F.col("keep"))).select(F.col("url").alias("_url")).distinct().withColumn("_bad", F.lit(True))
    images = rows.select(key, F.posexplode("gallery").alias("_at", "_image"))
    left = images.join(drop, F.col("_image") == F.col("_url"), "left").where("_bad IS NULL")
    return left.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_image"))), lambda x: x["_image"]).alias("gallery"))  # a gallery has some dozen images


def observation_merge(rows: DataFrame, observed: DataFrame, stickers: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """`rows` after tables of results of image models, see observed_rows(): observed (key, OBSERVED), stickers (key, options and specs), classes (url, category, keep), see kept_images()."""
    joined = rows.drop("gallery").join(kept_images(rows, classes, key), key, "left")
    joined = joined.join(observed.withColumnsRenamed({c: f"_{c}" for c in observed.columns if c != key}), key, "left").join(stickers.withColumnsRenamed({c: f"_s_{c}" for c in stickers.columns if c != key}), key, "left")
    return observed_rows(joined, rows.columns)


def observed_rows(joined: DataFrame, columns: list[str]) -> DataFrame:
    """observation_merge() of rows that hold their results already, those of models with `_` before their names, those of stickers with `_s_`, and whose gallery has only images that stay.

    `columns` are kept, with `families` of the interior and `touched`, the fields that changed. observed (confidence, interior, families, exterior, exterior_confidence, features):
    from GUESS on an empty interior takes the guess and its families join the listing's; an exterior fills an empty one only if its own confidence is `high`; features join
    the packages. Specs of stickers go into empty slots, numbers above 0 only; options join the packages.
    """
    texts, numbers = ["engine_description", "transmission", "drivetrain", "fuel_type"], ["cylinders", "mpg_city", "mpg_highway", "msrp"]
    nothing = F.array().cast("array<string>")
    sure = F.coalesce(F.col("_confidence") >= GUESS, F.lit(False))
    fills = {"interior_color": sure & R.is_empty(F.col("interior_color")) & ~R.is_empty(F.col("_interior")), "exterior_color": R.is_empty(F.col("exterior_color")) & ~R.is_empty(F.col("_exterior")) & (F.lower(F.trim("_exterior_confidence")) == SURE)}
    value = {"interior_color": F.left("_interior", F.lit(120)), "exterior_color": F.left("_exterior", F.lit(120))}
    for c in texts:
        fills[c], value[c] = R.is_empty(F.col(c)) & ~R.is_empty(F.col(f"_s_{c}")), F.left(F.trim(f"_s_{c}"), F.lit(500))
    for c in numbers:
        fills[c], value[c] = ~F.coalesce(F.col(c) > 0, F.lit(False)) & (F.col(f"_s_{c}") > 0), F.col(f"_s_{c}")
    fills = {c: F.coalesce(f, F.lit(False)) for c, f in fills.items()}
    own = {c: F.when(fills[c], value[c]).otherwise(F.col(c)) for c in fills}
    own |= {"packages": united(F.col("packages"), F.concat(F.coalesce("_features", nothing), F.coalesce("_s_options", nothing))), "gallery": F.coalesce("gallery", nothing)}
    out = joined.select(*[own.get(c, F.col(c)).alias(c) for c in columns], names_of(fills).alias("touched"), sure.alias("_sure"), F.coalesce("_families", nothing).alias("_families"))
    families = R.color_families(F.col("interior_color"))
    return out.withColumn("families", F.when(F.col("_sure"), F.array_union(families, F.col("_families"))).otherwise(families)).drop("_sure", "_families")


def vehicles_of(payloads: DataFrame, key: str, payload: str, source: str, rank: str) -> DataFrame:
    """(key, vin, year, make, model, source): each payload's vehicles, once for each VIN, the least rank first, then the place in the payload.

    payload: JSON text. A list with a vehicle that has a whole VIN is taken; other lists are searched item by item and objects by
    VEHICLE_LISTS, to VEHICLE_DEPTH levels. A vehicle needs two of year, make and model.

    A payload is searched in its own row, level by level: vehicles that are found wait for the others, and nothing is moved until they are ranked.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    first = lambda m, *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(n))), F.lit("")) for n in names])
    whole = lambda m: F.coalesce(F.upper(first(m, "vin", "VIN", "Vin")).rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.lit(False))
    entry = lambda at, v, m: F.struct(F.concat("place", F.lit("/"), F.lpad(at.cast("string"), 6, "0")).alias("place"), v.alias("v"), m.alias("m"))
    unread = F.lit(None).cast("map<string,string>")
    rows = payloads.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(rank).alias("rank"), F.lit("").alias("place"), F.try_parse_json(payload).alias("v"), unread.alias("m"))
    for _ in range(VEHICLE_DEPTH + 1):
        # an entry's fields are read once; those of a vehicle with a whole VIN stay in m, and its v is done with. Columns of their own, so that each is worked out once for a row
        rows = rows.withColumn("items", F.transform(get(F.col("v"), "$", "array<variant>"), lambda v, i: entry(i, v, get(v, "$", "map<string,string>"))))
        rows = rows.withColumn("vehicles", F.transform(F.filter("items", lambda e: whole(e["m"])), lambda e: e.withField("v", F.lit(None).cast("variant"))))
        others = F.transform("items", lambda e: e.withField("m", unread))
        named = F.filter(F.array(*[entry(F.lit(i), get(F.col("v"), f"$.{n}", "variant"), unread) for i, n in enumerate(sorted(VEHICLE_LISTS))]), lambda e: e["v"].isNotNull())
        kept = F.array(F.struct("place", "v", "m"))
        rows = rows.select("k", "source", "rank", F.inline(F.when(F.col("m").isNotNull(), kept).when(F.size("vehicles") > 0, F.col("vehicles")).when(F.col("items").isNotNull(), others).otherwise(named)))
    m = F.col("m")
    found = rows.where("m IS NOT NULL").select("k", "source", "rank", "place", F.upper(first(m, "vin", "VIN", "Vin")).alias("vin"), first(m, "year", "Year", "modelYear").try_cast("int").alias("year"), first(m, "make", "Make").alias("make"), first(m, "model", "Model").alias("model"))
    known = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("year", "make", "model")])
    best = found.where(known >= 2).groupBy("k", "vin").agg(F.min_by(F.struct("year", "make", "model", "source"), F.struct("rank", "place")).alias("x"))
    return best.select(F.col("k").alias(key), "vin", "x.year", "x.make", "x.model", "x.source")
