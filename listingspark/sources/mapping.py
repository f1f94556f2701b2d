"""Nested payloads to listing columns by a table of paths: expressions made from the table look each place up in the payload's own row.

A new dialect is further rows of the table; no expression has to be written for it. Payloads don't move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.functions import rules as R

# Where the dialects keep each field, the first usable place winning; `a.b` is b within a, `@x` an attribute whose name holds x.
DIALECTS: dict[str, dict[str, list[str]]] = {
    "com": {
        "vin": ["vin", "VIN", "stockNumber"], "stock_number": ["stockNumber"], "year": ["year", "modelYear", "model_year"], "make": ["make", "Make"], "model": ["model", "Model", "modelName"], "trim": ["trim", "Trim", "trimName"],
        "price": ["pricing.finalPrice", "pricing.internetPrice", "internetPrice", "price"], "msrp": ["pricing.msrp", "msrp"], "mileage": ["@odometer", "odometer", "mileage", "@mileage"],
        "exterior_color": ["@exteriorcolor", "exteriorColor", "exterior_color"],
        "interior_color": ["@interiorcolor", "@interiortrim", "@upholstery", "@seatcolor", "@seattrim", "@cabincolor", "@leathercolor", "@intcolor", "@interiorpackage", "@cabintrim", "interiorColor", "interior_color", "interiorTrim", "interior_trim"],
        "body_style": ["bodyStyle", "body_style", "bodyType", "body_type", "@bodystyle", "@bodytype", "@vehiclebody", "@vehicletype", "@vehbodystyle", "@bodyshape"],
        "fuel_type": ["fuelType", "fuel_type"], "transmission": ["transmission", "transmissionType"], "drivetrain": ["drivetrain", "driveType"], "cylinders": ["cylinders", "@cylinders"],
        "image_url": ["featuredImage", "featuredImage.uri", "featuredImage.url", "featured_image", "thumbnail", "thumbnail.uri", "Thumbnail", "primaryImage", "primary_image"], "zip_code": ["zipCode", "zip_code"],
        "history_url": ["carfax_url", "carfaxUrl", "carfaxLink", "history_report_url", "vehicleHistoryUrl", "vehicle_history_url", "vhr_url"],
    },
    "on": {
        "vin": ["vin", "VIN", "Vin"], "stock_number": ["stockNumber", "stock_number", "stock"], "year": ["year", "modelYear", "model_year"], "make": ["make", "Make"], "model": ["model", "Model", "modelName"], "trim": ["trim", "Trim", "trimName"],
        "price": ["price", "internetPrice", "sellingPrice"], "msrp": ["msrp", "MSRP"], "mileage": ["mileage", "odometer", "miles"],
        "exterior_color": ["exteriorColor", "exterior_color", "primaryExteriorColor", "primary_exterior_color", "extColor", "ext_color", "exterior", "color", "paint", "@exteriorcolor", "@exteriorpaint", "@paintcolor", "@bodycolor", "@extcolor", "@outersurface", "@primaryexterior"],
        "interior_color": ["interiorColor", "interior_color", "interiorTrim", "interior_trim", "intColor", "int_color", "@interiorcolor", "@interiortrim", "@upholstery", "@seatcolor", "@seattrim", "@cabincolor", "@intcolor"],
        "body_style": ["bodyStyle", "body_style", "bodyType", "body_type", "vehicleType", "vehicle_type", "@bodystyle", "@bodytype", "@vehiclebody", "@vehbodystyle"],
        "fuel_type": ["fuelType", "fuel_type", "fuel"], "transmission": ["transmission", "transmissionType"], "drivetrain": ["drivetrain", "driveType", "driveTrain"],
        "cylinders": ["cylinders", "cylinderCount", "engCylinders", "engineCylinders", "@cylinders", "@enginecylinders", "@cylinder"],
        "engine_description": ["engineDescription", "engine_description", "engineDesc", "engine", "motor", "powertrain", "engineName", "engine_name", "@enginedescription", "@enginedesc", "@enginetype", "@powertrain", "@displacement"],
        "condition": ["condition", "vehicleCondition", "vehicle_condition", "inventoryType", "inventory_type", "newUsed", "new_used", "stockType", "stock_type", "certified", "isCertified", "@vehiclecondition", "@inventorytype", "@newused", "@stocktype", "@saletype", "@vehicletypecode"],
        "mpg_city": ["mpgCity", "mpg_city", "cityMpg", "city_mpg", "epaCityMpg", "epa_city_mpg", "fuelEconomy.city", "fuelEconomy.cityMpg", "fuelEconomy.mpgCity", "fuelEconomy.combined", "@mpgcity", "@citympg", "@epacity", "@fuelcity"],
        "mpg_highway": ["mpgHighway", "mpg_highway", "highwayMpg", "highway_mpg", "epaHighwayMpg", "epa_highway_mpg", "fuelEconomy.highway", "fuelEconomy.highwayMpg", "fuelEconomy.mpgHighway", "fuelEconomy.hwy", "@mpghighway", "@highwaympg", "@epahighway", "@fuelhighway", "@hwympg", "@mpghwy"],
    },
}
#: Arrays of named attributes, and their items' names of name and value.
ATTRIBUTES = ["trackingAttributes", "tracking_attributes", "attributes"]
#: Numbers that are usable above 0 only.
WHOLE = ["year", "cylinders", "mileage", "mpg_city", "mpg_highway"]
DECIMAL = ["price", "msrp"]
#: Names of an overlay's fields, in order, and the field that they fill where it has no value of its own.
ALIASES = [
    ("driveTrain", "drive_train"), ("driveType", "drive_train"), ("driveLine", "drive_train"), ("driveline", "drive_train"), ("drive_line", "drive_train"), ("drivetrain", "drive_train"), ("transmissionType", "transmission"), ("fuelType", "fuel_type"),
    ("interiorColor", "interior_color"), ("vehicleInteriorColor", "interior_color"), ("VehicleInteriorColor", "interior_color"), ("interiorTrimColor", "interior_color"), ("interior_trim_color", "interior_color"), ("interiorUpholstery", "interior_color"),
    ("interior_upholstery", "interior_color"), ("upholsteryColor", "interior_color"), ("upholstery_color", "interior_color"), ("seatColor", "interior_color"), ("seat_color", "interior_color"), ("trimColor", "interior_color"), ("trim_color", "interior_color"),
    ("cabinColor", "interior_color"), ("cabin_color", "interior_color"), ("exteriorColor", "exterior_color"), ("vehicleModel", "vehicle_model"), ("vehicleMake", "vehicle_make"), ("stockNumber", "stock_id"), ("stockId", "stock_id"),
    ("cityFuelEconomy", "city_fuel_economy"), ("highwayFuelEconomy", "highway_fuel_economy"), ("cityFuelEfficiency", "city_fuel_economy"), ("highwayFuelEfficiency", "highway_fuel_economy"), ("mpgCity", "city_fuel_economy"), ("mpgHighway", "highway_fuel_economy"),
    ("cityMPG", "city_fuel_economy"), ("highwayMPG", "highway_fuel_economy"), ("bodyStyle", "body_style"), ("inventoryType", "inventory_type"), ("newOrUsed", "inventory_type"), ("new_or_used", "inventory_type"), ("vehicleCondition", "inventory_type"),
    ("saleClass", "inventory_type"), ("inventoryCategory", "inventory_type"), ("mfYear", "mf_year"), ("vehicleYear", "vehicle_year"), ("engineDescription", "engine"), ("engine_description", "engine"),
]
# End of the fixed values.
OVERLAY_FIELDS = list(dict.fromkeys(f for _, f in ALIASES))


def fields_of(dialects: dict[str, dict[str, list[str]]]) -> list[str]:
    return list(dict.fromkeys(f for paths in dialects.values() for f in paths))


def attributes_of(v: str) -> Column:
    """(name, value) of each named attribute of a vehicle (a variant), in order; names without blanks and signs."""
    said = lambda e, p: F.trim(F.try_variant_get(e, f"$.{p}", "string"))
    text = lambda e, p: F.when(said(e, p) != "", said(e, p))
    name = lambda e: F.regexp_replace(F.lower(F.coalesce(text(e, "name"), text(e, "key"), text(e, "id"))), "[^a-z0-9]+", "")
    one = lambda e: F.struct(name(e).alias("name"), F.coalesce(text(e, "value"), text(e, "text")).alias("value"))
    lists = [F.transform(F.try_variant_get(v, f"$.{a}", "array<variant>"), one) for a in ATTRIBUTES]
    some = F.coalesce(*[F.try_variant_get(v, f"$.{a}", "variant") for a in ATTRIBUTES]).isNotNull()  # most vehicles have none
    return F.when(some, F.filter(F.flatten(F.array_compact(F.array(*lists))), lambda x: (x["name"] != "") & x["value"].isNotNull()))


def usable(field: str, value: Column) -> Column:
    if field in WHOLE + DECIMAL:
        return F.regexp_replace(value, "[^0-9.]", "").try_cast("double") > 0
    return ~R.is_empty(value)


def mapped_rows(vehicles: DataFrame, provider: str, v: str, dialects: dict[str, dict[str, list[str]]] = DIALECTS, fields: list[str] | None = None) -> DataFrame:
    """`vehicles` with a column for each field (all, or `fields`) in place of v (a variant): the first usable value of each field, by the row's dialect; rows of unknown providers give nothing.

    An attribute stands for a field if its name, without blanks and signs, holds the table's or is held by it (names of under five characters are too short for that).
    An object has no value of its own. Every place is looked up in the row itself, in the table's order, so nothing is moved.
    """
    fields = fields_of(dialects) if fields is None else fields
    paths = {d: {f: ps for f, ps in table.items() if f in fields} for d, table in dialects.items()}
    plain = list(dict.fromkeys(p for table in paths.values() for ps in table.values() for p in ps if not p.startswith("@")))
    # what stands at each place, in columns of their own, so that each is read once for a row
    at = {p: f"_at_{i}" for i, p in enumerate(plain)}
    rows = vehicles.where(F.col(provider).isin(list(dialects))).withColumnRenamed(v, "_v")
    rows = rows.withColumns({c: F.try_variant_get("_v", "$" + "".join(f"['{n}']" for n in p.split(".")), "string") for p, c in at.items()} | {"_attributes": attributes_of("_v")})
    braced = reduce(lambda a, b: a | b, [F.coalesce(F.startswith(c, F.lit('{"')), F.lit(False)) for p, c in at.items() if "." not in p], F.lit(False))
    objects = F.map_keys(F.map_filter(F.try_variant_get("_v", "$", "map<string,variant>"), lambda _, x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))))
    rows = rows.withColumn("_objects", F.when(braced, objects))

    def place(field: str, path: str) -> Column:
        if not path.startswith("@"):
            inner = F.lit(False) if "." in path else F.coalesce(F.array_contains("_objects", path), F.lit(False))
            return F.when(~inner & usable(field, F.col(at[path])), F.col(at[path]))
        needle = F.lit(path[1:])
        held = lambda x: F.contains(x["name"], needle) | ((F.length(x["name"]) >= 5) & F.contains(needle, x["name"]))
        return F.when(F.col("_attributes").isNotNull(), F.get(F.filter("_attributes", lambda x: held(x) & usable(field, x["value"])), F.lit(0))["value"])

    digits = lambda f, kind: F.regexp_replace(f, "[^0-9.]", "").try_cast("double").cast(kind)
    found = {}
    for field in fields:
        value = F.lit(None).cast("string")
        for d, table in paths.items():
            if field in table:
                value = F.when(F.col(provider) == d, F.coalesce(*[place(field, p) for p in table[field]])).otherwise(value)
        found[field] = digits(value, "int") if field in WHOLE else digits(value, "double") if field in DECIMAL else F.trim(value)
    return rows.select(*[c for c in vehicles.columns if c != v], *[c.alias(f) for f, c in found.items()])


def mapped_by_table(payloads: DataFrame, key: str, provider: str, payload: str, dialects: dict[str, dict[str, list[str]]] = DIALECTS) -> DataFrame:
    """(key, provider, a column for each field) of vehicles in JSON, see mapped_rows(); what doesn't parse has no values."""
    return mapped_rows(payloads.select(key, provider, F.try_parse_json(payload).alias("_v")), provider, "_v", dialects)


def overlay_fields(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, OVERLAY_FIELDS): an overlay's fields under any of their names. What stands within `ep` takes the place of what stands beside it; a field's own name comes first, then its aliases in order.

    Every name is looked up in the row itself, so nothing is shuffled and a task holds one payload at a time.
    """
    names = {field: [field, *(a for a, f in ALIASES if f == field)] for field in OVERLAY_FIELDS}
    get = lambda path, kind: F.expr(f"try_variant_get(_v, '$.{path}', '{kind}')")
    # empty values count here: within `ep` they hide what stands beside it
    value = lambda n: F.when(get(f"ep.{n}", "variant").isNotNull(), get(f"ep.{n}", "string")).otherwise(get(n, "string"))
    rows = payloads.select(F.col(key).alias("_key"), F.try_parse_json(payload).alias("_v"))
    at = {n: f"_{i}" for i, n in enumerate(n for own in names.values() for n in own)}  # names differ in case only
    found = rows.select("_key", *[value(n).alias(c) for n, c in at.items()])
    return found.select(F.col("_key").alias(key), *[F.coalesce(*[R.placeholder_null(F.col(at[n])) for n in own]).alias(field) for field, own in names.items()])
