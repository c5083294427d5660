"""Form submissions to itineraries: flights, travellers, seats and layovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions.scalars import blank_to_null, booking_date_display, date_display, document_number, first_filled, minutes_before, no_refund, place, span_text, strip, text
from waybill.operators import fares
from waybill.operators.lookups import fill_blank, with_airline_code
from waybill.sources import dims

# The fields of a flight, as forms name them (a traveller's are in ``dims``).
FLIGHT_FIELDS = ("flight_no", "layover", "airline", "from_code", "from_city", "to_code", "to_city", "date", "dep_time_raw", "arr_time_raw", "dep_time", "arr_time", "duration", "class", "seat", "meal", "checkin_bag", "hand_bag", "segment_pnr")
# Keys of a form that are sent once, with what counts where one is not sent.
FORM_FIELDS = {
    "booking_id": "", "booking_date": "", "pnr": "", "customer_phone": "", "customer_email": "", "refund_status": "Refundable",
    "fare_type": "REGULAR", "payment_method": "UPI", "card_last_4": "", "booking_platform": "Direct", "is_dummy": "",
}
RAW = ("class", "meal")
SHARED = ("seat", "meal", "checkin_bag", "hand_bag")
DEFAULTS = {"seat": "", "meal": "Not selected", "checkin_bag": "Airline Default", "hand_bag": "Airline Default"}


#: Counted indices are made in steps of so many, so that no row holds them all.
STEP = 2048


def _indexed(kv: DataFrame, family: str, fields: tuple[str, ...], anchor: str, count_key: str) -> DataFrame:
    """request_id, idx, says, and a column for each field, of a family's keys, the first
    of a repeated key: a row for each index that is sent, where ``says`` is not null if
    its anchor names it (however it is spelt), and a row of index -1 for what a request
    has besides, where ``says`` is its count.

    Keys that lie together meet before they are dealt by request and index, and a field
    that nobody reads is not made; nothing here is as large as a request."""
    key = F.col("key")
    head = f"{family}_"
    after = F.when(F.startswith(key, F.lit(head)), F.substring(key, F.lit(len(head) + 1), F.length(key)))
    digits = F.substring_index("after", "_", 1)
    number = F.col("digits").try_cast("int")
    plain = (number >= 0) & (number.cast("string") == F.col("digits"))  # 01 names index 1, and is no key of its own
    rows = kv.withColumn("after", after).withColumn("digits", digits)
    rows = rows.withColumns({"field": F.substring(F.col("after"), F.length("digits") + 2, F.length("after")), "plain": F.coalesce(plain, F.lit(False))})
    named = F.col("field") == anchor
    owned = (F.col("plain") & F.col("field").isin(*fields)) | (named & F.col("digits").rlike(r"^\d+$"))
    rows = rows.withColumn("idx", F.coalesce(F.when(owned, number), F.lit(-1)))
    first = [F.col(c) for c in (("ord", "value") if "ord" in kv.columns else ("value",))]
    best = lambda condition: F.min(F.when(condition, F.struct(*first)))["value"]
    own = {f: best((F.col("idx") >= 0) & F.col("plain") & (F.col("field") == f)).alias(f) for f in fields}
    mark = F.when((F.col("idx") >= 0) & named, F.struct(*first[:-1], F.lit("").alias("value"))).when((key == count_key) & F.col("value").isNotNull(), F.struct(*first))
    return rows.groupBy("request_id", "idx").agg(F.min(mark)["value"].alias("says"), *own.values())


def _steps(requests: DataFrame, rest: list[str]) -> DataFrame:
    """request_id, the columns of ``rest``, step, size: 0 to n - 1 of each row, in steps of ``STEP``."""
    rows = requests.where("n > 0").select("request_id", *rest, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / (STEP * STEP)).cast("int"))).alias("a"))
    left = rows.withColumn("left", F.col("n") - F.col("a") * STEP * STEP)
    rows = left.select("request_id", *rest, "n", "a", F.explode(F.sequence(F.lit(0), F.least(F.lit(STEP - 1), F.floor((F.col("left") - 1) / STEP).cast("int")))).alias("b"))
    rows = rows.withColumn("step", F.col("a") * STEP + F.col("b"))
    return rows.select("request_id", *rest, "step", F.least(F.lit(STEP), F.col("n") - F.col("step") * STEP).cast("int").alias("size"))


def wide(kv: DataFrame, family: str, fields: tuple[str, ...], anchor: str, count_key: str) -> DataFrame:
    """request_id, idx (as in the keys), position, and a column for each field: a row for
    each index whose ``anchor`` was sent, in their order; where there is none, for 0 to
    the ``count_key`` less one (one if absent or no number).

    Keys are grouped by request and index, so a request may have any number of them; a
    count makes its rows in steps of ``STEP``.  Of a repeated key the first counts, as in
    :func:`forms`."""
    return _placed(_indexed(kv, family, fields, anchor, count_key), fields)


def _placed(sent: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """:func:`wide` of rows as :func:`_indexed` makes them.

    Named rows and counted ones are told apart above the window and by the same columns,
    so that one exchange, and one aggregate below it, serves both."""
    is_named = lambda: (F.col("idx") >= 0) & F.col("says").isNotNull()
    in_order = Window.partitionBy("request_id").orderBy((~is_named()).cast("int"), "idx")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # named ones come first, then index -1, so the first row tells what a request has
    placed = sent.withColumn("position", (F.row_number().over(in_order) - 1).cast("int"))
    columns = ["request_id", "idx", "position", *fields]
    n = F.coalesce(blank_to_null(F.first(F.when(F.col("idx") < 0, F.col("says"))).over(so_far)).try_cast("int"), F.lit(1))
    until = F.lead("idx").over(in_order)
    counted = placed.withColumns({"anchors": F.first(is_named()).over(so_far), "n": n, "until": until}).where("NOT anchors")
    # each row makes the indices from its own to the next one's; the first one from 0
    start = F.when(F.col("position") == 0, F.lit(0)).otherwise(F.col("idx"))
    counted = counted.withColumn("start", start).withColumn("n", F.least(F.coalesce("until", "n"), "n") - F.col("start"))
    steps = _steps(counted, ["idx", "start", *fields]).repartition("request_id", "start", "step")
    at = (F.col("start") + F.col("step") * STEP + F.col("i")).cast("int")
    rows = steps.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")).withColumn("at", at)
    made = rows.select("request_id", F.col("at").alias("idx"), F.col("at").alias("position"), *[F.when(F.col("at") == F.col("idx"), F.col(f)).alias(f) for f in fields])
    return placed.where(is_named()).select(*columns).unionByName(made)


def flights(kv: DataFrame, spark: SparkSession, airports: DataFrame) -> DataFrame:
    """One row per flight with its codes, names, display values and layover."""
    f = wide(kv, "flight", FLIGHT_FIELDS, "flight_no", "flight_count")
    f = f.withColumns({c: text(F.col(c)) for c in FLIGHT_FIELDS if c not in RAW})
    return _described(f, spark, airports).withColumn("layover", layover())


def _described(f: DataFrame, spark: SparkSession, airports: DataFrame) -> DataFrame:
    """Flights with codes, names and display values, all but the wait before them."""
    f = f.withColumns({"class": F.coalesce("class", F.lit("Economy")), "meal": F.coalesce("meal", F.lit("Not selected"))})
    f = f.withColumns({"from_code": F.upper("from_code"), "to_code": F.upper("to_code"), "segment_pnr": strip(F.col("segment_pnr"))})
    f = with_airline_code(f, spark)
    f = fill_blank(f, "airline", "airline_code", F.broadcast(dims.airlines(spark)), "iata", "name")  # a fixed table of under 200 rows
    f = fill_blank(f, "from_city", "from_code", airports, "code", "city")
    f = fill_blank(f, "to_city", "to_code", airports, "code", "city")
    return f.withColumns({
        "from_full": place(F.col("from_city"), F.col("from_code")),
        "to_full": place(F.col("to_city"), F.col("to_code")),
        "date_raw": F.col("date"),
        "date": date_display(F.col("date")),
        "checkin_closing": minutes_before(F.col("dep_time_raw")),
        "manual_layover": strip(F.col("layover")),
    })


def layover(key: str = "request_id", order: str = "position") -> Column:
    """Wait before this flight after the one before: as given, else from the
    times, where arrival counts on the departure's day or, if it would be
    earlier, on the next; null where times are missing or the wait is not positive."""
    w = Window.partitionBy(key).orderBy(order)
    before = _clock(*[F.lag(c).over(w) for c in ("date_raw", "dep_time_raw", "arr_time_raw")])
    here = _clock(*[F.col(c) for c in ("date_raw", "dep_time_raw", "arr_time_raw")])
    first = F.row_number().over(w) == 1
    return _wait(first, F.col("manual_layover"), before, here)


def _clock(date: Column, departs: Column, arrives: Column) -> tuple[Column, Column]:
    """Seconds at which a flight departs and arrives, null where they are not told."""
    stamp = lambda t: F.try_to_timestamp(F.concat(blank_to_null(date), F.lit(" "), blank_to_null(t)), F.lit("y-M-d H:m"))
    dep, arr = stamp(departs), stamp(arrives)
    arr = F.when(arr < dep, arr + F.expr("interval 1 day")).otherwise(arr)
    return F.unix_seconds(dep.cast("timestamp")), F.unix_seconds(arr.cast("timestamp"))


def _wait(first: Column, manual: Column, before: tuple[Column, Column], here: tuple[Column, Column]) -> Column:
    wait = here[0] - before[1]
    return F.when(first, F.lit(None)).when(manual != "", manual).when(before[0].isNotNull() & (wait > 0), span_text(wait))


def _own_cells(kv: DataFrame) -> DataFrame:
    """request_id, idx, own: what a traveller's keys say for a flight's position, as a
    map by ``<field>_<position>``, without empty ones."""
    key = F.col("key")
    rest = F.substring(key, F.lit(5), F.length(key))
    digits = F.substring_index(rest, "_", 1)
    number = digits.try_cast("int")
    cell = F.substring(rest, F.length(digits) + 2, F.length(rest))
    plain = (number >= 0) & (number.cast("string") == digits)
    rows = kv.where(F.startswith(key, F.lit("pax_")) & plain & cell.rlike(rf"^({'|'.join(SHARED)})_\d+$"))
    first = F.min(F.struct("ord", "value") if "ord" in kv.columns else F.struct("value"))["value"].alias("value")
    one = rows.select("request_id", number.alias("idx"), cell.alias("cell"), *[c for c in ("ord", "value") if c in kv.columns]).groupBy("request_id", "idx", "cell").agg(first)
    return one.where("value <> ''").groupBy(F.col("request_id").alias("whose"), F.col("idx").alias("of_pax")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("own"))


def _people(kv: DataFrame) -> DataFrame:
    """request_id, pax (from 0), idx, the traveller's fields (a null one empty), own."""
    names = {dims.DOCUMENT_FIELD: "document_no"}
    people = wide(kv, "pax", dims.TRAVELLER_FIELDS, "name", "pax_count")
    people = people.select("request_id", F.col("position").alias("pax"), "idx", *[text(F.col(f)).alias(names.get(f, f)) for f in dims.TRAVELLER_FIELDS])
    both = people.join(_own_cells(kv), F.col("request_id").eqNullSafe(F.col("whose")) & (F.col("idx") == F.col("of_pax")), "left")
    return both.drop("whose", "of_pax")


def _grid(own: Column, flown: Column) -> list[Column]:
    """<field>_by_flight of a traveller: their own value, else the flight's, else a default."""
    default = lambda c: lambda f: first_filled(f[c], F.lit(DEFAULTS[c]))
    cell = lambda c: lambda f: first_filled(F.try_element_at(own, F.concat(F.lit(f"{c}_"), f["position"].cast("string"))), f[c], F.lit(DEFAULTS[c]))
    none = F.array().cast("array<string>")
    return [F.coalesce(F.when(own.isNull(), F.transform(flown, default(c))).otherwise(F.transform(flown, cell(c))), none).alias(f"{c}_by_flight") for c in SHARED]


def travellers(kv: DataFrame, flights_: DataFrame, positional: bool = False) -> DataFrame:
    """One row per traveller with arrays of seats, meals and bags by flight.

    A cell takes the traveller's value for the flight, else the flight's (of
    ``flights_``), else a default.  Cells are the flights of the same request only, so
    the grid is as large as the booking.  ``positional`` looks the flight's value up
    under its position instead of under the index in its keys.  Arrays hold a request's
    whole grid; :func:`cells` has it as rows."""
    if positional:
        sent = _indexed(kv, "flight", SHARED, "flight_no", "flight_count").where("idx >= 0").select(F.col("request_id").alias("of"), F.col("idx").alias("at"), *SHARED)
        order = flights_.select("request_id", "position")
        flights_ = order.join(sent, F.col("request_id").eqNullSafe(F.col("of")) & (F.col("position") == F.col("at")), "left")
    flown = flights_.groupBy(F.col("request_id").alias("flown_by")).agg(F.sort_array(F.collect_list(F.struct("position", *SHARED))).alias("flown"))
    both = _people(kv).join(flown, F.col("request_id").eqNullSafe(F.col("flown_by")), "left")
    names = [c for c in both.columns if c not in ("own", "flown_by", "flown")]
    return both.select(*names, *_grid(F.col("own"), F.col("flown")))


def cells(kv: DataFrame, positional: bool = False) -> DataFrame:
    """request_id, pax (from 1), idx (as in the traveller's keys), position (the
    flight's), seat, meal, checkin_bag, hand_bag: the grid of :func:`travellers` as rows.

    Nothing is as large as a request here, so this is the form for requests of any size;
    travellers and flights of a request meet in a join, which may be split where one
    request has very many."""
    people = wide(kv, "pax", dims.TRAVELLER_FIELDS, "name", "pax_count").select("request_id", "idx", (F.col("position") + 1).alias("pax"))
    sent = wide(kv, "flight", FLIGHT_FIELDS, "flight_no", "flight_count").select("request_id", F.col("idx").alias("at"), "position", *[F.col(c).alias(f"flight_{c}") for c in SHARED])
    if positional:
        by_index = sent.select(F.col("request_id").alias("of"), F.col("at").alias("place"), *[f"flight_{c}" for c in SHARED])
        sent = sent.select("request_id", "position").join(by_index, F.col("request_id").eqNullSafe(F.col("of")) & (F.col("position") == F.col("place")), "left")
    pattern = rf"^pax_(\d+)_({'|'.join(SHARED)})_(\d+)$"
    part = lambda i: F.regexp_extract("key", pattern, i)
    number = lambda i: F.when(part(i) == part(i).try_cast("int").cast("string"), part(i)).try_cast("int")
    first = ["ord", "value"] if "ord" in kv.columns else ["value"]
    own = kv.where(F.col("key").rlike(pattern)).select("request_id", number(1).alias("of_pax"), number(3).alias("of_flight"), part(2).alias("field"), *first)
    own = own.groupBy("request_id", "of_pax", "of_flight", "field").agg(F.min(F.struct(*first))["value"].alias("value"))
    own = own.groupBy(F.col("request_id").alias("whose"), "of_pax", "of_flight").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("own"))
    grid = people.join(sent.withColumnRenamed("request_id", "flown"), F.col("request_id").eqNullSafe(F.col("flown")))
    grid = grid.join(own, F.col("request_id").eqNullSafe(F.col("whose")) & (F.col("idx") == F.col("of_pax")) & (F.col("position") == F.col("of_flight")), "left")
    cell = lambda c: first_filled(F.try_element_at("own", F.lit(c)), F.col(f"flight_{c}"), F.lit(DEFAULTS[c])).alias(c)
    return grid.select("request_id", "pax", "idx", "position", *[cell(c) for c in SHARED])


def route_summary(flights_: DataFrame) -> DataFrame:
    """request_id, route, flight_nos, segments."""
    in_order = F.sort_array(F.collect_list(F.struct("position", "from_code", "to_code", "flight_no")))
    g = flights_.groupBy("request_id").agg(in_order.alias("g"))
    return g.select(
        "request_id",
        F.coalesce(F.concat(F.try_element_at("g", F.lit(1))["from_code"], F.lit(" → "), F.try_element_at("g", F.lit(-1))["to_code"]), F.lit("N/A")).alias("route"),
        F.array_join("g.flight_no", ", ").alias("flight_nos"),
        F.size("g").alias("segments"),
    )


#: Kinds of a request's rows: a flight, a traveller, and the form's own fields.
FLIGHT, PERSON, OWN = 0, 1, 2
CELL = rf"^({'|'.join(SHARED)})_\d+$"
COUNTS = {FLIGHT: "flight_count", PERSON: "pax_count"}


def _sent(kv: DataFrame) -> DataFrame:
    """request_id, kind, idx, got, says, has_cells: what is sent for each flight and
    traveller as pairs and as a map by field, an anchor of an odd spelling (01) as an empty
    one, a traveller's cells by ``<field>_<position>``; and a row of kind ``OWN`` for the
    rest of a request, by key.  Of a repeated key the first counts.

    All of it is one aggregate, so keys are made and read once."""
    key, after, digits, field = F.col("key"), F.col("after"), F.col("digits"), F.col("field")
    heads = ((FLIGHT, "flight_", FLIGHT_FIELDS, "flight_no"), (PERSON, "pax_", dims.TRAVELLER_FIELDS, "name"))
    each = lambda of: F.when(F.col("family") == FLIGHT, of(*heads[0][2:])).when(F.col("family") == PERSON, of(*heads[1][2:]))
    rows = kv.withColumn("family", F.when(F.startswith(key, F.lit("flight_")), FLIGHT).when(F.startswith(key, F.lit("pax_")), PERSON))
    rows = rows.withColumn("after", F.when(F.col("family") == FLIGHT, F.substring(key, F.lit(8), F.length(key))).when(F.col("family") == PERSON, F.substring(key, F.lit(5), F.length(key))))
    rows = rows.withColumn("digits", F.substring_index(after, "_", 1))
    rows = rows.withColumns({"number": digits.try_cast("int"), "field": F.substring(after, F.length(digits) + 2, F.length(after))})
    plain = F.coalesce((F.col("number") >= 0) & (F.col("number").cast("string") == digits), F.lit(False))  # 01 names index 1, and is no key of its own
    rows = rows.withColumn("plain", plain)
    cell = F.when((F.col("family") == PERSON) & F.col("plain") & ~field.isin(*dims.TRAVELLER_FIELDS), field.rlike(CELL))
    rows = rows.withColumn("cell", F.coalesce(cell, F.lit(False)))
    owned = F.coalesce(each(lambda fields, anchor: (F.col("plain") & field.isin(*fields)) | ((field == anchor) & digits.rlike(r"^\d+$"))), F.lit(False)) | F.col("cell")
    rows = rows.withColumn("idx", F.coalesce(F.when(owned, F.col("number")), F.lit(-1)))
    wanted = key.isin(*FORM_FIELDS, *fares.PARTS) | (key.isin(*COUNTS.values()) & F.col("value").isNotNull())
    said = F.when(F.col("idx") < 0, F.when(wanted, key)).when(F.col("plain"), field).otherwise("")
    rows = rows.select("request_id", F.when(F.col("idx") < 0, OWN).otherwise(F.col("family")).alias("kind"), "idx", "cell", said.alias("field"), *[c for c in ("ord", "value") if c in kv.columns])
    entry = F.when(field.isNotNull(), F.struct("field", *[c for c in ("ord", "value") if c in kv.columns]))
    rows = rows.select("request_id", "kind", "idx", "cell", entry.alias("entry"))  # aggregates would make it without generated code
    sent = rows.groupBy("request_id", "kind", "idx").agg(F.collect_list("entry").alias("got"), F.max("cell").alias("has_cells"))
    repeated = F.size("got") > F.size(F.array_distinct("got.field"))
    first = F.filter("ranked", lambda x, i: (i == 0) | (x["field"] != F.get("ranked", i - 1)["field"]))
    sent = sent.withColumn("ranked", F.when(repeated, F.sort_array("got")))
    sent = sent.withColumn("got", F.when(F.col("ranked").isNull(), F.col("got")).otherwise(first))
    pairs = F.transform("got", lambda x: F.struct(x["field"], x["value"])) if "ord" in kv.columns else F.col("got")
    return sent.withColumn("got", pairs).select("request_id", "kind", "idx", "got", F.map_from_entries("got").alias("says"), "has_cells")


def _in_order(rows: str, count: Column, blanks: Column) -> Column:
    """The array's named structs by index; where there is none, ``count`` of them (one if
    absent or no number): what was sent for an index below it, else ``blanks``."""
    by_index = lambda a: F.array_sort(a, lambda x, y: x["idx"] - y["idx"])
    n = F.greatest(F.coalesce(blank_to_null(count).try_cast("int"), F.lit(1)), F.lit(0))
    sent = by_index(F.filter(rows, lambda x: x["idx"] < n))
    fill = lambda k: F.flatten(F.array_repeat(blanks, k.cast("int")))
    until = lambda a, i: F.coalesce(F.get(a, i)["idx"], n)
    after = lambda a: F.flatten(F.transform(a, lambda x, i: F.concat(F.array(x), fill(until(a, i + 1) - x["idx"] - 1))))
    counted = F.when(F.size(sent) == 0, fill(n)).otherwise(F.concat(fill(until(sent, F.lit(0))), after(sent)))
    return F.when(F.exists(rows, lambda x: x["named"]), by_index(F.filter(rows, lambda x: x["named"]))).otherwise(counted)


def bookings(kv: DataFrame, spark: SparkSession, airports: DataFrame, as_of: Column, tasks: int | None = None) -> DataFrame:
    """One nested record for each request: the form's own fields, ``flights`` and
    ``travellers`` as arrays of structs in their order, ``route``, the fare parts
    with ``total_fare`` and ``fare_lines``: all that printing a booking needs.

    A traveller without a document number gets one from the first flight's
    airline and a hash of request and place.  A request is one form, so its
    record is as large as what was sent for it.

    Keys are dealt once, by request (into ``tasks``, if given), and everything after that
    is made where they are; keys that are dealt so already are not moved."""
    kv = kv.select("request_id", *(["ord"] if "ord" in kv.columns else []), "key", "value")
    kv = kv.repartition(tasks, "request_id") if tasks else kv.repartition("request_id")
    sent = _sent(kv)
    says = lambda c: F.try_element_at("says", F.lit(c))
    named = lambda anchor: (F.map_contains_key("says", F.lit(anchor)) | F.map_contains_key("says", F.lit(""))).alias("named")
    is_flight = F.col("kind") == FLIGHT
    names = {dims.DOCUMENT_FIELD: "document_no"}
    fields = [names.get(c, c) for c in dims.TRAVELLER_FIELDS]
    # made beside a lambda, fields are read by small methods, not by one that is too long to be compiled
    own = F.map_from_entries(F.filter("got", lambda x: x["field"].rlike(CELL)))
    person = F.struct("idx", named("name"), *[text(says(c)).alias(names.get(c, c)) for c in dims.TRAVELLER_FIELDS], F.when(F.col("has_cells"), own).alias("own"))
    f = sent.select(
        "request_id", "idx", "kind", *[F.when(is_flight, says(c) if c in RAW else text(says(c))).alias(c) for c in FLIGHT_FIELDS],
        F.when(is_flight, named("flight_no")).alias("named"), F.when(F.col("kind") == PERSON, person).alias("person"), F.when(F.col("kind") == OWN, F.col("says")).alias("says"),
    )
    # rows of other kinds have no codes, so no airport joins them
    f = _timed(_described(f, spark, airports))
    blank = _timed(_described(spark.range(1).select(*[(F.lit(None).cast("string") if c in RAW else F.lit("")).alias(c) for c in FLIGHT_FIELDS]), spark, airports))
    rest = [c for c in blank.columns if c != "at"]
    f = f.select("request_id", F.when(is_flight, F.struct("idx", "named", "at", *rest)).alias("flight"), "person", "says")
    form = f.groupBy("request_id").agg(F.collect_list("flight").alias("flown"), F.collect_list("person").alias("people"), F.first("says", ignorenulls=True).alias("says"))
    nothing = F.struct(F.lit(None).cast("int").alias("idx"), F.lit(False).alias("named"), "at", *rest)
    form = form.join(F.broadcast(blank.agg(F.collect_list(nothing).alias("no_flight"))))  # one row
    nobody = F.array(F.struct(F.lit(None).cast("int").alias("idx"), F.lit(False).alias("named"), *[F.lit("").alias(c) for c in fields], F.lit(None).cast("map<string,string>").alias("own")))
    form = form.withColumns({"flown": _in_order("flown", says(COUNTS[FLIGHT]), F.col("no_flight")), "people": _in_order("people", says(COUNTS[PERSON]), nobody)})
    clock = lambda x: (x["at"]["departs"], x["at"]["arrives"])
    wait = lambda x, i: _wait(i == 0, x["manual_layover"], clock(F.get("flown", i - 1)), clock(x))
    flown = F.transform("flown", lambda x, i: F.struct(i.alias("position"), F.coalesce(x["idx"], i).alias("idx"), *[(wait(x, i) if c == "layover" else x[c]).alias(c) for c in rest]))
    form = form.select("request_id", *[F.coalesce(says(k), F.lit(FORM_FIELDS.get(k))).alias(k) for k in (*FORM_FIELDS, *fares.PARTS)], flown.alias("flights"), "people")
    made = F.transform("people", lambda p, i: F.struct(i.alias("pax"), F.coalesce(p["idx"], i).alias("idx"), *[p[c].alias(c) for c in fields], *_grid(p["own"], F.col("flights"))))
    form = form.withColumn("travellers", made).drop("people")
    form = form.withColumns({
        "customer_phone": strip(F.col("customer_phone")), "customer_email": strip(F.col("customer_email")), "is_dummy": F.col("is_dummy") == "true",
        "booking_date": booking_date_display(F.col("booking_date"), as_of), "refund_alert": no_refund(F.col("refund_status")),
    })
    form = fares.parsed_fares(form)
    out = form.withColumns({"total_fare": fares.total_fare(), "fare_lines": fares.printed_lines()})
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for row in dims.prefix_rows() for x in row]), text(F.get("flights", 0)["airline_code"]))
    out = out.withColumn("prefix", prefix)
    number = lambda x: first_filled(strip(x["document_no"]), document_number(F.col("prefix"), F.col("request_id"), x["pax"]))
    out = out.withColumn("travellers", F.transform("travellers", lambda x: x.withField("document_no", number(x)))).drop("prefix")
    first, last = F.get("flights", 0)["from_code"], F.try_element_at("flights", F.lit(-1))["to_code"]
    return out.withColumn("route", F.coalesce(F.concat(first, F.lit(" → "), last), F.lit("N/A")))


def _timed(f: DataFrame) -> DataFrame:
    """With seconds of departure and arrival."""
    return f.withColumn("at", F.struct(*[c.alias(n) for n, c in zip(("departs", "arrives"), _clock(F.col("date_raw"), F.col("dep_time_raw"), F.col("arr_time_raw")), strict=True)]))


def segment_pnrs(pnrs: Column) -> Column:
    """``Flight i: pnr`` for each that is given, joined by `` | ``."""
    lines = F.transform(pnrs, lambda x, i: F.when(text(x) != "", F.concat(F.lit("Flight "), (i + 1).cast("string"), F.lit(": "), x)))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), " | ")
