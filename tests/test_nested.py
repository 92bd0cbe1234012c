import pytest

from docweft import InvalidQueryError, LazyTable, UnsupportedError


def table(spark, rows, schema, **more):
    return LazyTable.from_df(spark.createDataFrame(rows, schema).coalesce(1), "t", **more)


def values(t):
    return [tuple(r) for r in t.collect()]


PARCEL = "no long, route struct<depot string, stop struct<floor int, weight double>>, tags array<string>"
ROWS = [(71, ("north", (3, 1.25)), ["frail"]), (72, ("south", (0, 8.5)), []), (73, None, None), (74, ("north", None), ["frail", "cold"]), (75, ("west", (9, None)), ["cold", None])]


@pytest.fixture(scope="module")
def parcels(spark):
    return table(spark, ROWS, PARCEL)


def test_dotted_names(parcels):
    assert parcels.schema_fields() == ["no", "route.depot", "route.stop.floor", "route.stop.weight", "tags"]
    heavy = parcels.filter("route.stop.weight > 1").select("route.stop.weight", "no")
    assert [(r.route.stop.weight, r.no) for r in heavy.collect()] == [(1.25, 71), (8.5, 72)]
    assert heavy.schema_fields() == ["route.stop.weight", "no"]
    flat = parcels.select("route.depot", parcel="no")
    assert flat.to_df().columns == ["route.depot", "parcel"]
    assert values(flat.filter("route.depot == 'west'")) == [("west", 75)]


def test_a_column_whose_name_has_a_dot(spark):
    t = table(spark, [("k", -3), ("m", 12)], "`unit.code` string, n int")
    assert values(t.select(code="unit.code", n="n").filter("n > 0")) == [("m", 12)]


def test_null_parents_stay_null(parcels):
    assert [r.route is None for r in parcels.select("route.depot").collect()] == [False, False, True, False, False]
    got = parcels.mutate(**{"route.stop.floor": "route.stop.floor * 10"}).collect()
    assert [r.route and r.route.stop and r.route.stop.floor for r in got] == [30, 0, None, None, 90]


def test_new_nested_fields(parcels):
    t = parcels.mutate(**{"route.code": "paste(route.depot, no, sep='/')"})
    assert t.schema_fields()[-1] == "route.code" and "route.code" not in t.to_df().columns
    assert [r.route and r.route.code for r in t.collect()] == ["north/71", "south/72", None, "north/74", "west/75"]
    raw = parcels.append_stage('{"$addFields": {"route.stop.grams": {"$multiply": ["$route.stop.weight", 1000]}, "route.seen.by": "$no"}}')
    first = raw.collect()[0].route
    assert (first.stop.grams, first.stop.floor, first.seen.by) == (1250.0, 3, 71)
    shown = parcels.append_stage('{"$project": {"route.depot": 1, "route.no": "$no"}}').collect()
    assert [(r.route and r.route.depot, r.route and r.route.no) for r in shown][0] == ("north", 71)


def test_flatten(parcels):
    t = parcels.flatten_fields()
    assert t.schema_fields() == ["no", "tags", "route.depot", "route.stop.floor", "route.stop.weight"]
    assert values(t.filter("route.stop.floor == 0")) == [(72, [], "south", 0, 8.5)]
    assert parcels.flatten_fields("route.stop").schema_fields() == ["no", "route.depot", "tags", "route.stop.floor", "route.stop.weight"]
    assert parcels.select("route").flatten_fields("route").schema_fields() == ["route.depot", "route.stop.floor", "route.stop.weight"]
    short = parcels.flatten_fields(names_fn=lambda names: [n[-3:] for n in names])
    assert short.schema_fields() == ["no", "tags", "pot", "oor", "ght"]


@pytest.mark.parametrize("names_fn", [lambda n: ["same"] * len(n), lambda n: n[1:], lambda n: [*n[1:], ""], lambda n: ["tags", *n[1:]], lambda n: "".join(n), lambda n: [7] * len(n)])
def test_flatten_names(parcels, names_fn):
    with pytest.raises(InvalidQueryError):
        parcels.flatten_fields(names_fn=names_fn)


def test_flatten_needs_nested_fields(spark, parcels):
    with pytest.raises(InvalidQueryError):
        table(spark, [("z",)], "only string").flatten_fields()
    with pytest.raises(InvalidQueryError):
        parcels.flatten_fields("route.missing")


def test_infer_schema(parcels):
    t = LazyTable.from_df(parcels.df, schema=["route.depot"])
    assert t.schema_fields() == ["route.depot"]
    assert t.infer_schema().schema_fields() == parcels.schema_fields()


def test_unwind(parcels):
    assert values(parcels.unwind_array("tags").select("no", "tags")) == [(71, "frail"), (74, "frail"), (74, "cold"), (75, "cold"), (75, None)]
    kept = parcels.unwind_array("tags", preserve_empty=True).select("no", "tags")
    assert values(kept) == [(71, "frail"), (72, None), (73, None), (74, "frail"), (74, "cold"), (75, "cold"), (75, None)]
    counts = parcels.unwind_array("tags").filter("tags == 'frail'").group_by("route.depot").summarise(n="n()")
    assert values(counts) == [("north", 2)]
    assert values(parcels.arrange("no").unwind_array("tags").slice_tail(3).select("no", "tags")) == [(74, "cold"), (75, "cold"), (75, None)]
    for bad in ({"name": "absent"}, {"name": "tags", "preserve_empty": "yes"}):
        with pytest.raises(InvalidQueryError):
            parcels.unwind_array(**bad)


def test_unwind_documents_and_deeper_arrays(spark):
    t = table(spark, [("p", [(5, "u"), (6, "v")], (("q", [8, 9]),)), ("r", [], (("s", []),))], "id string, lines array<struct<qty int, sku string>>, a struct<b struct<n string, v array<int>>>")
    assert values(t.select("id", "lines").unwind_array("lines").flatten_fields("lines")) == [("p", 5, "u"), ("p", 6, "v")]
    assert [(r.id, r.a.b.n, r.a.b.v) for r in t.unwind_array("a.b.v").collect()] == [("p", "q", 8), ("p", "q", 9)]
    assert [(r.id, r.a.b.v) for r in t.unwind_array("a.b.v", preserve_empty=True).collect()] == [("p", 8), ("p", 9), ("r", None)]


def test_unwind_scalar(parcels):
    assert len(values(parcels.unwind_array("route.depot"))) == 4
    assert len(values(parcels.unwind_array("route.depot", preserve_empty=True))) == 5


def test_group_by_nested_key(parcels):
    assert sorted(values(parcels.filter("~is_na(route.depot)").group_by("route.depot").summarise(n="n()"))) == [("north", 2), ("south", 1), ("west", 1)]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ('{"route.depot": {"$ne": "north"}}', [72, 73, 75]),
        ('{"route.depot": {"$nin": ["north", "west"]}}', [72, 73]),
        ('{"route.depot": null}', [73]),
        ('{"tags": "cold"}', [74, 75]),
        ('{"tags": {"$ne": "cold"}}', [71, 72, 73]),
        ('{"tags": {"$in": ["frail", null]}}', [71, 73, 74, 75]),
        ('{"tags": ["frail"]}', [71]),
        ('{"route.stop.weight": {"$gt": 1, "$lt": 2}}', [71]),
        ('{"$or": [{"no": 72}, {"route.stop.floor": {"$gte": 9}}]}', [72, 75]),
    ],
)
def test_query_form(parcels, query, expected):
    assert [r.no for r in parcels.append_stage('{"$match": %s}' % query).collect()] == expected


def test_query_form_is_checked(parcels):
    with pytest.raises(InvalidQueryError):
        parcels.append_stage('{"$match": {"no": {"$in": 3}}}').to_df()
    with pytest.raises(UnsupportedError):
        parcels.append_stage('{"$match": {"no": {"$regex": "7"}}}').to_df()
