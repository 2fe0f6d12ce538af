"""Queries of the multi-column, query, table, cross-table, referential and
geospatial checks."""

from __future__ import annotations

from plumbline.catalog.base import ag, chk, rp, vd
from plumbline.catalog.checks_rows import LABELLED, NULLS, SUMS, N, grouped
from plumbline.operators.checks.geospatial import COUNTRY_BOXES, ZONE_HOURS

ORDER_LINES = """select l.l_orderkey, l.l_quantity, l.l_extendedprice, l.l_shipdate, o.o_orderdate, o.o_totalprice,
 o.o_orderstatus, l.l_linestatus from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey"""


def multi_column() -> None:
    ab = "net is not null and l_extendedprice is not null"
    chk("ColumnComparison", SUMS, {"column_a": "net", "column_b": "l_extendedprice", "operator": "lt", "mostly": 0.5},
        rp("net,l_extendedprice", "net >= l_extendedprice", ab, mostly=0.5))
    chk("ColumnArithmetic", SUMS, {"column_a": "l_extendedprice", "column_b": "l_discount", "result_column": "cut", "operation": "multiply"},
        rp("l_extendedprice,l_discount,cut", "abs(l_extendedprice * l_discount - cut) > 0.0001", "cut is not null"))
    chk("ColumnArithmetic", SUMS, {"column_a": "cut", "column_b": "l_discount", "result_column": "l_extendedprice", "operation": "divide"},
        rp("cut,l_discount,l_extendedprice", "l_discount = 0 or abs(cut / l_discount - l_extendedprice) > 0.0001", "cut is not null"),
        key="check_ColumnArithmetic_divide")
    chk("ColumnSum", SUMS, {"columns": ["net", "cut"], "target_column": "l_extendedprice"},
        rp("net,cut,l_extendedprice", "abs(net + cut - l_extendedprice) > 0.0001", ab))
    chk("ColumnRatio", SUMS, {"numerator_column": "l_extendedprice", "denominator_column": "l_quantity", "min_ratio": 900, "max_ratio": 3000},
        rp("l_extendedprice,l_quantity", "not (l_extendedprice / l_quantity between 900 and 3000)", "l_quantity <> 0"))
    chk("ColumnCorrelation", "lineitem", {"column_a": "l_quantity", "column_b": "l_extendedprice", "min_correlation": 0.1},
        ag("l_quantity,l_extendedprice", "corr(l_quantity, l_extendedprice)", "v >= 0.1"))
    chk("ColumnDependency", "customer", {"determinant_column": "c_nationkey", "dependent_column": "c_mktsegment"},
        vd("c_nationkey,c_mktsegment", "count(*) filter (where n > 1)", "count(*)",
           frm="(select count(distinct c_mktsegment) n from data where c_nationkey is not null and c_mktsegment is not null group by c_nationkey) g"))
    chk("Conditional", "orders", {"when_column": "o_orderstatus", "when_value": "P", "then_column": "o_totalprice", "then_operator": "gt", "then_value": 50000},
        rp("o_orderstatus,o_totalprice", "o_totalprice <= 50000", "o_orderstatus = 'P'"))
    chk("Conditional", "orders", {"when_column": "o_orderstatus", "when_value": "O", "then_column": "o_orderpriority", "then_operator": "in_set", "then_value": ["1-URGENT", "2-HIGH"]},
        rp("o_orderstatus,o_orderpriority", "o_orderpriority not in ('1-URGENT', '2-HIGH')", "o_orderstatus = 'O'"), key="check_Conditional_in_set")
    chk("ColumnChainComparison", SUMS, {"columns": ["cut", "net", "l_extendedprice"], "operator": "lt"},
        rp("cut,net,l_extendedprice", "not (cut < net and net < l_extendedprice)", "cut is not null and " + ab))
    chk("ColumnConsistency", "nation", {"columns": ["n_regionkey"], "group_by": ["n_name"]},
        vd("n_regionkey", "count(*) filter (where n > 1)", "count(*)", frm="(select count(*) n from (select distinct n_name, n_regionkey from data) d group by n_name) g"))
    some = "((bal is not null)::int + (nat is not null)::int + (nm is not null)::int)"
    chk("MutualExclusivity", NULLS, {"columns": ["bal", "nat", "nm"]}, rp("bal,nat,nm", f"{some} > 1", every=True))
    chk("ColumnCoexistence", NULLS, {"columns": ["bal", "nm"]}, rp("bal,nm", "(bal is null) <> (nm is null)", every=True))
    chk("ColumnImplication", NULLS, {"antecedent_column": "nm", "antecedent_condition": "is not null", "consequent_column": "bal", "consequent_condition": "> 0"},
        rp("nm,bal", "bal <= 0", "nm is not null"))
    wide = "select l_quantity as a, l_discount * 1000 as b, l_tax * 500 as c, greatest(l_quantity, l_discount * 1000) as hi, least(l_quantity, l_tax * 500) as lo, l_quantity * l_discount as p from {lineitem}"
    abc = "a is not null and b is not null and c is not null"
    chk("ColumnMax", wide, {"max_column": "hi", "source_columns": ["a", "b", "c"]}, rp("hi,a,b,c", "hi <> greatest(a, b, c)", abc))
    chk("ColumnMin", wide, {"min_column": "lo", "source_columns": ["a", "b", "c"]}, rp("lo,a,b,c", "lo <> least(a, b, c)", abc))
    chk("ColumnMean", wide, {"columns": ["a", "b", "c"], "min_value": 10, "max_value": 40}, rp("a,b,c", "(a + b + c) / 3 not between 10 and 40", abc))
    chk("ColumnVariance", wide, {"columns": ["a", "b"], "max_variance": 500}, rp("a,b", "(power(a - (a + b) / 2, 2) + power(b - (a + b) / 2, 2)) > 500", "a is not null and b is not null"))
    chk("ColumnCovariance", "lineitem", {"column_a": "l_quantity", "column_b": "l_discount", "max_covariance": 1},
        ag("l_quantity,l_discount", "covar_samp(l_quantity, l_discount)", "v <= 1"))
    chk("ColumnProduct", SUMS, {"columns": ["l_extendedprice", "l_discount"], "target_column": "cut"},
        rp("l_extendedprice,l_discount,cut", "abs(l_extendedprice * l_discount - cut) > 0.0001", "cut is not null"))
    chk("ColumnDifference", SUMS, {"column_a": "l_extendedprice", "column_b": "net", "min_difference": 10, "max_difference": 5000},
        rp("l_extendedprice,net", "l_extendedprice - net not between 10 and 5000", ab))
    chk("ColumnPercentage", SUMS, {"numerator_column": "cut", "denominator_column": "l_extendedprice", "expected_percentage": 5, "tolerance": 4.5},
        rp("cut,l_extendedprice", "abs(100 * cut / l_extendedprice - 5) > 4.5", "l_extendedprice <> 0"))


def query() -> None:
    chk("Expression", "lineitem", {"expression": "l_extendedprice > 0 AND l_discount < 0.1"},
        rp(None, "not (l_extendedprice > 0 and l_discount < 0.1)", every=True))
    chk("CustomExpression", "lineitem", {"expression_str": "l_quantity * 2 <= 98"}, rp(None, "l_quantity * 2 > 98", every=True))
    chk("QueryRowCount", "orders", {"filter_expression": "o_orderstatus = 'P'", "max_count": 100},
        ag(None, "count(*) filter (where o_orderstatus = 'P')", "v <= 100"))
    chk("QueryReturnsNoRows", "orders", {"filter_expression": "o_totalprice > 400000"}, rp(None, "o_totalprice > 400000", every=True))
    chk("QueryReturnsRows", "events", {"filter_expression": "event_type = 'purchase'", "min_rows": 5},
        ag(None, "count(*) filter (where event_type = 'purchase')", "v >= 5"))
    chk("QueryAggregate", "events", {"column": "value", "aggregate": "mean", "filter_expression": "event_type = 'click'", "min_value": 0},
        ag("value", "avg(value) filter (where event_type = 'click')", "v >= 0"))
    chk("QueryGroupAggregate", "events", {"column": "value", "group_by": ["user_id"], "aggregate": "max", "max_value": 90},
        vd("value", "count(*) filter (where m > 90)", "count(*)", frm="(select max(value) m from data group by user_id) g"))
    chk("QueryAggregateCompare", "lineitem", {"column": "l_quantity", "filter_a": "l_returnflag = 'A'", "filter_b": "l_returnflag = 'R'", "aggregate": "sum", "operator": "gt"},
        ag("l_quantity", "sum(l_quantity) filter (where l_returnflag = 'A') - sum(l_quantity) filter (where l_returnflag = 'R')", "v > 0"))
    chk("QueryColumnValues", "lineitem", {"column": "l_linestatus", "filter_expression": "l_returnflag = 'N'", "expected_values": ["O"]},
        rp("l_linestatus", "l_linestatus not in ('O')", "l_returnflag = 'N' and l_linestatus is not null"))
    chk("QueryColumnUnique", "orders", {"column": "o_custkey", "filter_expression": "o_orderpriority = '1-URGENT'"},
        vd("o_custkey", "coalesce(sum(n) filter (where n > 1), 0)", "coalesce(sum(n), 0)", frm=grouped("o_custkey", "o_orderpriority = '1-URGENT' and o_custkey is not null")))
    chk("QueryColumnNotNull", LABELLED, {"column": "quality", "filter_expression": "lang = 'en'"}, rp("quality", "quality is null", "lang = 'en'"))
    chk("ConditionalExpression", "lineitem", {"condition": "l_returnflag = 'R'", "expression": "l_quantity < 45"},
        rp(None, "l_quantity >= 45", "l_returnflag = 'R'"))
    chk("MultiCondition", "lineitem", {"conditions": ["l_quantity > 40", "l_discount > 0.08", "l_tax > 0.07"], "mode": "none"},
        rp(None, "l_quantity > 40 or l_discount > 0.08 or l_tax > 0.07", every=True))
    chk("RowLevel", "lineitem", {"expression": "l_quantity >= 10", "min_pass_ratio": 0.9},
        ag(None, "avg(case when l_quantity >= 10 then 1 else 0 end)", "v >= 0.9"))
    chk("SQLQuery", "lineitem", {"query": "select l_orderkey, sum(l_quantity) q from data group by l_orderkey having sum(l_quantity) > 250"},
        vd(None, "count(*)", "greatest(count(*), 1)", v="count(*)", frm="(select l_orderkey from data group by l_orderkey having sum(l_quantity) > 250) g"))
    chk("BusinessRule", ORDER_LINES, {"rule_name": "ship_after_order", "rule_expression": "l_shipdate >= o_orderdate"},
        rp("ship_after_order", "l_shipdate < o_orderdate", every=True))


def table() -> None:
    one = {"frm": "(select 1) x"}
    chk("TableNotEmpty", "events", {}, ag(None, "count(*)", "v >= 1"))
    chk("TableRowCountRange", "events", {"min_rows": 10, "max_rows": 500}, ag(None, "count(*)", "v between 10 and 500"))
    chk("TableRowCountExact", "nation", {"expected_rows": 24, "tolerance": 1}, ag(None, "count(*)", "v between 23 and 25"))
    chk("TableColumnCount", "events", {"expected_count": 6}, vd(None, "0", "1", v="6", **one))
    chk("TableRequiredColumns", "events", {"required_columns": ["event_id", "session_id"]}, vd(None, "1", "2", **one))
    chk("TableForbiddenColumns", "events", {"forbidden_columns": ["password", "props"]}, vd(None, "1", "2", **one))
    chk("TableFreshness", "events", {"datetime_column": "ts", "max_age_hours": 24},
        ag("ts", "(epoch(timestamp '2024-02-01') - epoch(max(ts))) / 3600.0", "v <= 24"), as_of="2024-02-01 00:00:00")
    chk("TableDataRecency", "orders", {"datetime_column": "o_orderdate", "max_age_days": 30},
        ag("o_orderdate", "(epoch(timestamp '2001-09-01') - epoch(max(o_orderdate))) / 86400.0", "v <= 30"), as_of="2001-09-01 00:00:00")
    chk("TableUpdateFrequency", "events", {"datetime_column": "ts", "expected_frequency": "hourly", "tolerance_periods": 0},
        vd("ts", "count(*) filter (where h - p > 1)", "greatest(count(*) - 1, 0)",
           frm="(select h, lag(h) over (order by h) p from (select distinct floor(epoch(ts) / 3600) h from data) d) w"))
    chk("TableSchemaMatch", "events", {"expected_schema": {"event_id": "Int64", "ts": "Datetime", "value": "Float32"}}, vd(None, "1", "3", **one))
    chk("TableColumnTypes", "events", {"expected_types": {"event_id": "Int64", "props": "Int32"}}, vd("event_id", "0", "1", **one), vd("props", "1", "1", **one))
    chk("TableMemorySize", "events", {"max_size_mb": 1},
        ag(None, "sum(8 + 8 + 8 + 8 + strlen(event_type) + strlen(props)) / 1048576.0", "v <= 1"))
    chk("TableDimensions", "customer", {"min_rows": 10, "max_cols": 4}, vd(None, "1", "1", "false", "count(*)"))
    chk("TableRowToColumnRatio", "customer", {"min_ratio": 100}, ag(None, "count(*) / 5.0", "v >= 100"))
    chk("TablePartitionCoverage", "events", {"partition_column": "event_type", "expected_partitions": ["view", "click", "refund"], "min_rows_per_partition": 5},
        vd("event_type", "3 - count(*) filter (where n >= 5 and event_type in ('view','click','refund'))", "3", frm=grouped("event_type", "event_type is not null")))
    chk("TableNullRatio", LABELLED, {"max_null_ratio": 0.2},
        ag(None, "(count(*) - count(quality) + count(*) - count(toxic)) / (count(*) * 6.0)", "v <= 0.2"))
    chk("TableDuplicateRatio", "lineitem", {"columns": ["l_partkey", "l_suppkey"]},
        ag("l_partkey,l_suppkey", "sum(n - 1) * 1.0 / sum(n)", "v <= 0.01", grouped("l_partkey, l_suppkey")))


# Parents over whole tables; some keys are shifted out of the way, so that children miss them.
ASIA = "select case when n_regionkey in (1, 2) then n_nationkey else n_nationkey + 1000 end as n_nationkey from {nation}"
GOOD_LINES = "select case when l_quantity > 1 then l_partkey else -l_partkey - 1 end as l_partkey, l_suppkey from {lineitem}"


def cross_table() -> None:
    chk("ForeignKey", "lineitem", {"column": "l_orderkey", "reference_source_id": "r", "reference_column": "o_orderkey"},
        rp("l_orderkey", "l_orderkey not in (select o_orderkey from r)"), refs={"r": "select case when o_orderstatus = 'P' then -o_orderkey - 1 else o_orderkey end as o_orderkey from {orders}"})
    chk("CompositeForeignKey", "lineitem", {"columns": ["l_partkey", "l_suppkey"], "reference_source_id": "r", "reference_columns": ["l_partkey", "l_suppkey"]},
        rp("l_partkey,l_suppkey", "(l_partkey, l_suppkey) not in (select (l_partkey, l_suppkey) from r)", "l_partkey is not null and l_suppkey is not null"), refs={"r": GOOD_LINES})
    chk("Orphan", NULLS, {"column": "nat", "reference_source_id": "r", "reference_column": "n_nationkey", "ignore_null": False},
        rp("nat", "nat is null or nat not in (select n_nationkey from r)", every=True), refs={"r": ASIA})
    chk("CrossTableRowCount", "lineitem", {"reference_source_id": "r", "operator": "gt"},
        ag(None, "count(*) - (select count(*) from r)", "v > 0"), refs={"r": "select * from {orders}"})
    chk("CrossTableAggregate", "lineitem", {"column": "l_quantity", "reference_source_id": "r", "aggregate": "mean", "operator": "eq", "tolerance": 1.0},
        ag("l_quantity", "avg(l_quantity) - (select avg(l_quantity) from r)", "abs(v) <= 1.0"), refs={"r": "select l_quantity * (case when l_returnflag = 'A' then 1.02 else 1.0 end) as l_quantity from {lineitem}"})
    chk("CrossTableAggregate", "lineitem", {"column": "l_extendedprice", "reference_source_id": "r", "aggregate": "median", "operator": "gte"},
        ag("l_extendedprice", "median(l_extendedprice) - (select median(l_extendedprice) from r)", "v >= 0"),
        refs={"r": "select case when l_returnflag = 'R' then l_extendedprice * 1.1 else l_extendedprice end as l_extendedprice from {lineitem}"}, key="check_CrossTableAggregate_median")
    only = "(select count(*) from (select distinct o_custkey from data except select c_custkey from r) x)"
    shared = "(select count(*) from (select distinct o_custkey from data intersect select c_custkey from r) x)"
    every = "(select count(*) from (select o_custkey from data union select c_custkey from r) x)"
    chk("CrossTableDistinct", "orders", {"column": "o_custkey", "reference_source_id": "r", "reference_column": "c_custkey", "operator": "subset"},
        vd("o_custkey", only, every, v=shared, frm="(select 1) x"), refs={"r": "select case when c_acctbal > 0 then c_custkey else -c_custkey - 1 end as c_custkey from {customer}"})
    chk("CrossTableSchema", "customer", {"reference_source_id": "r", "strict": True}, vd(None, "2", "4", frm="(select 1) x"),
        refs={"r": "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal from {customer}"})
    chk("JoinIntegrity", "orders", {"column": "o_custkey", "reference_source_id": "r", "reference_column": "c_custkey", "expected_cardinality": "one_to_one"},
        vd("o_custkey", "count(*) filter (where n > 1)", "count(*)", frm="(select count(*) n from data where o_custkey in (select c_custkey from r) group by o_custkey) g"),
        refs={"r": "select c_custkey from {customer}"})


EDGES = "select c_custkey as id, case when c_custkey = 0 then null else cast(floor(c_custkey / 2) as bigint) end as parent from {customer}"
# Every id below 70 steps to the next of its ring of seven; others climb by thirds.
RINGS = """select c_custkey as id, case when c_custkey < 70 then (case when c_custkey % 7 = 6 then c_custkey - 6 else c_custkey + 1 end)
 else cast(floor(c_custkey / 3) as bigint) end as parent from {customer}"""
WALK = """walk(id, up, d) as (select id, parent, 0 from data union all
 select w.id, e.parent, w.d + 1 from walk w join data e on w.up = e.id where w.d < 20)"""


def referential() -> None:
    chk("referential.ForeignKey", "orders", {"column": "o_custkey", "reference_source": "r", "reference_column": "c_custkey"},
        rp("o_custkey", "o_custkey not in (select c_custkey from r)"), refs={"r": "select case when c_mktsegment = 'BUILDING' then -c_custkey - 1 else c_custkey end as c_custkey from {customer}"})
    chk("referential.CompositeForeignKey", "lineitem", {"columns": ["l_partkey", "l_suppkey"], "reference_source": "r", "reference_columns": ["l_partkey", "l_suppkey"]},
        rp("l_partkey,l_suppkey", "(l_partkey, l_suppkey) not in (select (l_partkey, l_suppkey) from r)", "l_partkey is not null and l_suppkey is not null"), refs={"r": GOOD_LINES})
    chk("SelfReferentialFK", RINGS, {"column": "parent", "reference_column": "id"}, rp("parent", "parent not in (select id from data)"))
    chk("OrphanRecord", "supplier", {"column": "s_nationkey", "reference_source": "r", "reference_column": "n_nationkey"},
        rp("s_nationkey", "s_nationkey not in (select n_nationkey from r)"), refs={"r": ASIA})
    chk("DanglingReference", "orders", {"column": "o_custkey", "reference_source": "r", "reference_column": "c_custkey", "deleted_when": "c_acctbal < 0"},
        rp("o_custkey", "o_custkey not in (select c_custkey from r where not c_acctbal < 0)"), refs={"r": "select * from {customer}"})
    chk("CircularReference", RINGS, {"id_column": "id", "parent_column": "parent"},
        vd("id,parent", "(select count(distinct id) from walk where d < 20 and up = id)", "count(*)"), recursive=WALK)
    chk("HierarchyDepth", EDGES, {"id_column": "id", "parent_column": "parent", "max_depth": 6},
        vd("id,parent", "count(*) filter (where m > 6)", "count(*)", frm="(select id, max(d) m from walk group by id) g"), recursive=WALK)
    chk("CascadeIntegrity", NULLS, {"column": "nat", "reference_source": "r", "reference_column": "n_nationkey", "action": "cascade"},
        rp("nat", "nat is null or nat not in (select n_nationkey from r)", every=True), refs={"r": ASIA})
    chk("MultiTableOrphan", "customer", {"column": "c_nationkey", "reference_sources": ["a", "b"], "reference_columns": ["n_nationkey", "s_nationkey"]},
        rp("c_nationkey", "c_nationkey not in (select n_nationkey from a) and c_nationkey not in (select s_nationkey from b)"),
        refs={"a": ASIA, "b": "select case when s_acctbal > 5000 then s_nationkey else s_nationkey + 1000 end as s_nationkey from {supplier}"})


GEO = """select c_custkey, cast(c_custkey % 181 - 90 as double) as lat, cast(c_custkey % 361 - 180 as double) as lon,
 cast(c_custkey % 171 - 85 as double) as lat2, cast(c_custkey % 353 - 176 as double) as lon2, c_acctbal as alt,
 case when c_custkey % 3 = 0 then 'UTC' when c_custkey % 3 = 1 then 'Asia/Tokyo' else 'America/New_York' end as tz from {customer}"""
TRACK = """select event_id, user_id, ts, cast(event_id % 61 as double) / 10 as lat, cast(event_id % 53 as double) / 10 as lon from {events}"""


def km(a: str, b: str, c: str, d: str) -> str:
    h = (f"power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
         f"power(sin((radians({d}) - radians({b})) / 2), 2)")
    return f"(2 * 6371.0 * asin(sqrt(least({h}, 1.0))))"


def geospatial() -> None:
    both = "lat is not null and lon is not null"
    chk("Latitude", "select c_acctbal / 100 as lat from {customer}", {"column": "lat"}, rp("lat", "lat not between -90 and 90"))
    chk("Longitude", "select c_acctbal / 50 as lon from {customer}", {"column": "lon"}, rp("lon", "lon not between -180 and 180"))
    chk("Coordinate", "select c_acctbal / 100 as lat, c_acctbal / 50 as lon from {customer}", {"lat_column": "lat", "lon_column": "lon"},
        rp("lat,lon", "lat not between -90 and 90 or lon not between -180 and 180", both))
    chk("CoordinateNotNullIsland", GEO, {"lat_column": "lat", "lon_column": "lon", "tolerance": 5.0}, rp("lat,lon", "abs(lat) <= 5 and abs(lon) <= 5", both))
    chk("GeoDistance", GEO, {"lat_column_a": "lat", "lon_column_a": "lon", "lat_column_b": "lat2", "lon_column_b": "lon2", "max_distance_km": 5000.5},
        rp("lat,lon", f"{km('lat', 'lon', 'lat2', 'lon2')} > 5000.5", both))
    chk("GeoDistanceFromPoint", GEO, {"lat_column": "lat", "lon_column": "lon", "reference_lat": 48.2, "reference_lon": 16.37, "max_distance_km": 8000},
        rp("lat,lon", f"{km('lat', 'lon', '48.2', '16.37')} > 8000", both))
    chk("GeoBoundingBox", GEO, {"lat_column": "lat", "lon_column": "lon", "min_lat": -50, "max_lat": 50, "min_lon": 100, "max_lon": -100},
        rp("lat,lon", "not (lat between -50 and 50 and (lon >= 100 or lon <= -100))", both))
    a, b, c, d = COUNTRY_BOXES["CN"]
    chk("GeoCountry", GEO, {"lat_column": "lat", "lon_column": "lon", "country_code": "CN"},
        rp("lat,lon", f"not (lat between {a} and {b} and lon between {c} and {d})", both))
    # A triangle, as three half planes.
    chk("GeoPolygon", GEO, {"lat_column": "lat", "lon_column": "lon", "polygon": [[[-100.3, -50.7], [120.9, -40.1], [10.2, 70.4]]]},
        rp("lat,lon", "not ((120.9 + 100.3) * (lat + 50.7) - (-40.1 + 50.7) * (lon + 100.3) >= 0 and (10.2 - 120.9) * (lat + 40.1) - (70.4 + 40.1) * (lon - 120.9) >= 0 "
           "and (-100.3 - 10.2) * (lat - 70.4) - (-50.7 - 70.4) * (lon - 10.2) >= 0)", both))
    side = 2.0 * 500 / 111.195
    cells = (f"(select cy, cx, points, max({km('lat', 'lon', 'clat', 'clon')}) radius from (select *, floor(lat / {side!r}) cy, floor(lon / {side!r}) cx, "
             f"avg(lat) over w clat, avg(lon) over w clon, count(*) over w points from data window w as (partition by floor(lat / {side!r}), floor(lon / {side!r}))) x group by cy, cx, points) g")
    chk("GeoCluster", GEO, {"lat_column": "lat", "lon_column": "lon", "max_cluster_radius_km": 500, "min_points_per_cluster": 2},
        vd("lat,lon", "count(*) filter (where points < 2 or radius > 500)", "count(*)", frm=cells))
    w = "window w as (partition by user_id order by ts, lat, lon)"
    steps = (f"(select {km('plat', 'plon', 'lat', 'lon')} dist, (epoch_us(ts) - epoch_us(pts)) / 3600e6 as hours from (select *, lag(lat) over w plat, lag(lon) over w plon, "
             f"lag(ts) over w pts from data {w}) x where pts is not null) g")
    chk("GeoSpeed", TRACK, {"lat_column": "lat", "lon_column": "lon", "timestamp_column": "ts", "max_speed_kmh": 50, "entity_column": "user_id"},
        vd("lat,lon", "count(*) filter (where case when hours > 0 then dist / hours > 50 else dist > 0 end)", "count(*)", frm=steps))
    chk("GeoAltitude", GEO, {"column": "alt", "min_altitude": 0, "max_altitude": 8848}, rp("alt", "alt not between 0 and 8848"))
    off = "case tz when 'UTC' then 0 when 'Asia/Tokyo' then 9 else -5 end"
    assert ZONE_HOURS["Asia/Tokyo"] == 9 and ZONE_HOURS["America/New_York"] == -5
    chk("GeoTimezone", GEO, {"lat_column": "lat", "lon_column": "lon", "timezone_column": "tz"},
        rp("tz", f"abs(round(lon / 15.0) - ({off})) > 1", both))


for part in (multi_column, query, table, cross_table, referential, geospatial):
    part()
