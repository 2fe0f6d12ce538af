"""Queries of the schema, completeness, uniqueness, distribution, string,
datetime and aggregate checks."""

from __future__ import annotations

from plumbline.catalog.base import ag, chk, rp, vd
from plumbline.functions import patterns as P

NULLS = """select c_custkey, case when c_custkey % 7 = 0 then null else c_acctbal end as bal,
 case when c_custkey % 5 = 0 then null else c_nationkey end as nat,
 case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then '   ' else c_mktsegment end as seg,
 case when c_custkey % 7 = 0 or c_custkey % 3 = 0 then null else c_name end as nm from {customer}"""
LABELLED = """select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
 from {documents} d left join {labels} l on d.doc_id = l.doc_id"""
SUMS = """select l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * l_discount as cut,
 l_extendedprice - l_extendedprice * l_discount as net from {lineitem}"""
N = "select * from {nation}"


def schema() -> None:
    one = dict(frm="(select 1) x")
    chk("ColumnExists", "orders", {"columns": ["o_orderkey", "o_comment"]},
        vd("o_orderkey", "0", "1", **one), vd("o_comment", "1", "1", **one))
    chk("ColumnNotExists", "customer", {"columns": ["c_phone", "c_name"]},
        vd("c_phone", "0", "1", **one), vd("c_name", "1", "1", **one))
    chk("ColumnCount", "lineitem", {"min_count": 5, "max_count": 11},
        vd(None, "count(*) not between 5 and 11", "1", "bad = 0", "count(*)",
           "information_schema.columns where table_name = 'lineitem'") | {"bad": "cast(count(*) not between 5 and 11 as int)"})
    chk("RowCount", "lineitem", {"min_count": 1000}, ag(None, "count(*)", "v >= 1000"))
    chk("ColumnType", "orders", {"column": "o_orderdate", "expected_type": "Datetime"}, vd("o_orderdate", "0", "1", **one))
    chk("ColumnOrder", "nation", {"expected_order": ["n_name", "n_nationkey"]}, vd(None, "1", "1", **one))
    chk("TableSchema", "region", {"schema": {"r_regionkey": "Int32", "r_name": "Int64", "r_note": "String"}, "strict": True},
        vd(None, "2", "3", **one))
    chk("ColumnPair", SUMS, {"column_a": "net", "column_b": "l_extendedprice", "relationship": "less"},
        rp("net,l_extendedprice", "not (net < l_extendedprice)", "net is not null and l_extendedprice is not null"))
    chk("MultiColumnUnique", "lineitem", {"columns": ["l_orderkey", "l_linenumber"]},
        vd("l_orderkey,l_linenumber", "coalesce(sum(n) filter (where n > 1), 0)", "sum(n)",
           frm="(select count(*) n from data group by l_orderkey, l_linenumber) g"))
    chk("ReferentialIntegrity", "customer", {"column": "c_nationkey", "reference_source_id": "r", "reference_column": "n_nationkey"},
        rp("c_nationkey", "c_nationkey not in (select n_nationkey from r)"), refs={"r": N + " where n_regionkey < 3"})
    chk("MultiColumnSum", "select l_discount, l_tax from {lineitem}", {"columns": ["l_discount", "l_tax"], "expected_sum": 0.1},
        rp("l_discount,l_tax", "abs(l_discount + l_tax - 0.1) > 0.0001", "l_discount is not null and l_tax is not null"))
    chk("MultiColumnCalculation", SUMS, {"expression": "l_extendedprice - cut - net"},
        rp(None, "abs(l_extendedprice - cut - net) > 0.0001", "l_extendedprice - cut - net is not null"))
    pairs = [["A", "F"], ["R", "F"], ["N", "O"]]
    chk("ColumnPairInSet", "lineitem", {"column_a": "l_returnflag", "column_b": "l_linestatus", "valid_pairs": pairs},
        rp("l_returnflag,l_linestatus", "(l_returnflag, l_linestatus) not in (('A','F'),('R','F'),('N','O'))",
           "l_returnflag is not null and l_linestatus is not null"))
    chk("ColumnPairNotInSet", "lineitem", {"column_a": "l_returnflag", "column_b": "l_linestatus", "forbidden_pairs": [["N", "F"]]},
        rp("l_returnflag,l_linestatus", "l_returnflag = 'N' and l_linestatus = 'F'",
           "l_returnflag is not null and l_linestatus is not null"))


def completeness() -> None:
    chk("Null", LABELLED, {"columns": ["quality", "lang"], "mostly": 0.5},
        rp("quality", "quality is null", mostly=0.5, every=True), rp("lang", "lang is null", mostly=0.5, every=True))
    chk("NotNull", NULLS, {"column": "bal"}, rp("bal", "bal is null", every=True))
    chk("CompletenessRatio", NULLS, {"column": "nat", "min_ratio": 0.75}, ag("nat", "count(nat) * 1.0 / count(*)", "v >= 0.75"))
    chk("EmptyString", NULLS, {"columns": ["seg"]}, rp("seg", "seg = ''"))
    chk("WhitespaceOnly", NULLS, {"columns": ["seg", "nm"]}, rp("seg", "length(seg) > 0 and trim(seg) = ''"),
        rp("nm", "length(nm) > 0 and trim(nm) = ''"))
    chk("ConditionalNull", NULLS, {"column": "bal", "condition": "nat > 10"}, rp("bal", "bal is null", "nat > 10"))
    chk("DefaultValue", "customer", {"column": "c_mktsegment", "default_values": ["BUILDING", "N/A"]},
        rp("c_mktsegment", "c_mktsegment in ('BUILDING', 'N/A')"))
    chk("RequiredFields", NULLS, {"columns": ["seg", "bal"]},
        rp("seg,bal", "seg is null or trim(seg) = '' or bal is null", every=True))
    chk("ConditionalRequired", NULLS, {"column": "bal", "when_column": "seg", "when_value": "BUILDING"},
        rp("bal", "bal is null", "seg = 'BUILDING'"))
    chk("MutualCompleteness", LABELLED, {"columns": ["quality", "toxic"]},
        rp("quality,toxic", "(quality is null) <> (toxic is null)", every=True))
    chk("AtLeastOneNotNull", NULLS, {"columns": ["bal", "nat", "nm"]},
        rp("bal,nat,nm", "coalesce(bal, nat) is null and nm is null", every=True))
    chk("ExactlyOneNotNull", NULLS, {"columns": ["bal", "nm"]},
        rp("bal,nm", "(case when bal is null then 0 else 1 end + case when nm is null then 0 else 1 end) <> 1", every=True))


def grouped(keys: str, where: str = "true") -> str:
    return f"(select {keys}, count(*) n from data where {where} group by all) g"


def uniqueness() -> None:
    dup, total = "coalesce(sum(n) filter (where n > 1), 0)", "coalesce(sum(n), 0)"
    chk("Unique", "orders", {"column": "o_custkey", "mostly": 0.1},
        vd("o_custkey", dup, total, "(total - bad) >= 0.1 * total", frm=grouped("o_custkey", "o_custkey is not null")))
    chk("UniqueRatio", "lineitem", {"column": "l_partkey", "min_ratio": 0.5},
        ag("l_partkey", "count(distinct l_partkey) * 1.0 / count(l_partkey)", "v >= 0.5"))
    chk("DistinctCount", "orders", {"column": "o_custkey", "min_count": 10, "max_count": 100000},
        ag("o_custkey", "count(distinct o_custkey)", "v between 10 and 100000"))
    chk("Duplicate", "lineitem", {"columns": ["l_orderkey", "l_partkey"]},
        vd("l_orderkey,l_partkey", dup, total, frm=grouped("l_orderkey, l_partkey")))
    chk("DuplicateWithinGroup", "lineitem", {"column": "l_linenumber", "group_by": ["l_orderkey"]},
        vd("l_linenumber", dup, total, frm=grouped("l_orderkey, l_linenumber")))
    chk("PrimaryKey", NULLS, {"column": "nat"},
        vd("nat", "coalesce(sum(n) filter (where nat is null or n > 1), 0)", total, frm=grouped("nat")))
    chk("CompoundKey", "lineitem", {"columns": ["l_orderkey", "l_linenumber"]},
        vd("l_orderkey,l_linenumber", dup, total, frm=grouped("l_orderkey, l_linenumber")))
    chk("DistinctValuesInSet", "documents", {"column": "lang", "value_set": ["en", "fr"]},
        vd("lang", "count(*) filter (where lang not in ('en','fr'))", "count(*)", frm=grouped("lang", "lang is not null")))
    chk("DistinctValuesEqualSet", "documents", {"column": "lang", "value_set": ["en", "fr", "de", "it"]},
        vd("lang", "count(*) filter (where lang not in ('en','fr','de','it')) + 4 - count(*) filter (where lang in ('en','fr','de','it'))",
           "count(*) + 4 - count(*) filter (where lang in ('en','fr','de','it'))", frm=grouped("lang", "lang is not null")))
    chk("DistinctValuesContainSet", "documents", {"column": "lang", "required_values": ["en", "it"]},
        vd("lang", "2 - count(*) filter (where lang in ('en','it'))", "2", frm=grouped("lang", "lang is not null")))
    chk("DistinctCountBetween", "part", {"column": "p_brand", "min_count": 1, "max_count": 10},
        ag("p_brand", "count(distinct p_brand)", "v between 1 and 10"))
    chk("UniqueWithinRecord", "select l_linenumber, cast(l_quantity as int) as qty, cast(l_suppkey as int) as supp from {lineitem}",
        {"columns": ["l_linenumber", "qty", "supp"]},
        rp("l_linenumber,qty,supp", "l_linenumber = qty or l_linenumber = supp or qty = supp", every=True))
    chk("AllColumnsUniqueWithinRecord", "select n_nationkey, n_regionkey from {nation}", {},
        rp("n_nationkey,n_regionkey", "n_nationkey = n_regionkey", every=True))
    chk("NaturalKey", NULLS, {"columns": ["seg", "nat"], "allow_null": True},
        vd("seg,nat", "coalesce(sum(n) filter (where seg is not null and nat is not null and n > 1), 0)", total,
           frm=grouped("seg, nat")))
    chk("SurrogateKey", "orders", {"column": "o_orderkey", "check_sequential": True, "start_value": 0},
        vd("o_orderkey", "coalesce(sum(n) filter (where o_orderkey is null or n > 1), 0)", total,
           "bad = 0 and (select min(o_orderkey) = 0 and max(o_orderkey) - min(o_orderkey) + 1 = count(distinct o_orderkey) from data)",
           frm=grouped("o_orderkey")))


# Complementary error function by the same published fit, as SQL text.
def sql_erfc(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = repr(c[-1])
    for a in reversed(c[:-1]):
        poly = f"({poly} * {t} + ({a!r}))"
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(case when {x} >= 0 then {tail} else 2.0 - {tail} end)"


def sql_normal(z: str) -> str:
    return f"(0.5 * {sql_erfc(f'(-({z}) / sqrt(2.0))')})"


def fences(c: str, k: float) -> str:
    return f"(select quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b from data) q"


def distribution() -> None:
    chk("Between", "lineitem", {"column": "l_quantity", "min_value": 2, "max_value": 48, "mostly": 0.9},
        rp("l_quantity", "l_quantity not between 2 and 48", mostly=0.9))
    chk("Range", "lineitem", {"column": "l_discount", "min_value": 0.0, "max_value": 0.1, "inclusive_min": False},
        rp("l_discount", "not (l_discount > 0.0 and l_discount <= 0.1)"))
    chk("Positive", "customer", {"column": "c_acctbal"}, rp("c_acctbal", "c_acctbal <= 0"))
    chk("NonNegative", "supplier", {"column": "s_acctbal"}, rp("s_acctbal", "s_acctbal < 0"))
    chk("InSet", "orders", {"column": "o_orderstatus", "value_set": ["O", "F"], "mostly": 0.6},
        rp("o_orderstatus", "o_orderstatus not in ('O','F')", mostly=0.6))
    chk("NotInSet", "events", {"column": "event_type", "forbidden_set": ["error"]}, rp("event_type", "event_type in ('error')"))
    for name, op in (("Increasing", "<"), ("Decreasing", ">")):
        chk(name, "events", {"column": "value", "order_by": "event_id"},
            vd("value", f"count(*) filter (where value {op} p)", "greatest(count(*) - 1, 0)",
               frm="(select value, lag(value) over (order by event_id) p from data where value is not null) w"))
    chk("Outlier", "lineitem", {"column": "l_extendedprice", "iqr_multiplier": 1.0},
        vd("l_extendedprice", "count(*) filter (where l_extendedprice < a - 1.0 * (b - a) or l_extendedprice > b + 1.0 * (b - a))",
           "count(l_extendedprice)", frm="data, " + fences("l_extendedprice", 1.0)))
    chk("ZScoreOutlier", "events", {"column": "value", "threshold": 2.0},
        vd("value", "count(*) filter (where abs(value - m) / s > 2.0)", "count(value)",
           frm="data, (select avg(value) m, stddev_samp(value) s from data) q"))
    chk("Quantile", "orders", {"column": "o_totalprice", "quantile": 0.9, "max_value": 400000},
        ag("o_totalprice", "quantile_cont(o_totalprice, 0.9)", "v <= 400000"))
    gap = "greatest(abs(c / n - f), abs((c - k) / n - f))"
    ecdf = ("(select x, k, sum(k) over (order by x) as c, sum(k) over () * 1.0 as n, m, s, lo, hi from "
            "(select cast({c} as double) x, count(*) k from data where {c} is not null group by 1) a, "
            "(select avg({c}) m, stddev_samp({c}) s, min({c}) * 1.0 lo, max({c}) * 1.0 hi from data) b) e")
    chk("Distribution", "customer", {"column": "c_acctbal", "distribution": "uniform"},
        ag("c_acctbal", "max(g)", "v <= l", frm="x") | {
            "frm": f"(select max({gap}) as g, sqrt(-ln(0.025) / 2) / sqrt(max(n)) as l from (select *, (x - lo) / (hi - lo) as f from {ecdf.format(c='c_acctbal')}) z) y",
            "v": "g", "ok": "v <= (select sqrt(-ln(0.025) / 2) / sqrt(count(c_acctbal)) from data)"})
    chk("Distribution", "events", {"column": "value", "distribution": "normal"},
        ag("value", "g", "v <= (select sqrt(-ln(0.025) / 2) / sqrt(count(value)) from data)",
           f"(select max({gap}) as g from (select *, {sql_normal('(x - m) / s')} as f from {ecdf.format(c='value')}) z) y"),
        key="check_Distribution_normal")
    chk("KLDivergence", "orders", {"column": "o_orderstatus", "reference_distribution": {"O": 0.5, "F": 0.3, "P": 0.2}},
        ag("o_orderstatus", "sum(p * ln(p / q))", "v <= 0.1",
           "(select count(*) * 1.0 / (select count(*) from data) p, case o_orderstatus when 'O' then 0.5 when 'F' then 0.3 when 'P' then 0.2 else 1e-10 end q "
           "from data group by o_orderstatus) g"))
    z = "(cbrt(v / 2.0) - (1 - 2.0 / 18.0)) / sqrt(2.0 / 18.0)"
    chk("ChiSquare", "lineitem", {"column": "l_returnflag", "expected_frequencies": {"A": 1, "N": 1, "R": 1}},
        ag("l_returnflag", "sum(power(n - t / 3.0, 2) / (t / 3.0))", f"1 - {sql_normal(z)} >= 0.05",
           "(select count(*) n, (select count(*) from data where l_returnflag in ('A','N','R')) t from data where l_returnflag in ('A','N','R') group by l_returnflag) g"))
    chk("MostCommonValue", "part", {"column": "p_brand", "min_frequency": 0.01, "expected_value": "Brand#1"},
        ag("p_brand", "max(n) * 1.0 / sum(n)", "v >= 0.01 and (select p_brand from data group by p_brand order by count(*) desc, p_brand limit 1) = 'Brand#1'",
           grouped("p_brand", "p_brand is not null")), key="check_MostCommonValue")


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')".replace("\\\\", "\\")


CONTACTS = """select c_custkey,
 case when c_custkey % 4 = 0 then concat('user', cast(c_custkey as string), '@example.com') when c_custkey % 9 = 0 then concat('user', cast(c_custkey as string), '.example.com') else concat('u_', cast(c_custkey as string), '@mail.org') end as email,
 case when c_custkey % 3 = 0 then concat('+1-212-555-', lpad(cast(c_custkey % 10000 as string), 4, '0')) when c_custkey % 5 = 0 then cast(c_custkey as string) else concat('(415) 555-', lpad(cast(c_custkey % 10000 as string), 4, '0')) end as phone,
 case when c_custkey % 6 = 0 then concat('10.', cast(c_custkey % 300 as string), '.7.1') when c_custkey % 7 = 0 then concat('fe80::', cast(c_custkey % 9999 as string)) else concat('192.168.', cast(c_custkey % 256 as string), '.', cast(c_custkey % 256 as string)) end as ip,
 case when c_custkey % 8 = 0 then 'not-a-uuid' else concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-4', substr(md5(c_name), 14, 3), '-a', substr(md5(c_name), 18, 3), '-', substr(md5(c_name), 21, 12)) end as uuid,
 case when c_custkey % 10 = 0 then concat('{{"k": ', cast(c_custkey as string)) else concat('{{"k": ', cast(c_custkey as string), ', "tag": "', c_mktsegment, '"}}') end as js,
 case when c_custkey % 3 = 0 then lower(c_mktsegment) when c_custkey % 5 = 0 then concat('x_', lower(c_mktsegment)) else c_mktsegment end as word,
 case when c_custkey % 6 = 0 then concat('2024-13-', cast(c_custkey % 28 + 1 as string)) when c_custkey % 5 = 0 then concat('2023-02-', lpad(cast(c_custkey % 31 + 1 as string), 2, '0')) else concat('2024-', lpad(cast(c_custkey % 12 + 1 as string), 2, '0'), '-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0')) end as day
 from {customer}"""


def string() -> None:
    chk("Regex", "pages", {"column": "url", "pattern": "page=[0-9]+", "mostly": 0.1},
        rp("url", "not regexp_matches(url, 'page=[0-9]+')", mostly=0.1))
    chk("RegexList", "pages", {"column": "url", "patterns": ["/en/", "/fr/"]},
        rp("url", "not (regexp_matches(url, '/en/') or regexp_matches(url, '/fr/'))"))
    chk("NotMatchRegex", "documents", {"column": "text", "pattern": "[0-9]{3}-[0-9]{2}-[0-9]{4}"},
        rp("text", "regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"))
    chk("Length", "documents", {"column": "text", "min_length": 20, "max_length": 5000},
        rp("text", "length(text) not between 20 and 5000"))
    chk("Email", CONTACTS, {"column": "email"}, rp("email", "not " + rx("email", P.EMAIL)))
    chk("Url", "pages", {"column": "url"}, rp("url", "not " + rx("url", P.URL)))
    chk("Phone", CONTACTS, {"column": "phone", "country_code": "US"}, rp("phone", "not " + rx("phone", P.PHONE["US"])))
    chk("Uuid", CONTACTS, {"column": "uuid"}, rp("uuid", "not " + rx("uuid", P.UUID)))
    chk("IpAddress", CONTACTS, {"column": "ip"}, rp("ip", f"not ({rx('ip', P.IPV4)} or {rx('ip', P.IPV6)})"))
    chk("Format", CONTACTS, {"column": "ip", "format_type": "ipv4"}, rp("ip", "not " + rx("ip", P.IPV4)))
    chk("JsonParseable", CONTACTS, {"column": "js"}, rp("js", "not json_valid(js)"))
    chk("JsonSchema", CONTACTS, {"column": "js", "schema": {
        "type": "object", "required": ["k", "tag"],
        "properties": {"k": {"type": "integer", "maximum": 1000}, "tag": {"type": "string", "minLength": 9}}}},
        rp("js", "not (case when json_valid(js) then cast(json_extract_string(js, '$.k') as bigint) <= 1000 "
                 "and length(json_extract_string(js, '$.tag')) >= 9 else false end)"))
    chk("Alphanumeric", CONTACTS, {"column": "word"}, rp("word", "not regexp_matches(word, '^[A-Za-z0-9]+$')"))
    chk("ConsistentCasing", CONTACTS, {"column": "word", "casing": "upper"}, rp("word", "word <> upper(word)"))
    chk("ConsistentCasing", CONTACTS, {"column": "word", "casing": "snake"},
        rp("word", "not " + rx("word", P.CASING["snake"])), key="check_ConsistentCasing_snake")
    chk("LikePattern", "part", {"column": "p_type", "pattern": "%ECONOMY%"}, rp("p_type", "p_type not like '%ECONOMY%'"))
    chk("NotLikePattern", "part", {"column": "p_name", "pattern": "small%"}, rp("p_name", "p_name like 'small%'"))
    chk("DateutilParseable", CONTACTS, {"column": "day"}, rp("day", "try_cast(day as date) is null"))


def datetime_() -> None:
    chk("DateFormat", CONTACTS, {"column": "day", "format": "%Y-%m-%d"}, rp("day", "try_strptime(day, '%Y-%m-%d') is null"))
    chk("DateBetween", "orders", {"column": "o_orderdate", "min_date": "1996-01-01", "max_date": "2000-12-31"},
        rp("o_orderdate", "o_orderdate not between timestamp '1996-01-01' and timestamp '2000-12-31'"))
    chk("FutureDate", "lineitem", {"column": "l_shipdate"}, rp("l_shipdate", "l_shipdate <= timestamp '1998-06-01'"),
        as_of="1998-06-01 00:00:00")
    chk("PastDate", "lineitem", {"column": "l_shipdate"}, rp("l_shipdate", "l_shipdate >= timestamp '1998-06-01'"),
        as_of="1998-06-01 00:00:00")
    both = "select l.l_shipdate, o.o_orderdate from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey"
    chk("DateOrder", both, {"start_column": "o_orderdate", "end_column": "l_shipdate"},
        rp("o_orderdate,l_shipdate", "o_orderdate > l_shipdate", "o_orderdate is not null and l_shipdate is not null"))
    zoned = """select c_custkey, concat('2024-01-0', cast(c_custkey % 9 + 1 as string), 'T10:00:00', case when c_custkey % 3 = 0 then 'Z' when c_custkey % 3 = 1 then '+02:00' else '' end) as moment from {customer}"""
    chk("Timezone", zoned, {"column": "moment", "expected_timezone": "UTC"},
        rp("moment", "not (moment like '%Z' or moment like '%+00:00' or moment like '%+0000')"))
    age = "epoch(timestamp '{0}') / 86400.0 - epoch(max({1})) / 86400.0"
    chk("RecentData", "events", {"column": "ts", "max_age_days": 7}, ag("ts", age.format("2024-02-01", "ts"), "v <= 7"),
        as_of="2024-02-01 00:00:00")
    chk("DatePartCoverage", "orders", {"column": "o_orderdate", "date_part": "month", "min_coverage": 0.9},
        ag("o_orderdate", "count(distinct month(o_orderdate)) / 12.0", "v >= 0.9"))
    chk("GroupedRecentData", "events", {"datetime_column": "ts", "group_column": "user_id", "max_age_days": 2},
        vd("ts", "count(*) filter (where m < timestamp '2024-01-30')", "count(*)",
           frm="(select max(ts) m from data group by user_id) g"), as_of="2024-02-01 00:00:00")
    chk("DatetimeParseable", CONTACTS, {"column": "day"}, rp("day", "try_cast(day as date) is null"))


def aggregate() -> None:
    chk("MeanBetween", "customer", {"column": "c_acctbal", "min_value": 4000, "max_value": 5000},
        ag("c_acctbal", "avg(c_acctbal)", "v between 4000 and 5000"))
    chk("MedianBetween", "lineitem", {"column": "l_quantity", "min_value": 20, "max_value": 30},
        ag("l_quantity", "median(l_quantity)", "v between 20 and 30"))
    chk("StdBetween", "lineitem", {"column": "l_quantity", "max_value": 10},
        ag("l_quantity", "stddev_samp(l_quantity)", "v <= 10"))
    chk("VarianceBetween", "lineitem", {"column": "l_discount", "max_value": 1},
        ag("l_discount", "var_samp(l_discount)", "v <= 1"))
    chk("SumBetween", "lineitem", {"column": "l_quantity", "min_value": 1}, ag("l_quantity", "sum(l_quantity)", "v >= 1"))
    chk("MinBetween", "orders", {"column": "o_totalprice", "min_value": 0}, ag("o_totalprice", "min(o_totalprice)", "v >= 0"))
    chk("MaxBetween", "orders", {"column": "o_totalprice", "max_value": 100000},
        ag("o_totalprice", "max(o_totalprice)", "v <= 100000"))
    chk("CountBetween", "events", {"min_count": 10}, ag(None, "count(*)", "v >= 10"))


for part in (schema, completeness, uniqueness, distribution, string, datetime_, aggregate):
    part()
