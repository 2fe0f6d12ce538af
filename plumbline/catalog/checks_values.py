"""Queries of the business-rule, localization, privacy, profiling, machine
learning, time-series, drift and anomaly checks."""

from __future__ import annotations

from plumbline.catalog.base import ag, chk, rp, vd
from plumbline.catalog.checks_rows import LABELLED, NULLS, grouped, rx, sql_normal
from plumbline.functions import checkdigits as K
from plumbline.functions import patterns as P
from plumbline.functions.special import chi_square_quantile

KEY = "cast(o_orderkey as string)"


def pad(x: str, n: int) -> str:
    return f"lpad({x}, {n}, '0')"


def ints(c: str) -> str:
    return f"list_transform(string_split({c}, ''), lambda x: x::int)"


def wsum(c: str, weights) -> str:
    w = list(weights)
    return f"list_sum(list_transform(({ints(c)})[1:{len(w)}], lambda x, i: x * ({w})[i]))"


def sql_luhn(c: str) -> str:
    return (f"(list_sum(list_transform(list_reverse({ints(c)}), lambda x, i: "
            "case when i % 2 = 0 then (case when x > 4 then x * 2 - 9 else x * 2 end) else x end)) % 10 = 0)")


def sql_gs1(c: str) -> str:
    return f"(list_sum(list_transform(list_reverse({ints(c)}), lambda x, i: case when i % 2 = 0 then x * 3 else x end)) % 10 = 0)"


CARDS = f"select o_orderkey, concat(case when o_orderkey % 2 = 0 then '4' else '5' end, {pad(KEY, 15)}) as card, {pad(KEY, 9)} as d9, {pad(KEY, 10)} as d10 from {{orders}}"


def business_rule() -> None:
    perm = [v for row in K.verhoeff_permutations() for v in row]
    table = [K.dihedral(j, k) for j in range(10) for k in range(10)]
    damm = [v for row in K.DAMM for v in row]
    chk("Checksum", CARDS, {"column": "d9", "algorithm": "verhoeff"},
        rp("d9", f"list_reduce(list_transform(list_reverse({ints('d9')}), lambda x, i: ({perm})[((i - 1) % 8) * 10 + x + 1]), lambda a, x: ({table})[a * 10 + x + 1], 0) <> 0"))
    chk("Checksum", CARDS, {"column": "d9", "algorithm": "damm"},
        rp("d9", f"list_reduce({ints('d9')}, lambda a, x: ({damm})[a * 10 + x + 1], 0) <> 0"), key="check_Checksum_damm")
    m = f"((11 - list_sum(list_transform(list_reverse(({ints('d9')})[1:8]), lambda x, i: x * (2 + (i - 1) % 6))) % 11) % 11)"
    chk("Checksum", CARDS, {"column": "d9", "algorithm": "mod11"},
        rp("d9", f"right(d9, 1) <> case when {m} = 10 then 'X' else {m}::varchar end"), key="check_Checksum_mod11")
    chk("Luhn", CARDS, {"column": "card"}, rp("card", "not " + sql_luhn("card")))
    books = f"select case when p_partkey % 2 = 0 then {pad('cast(p_partkey as string)', 10)} else concat('978', {pad('cast(p_partkey as string)', 10)}) end as isbn from {{part}}"
    chk("ISBN", books, {"column": "isbn"},
        rp("isbn", f"not (case when length(isbn) = 10 then {wsum('isbn', range(10, 0, -1))} % 11 = 0 else {sql_gs1('isbn')} end)"))
    chk("CreditCard", CARDS, {"column": "card", "card_type": "visa"}, rp("card", f"not (card like '4%' and {sql_luhn('card')})"))
    iban = f"select concat(case when o_orderkey % 3 = 0 then 'FR' else 'DE' end, {pad('cast(o_orderkey % 97 as string)', 2)}, {pad(KEY, 18)}) as iban from {{orders}}"
    chk("IBAN", iban, {"column": "iban", "country_codes": ["DE"]},
        rp("iban", "not (iban like 'DE%' and cast(concat(substr(iban, 5), '1314', substr(iban, 3, 2)) as hugeint) % 97 = 1)"))
    vat = f"select concat(case when o_orderkey % 4 = 0 then 'DE' when o_orderkey % 4 = 1 then 'ATU' when o_orderkey % 4 = 2 then 'XX' else 'IT' end, {pad(KEY, 9)}) as vat from {{orders}}"
    chk("VAT", vat, {"column": "vat"}, rp("vat", "not (" + " or ".join(rx("vat", p) for p in P.VAT.values()) + ")"))
    letters = "upper(translate(md5(c_name), '0123456789', 'ghijklmnop'))"
    swift = f"select case when c_custkey % 3 = 0 then substr({letters}, 1, 11) when c_custkey % 3 = 1 then substr({letters}, 1, 8) else substr({letters}, 1, 9) end as bic from {{customer}}"
    chk("SWIFT", swift, {"column": "bic"}, rp("bic", "length(bic) not in (8, 11)"))
    ean = f"select case when o_orderkey % 2 = 0 then {pad(KEY, 13)} else {pad(KEY, 8)} end as code from {{orders}}"
    chk("EAN", ean, {"column": "code", "format": "ean13"}, rp("code", f"not (length(code) = 13 and {sql_gs1('code')})"))


YMD = "concat(cast(year(o_orderdate) as string), lpad(cast(month(o_orderdate) as string), 2, '0'), lpad(cast(dayofmonth(o_orderdate) as string), 2, '0'))"


def localization() -> None:
    biz = f"select case when o_orderkey % 3 = 0 then concat(substr({pad(KEY, 10)}, 1, 3), '-', substr({pad(KEY, 10)}, 4, 2), '-', substr({pad(KEY, 10)}, 6, 5)) else {pad(KEY, 10)} end as no from {{orders}}"
    d = "replace(no, '-', '')"
    total = f"({wsum(d, K.KOREAN_BUSINESS)} + (({ints(d)})[9] * 5) // 10)"
    chk("KoreanBusinessNumber", biz, {"column": "no"}, rp("no", f"not (({ints(d)})[10] = (10 - {total} % 10) % 10)"))
    sex = "case when year(o_orderdate) < 2000 then '1' else '3' end"
    rrn = f"""select concat(case when o_orderkey % 7 = 0 then '991399' else substr({YMD}, 3, 6) end, '-', {sex},
 case when o_orderkey % 5 = 0 then '******' else {pad('cast(o_orderkey % 1000000 as string)', 6)} end) as rrn, o_orderkey from {{orders}}"""
    c = "replace(rrn, '-', '')"
    digit = f"(({ints(c)})[13] = (11 - {wsum(c, K.KOREAN_RRN)} % 11) % 10)"
    chk("KoreanRRN", rrn, {"column": "rrn"}, rp("rrn", f"o_orderkey % 7 = 0 or not (case when rrn like '%*%' then true else {digit} end)"))
    phones = """select c_custkey, case when c_custkey % 3 = 0 then concat('010-', lpad(cast(c_custkey as string), 4, '0'), '-1234') when c_custkey % 3 = 1 then concat('02-', lpad(cast(c_custkey % 1000 as string), 3, '0'), '-5678') else cast(c_custkey as string) end as kr,
 case when c_custkey % 3 = 0 then concat('090-', lpad(cast(c_custkey % 10000 as string), 4, '0'), '-1234') when c_custkey % 3 = 1 then concat('0120-', lpad(cast(c_custkey % 1000 as string), 3, '0'), '-567') else concat('x', cast(c_custkey as string)) end as jp,
 case when c_custkey % 3 = 0 then concat('138', lpad(cast(c_custkey as string), 8, '0')) when c_custkey % 3 = 1 then concat('010-', lpad(cast(c_custkey as string), 8, '1')) else concat('12', cast(c_custkey as string)) end as cn,
 case when c_custkey % 2 = 0 then concat('3333-', lpad(cast(c_custkey % 100 as string), 2, '0'), '-', lpad(cast(c_custkey as string), 7, '0')) else concat('1000-', cast(c_custkey as string)) end as acc,
 case when c_custkey % 3 = 0 then concat('〒', lpad(cast(c_custkey % 1000 as string), 3, '0'), '-0001') when c_custkey % 3 = 1 then concat(lpad(cast(c_custkey % 1000 as string), 3, '0'), '0001') else cast(c_custkey as string) end as zip from {customer}"""
    chk("KoreanPhone", phones, {"column": "kr"}, rp("kr", "not (" + " or ".join(rx("kr", p) for p in P.KOREAN_PHONE.values()) + ")"))
    chk("KoreanBankAccount", phones, {"column": "acc", "bank": "kakao"}, rp("acc", "not " + rx("acc", P.KOREAN_BANK["kakao"])))
    chk("JapanesePostalCode", phones, {"column": "zip"}, rp("zip", "not regexp_matches(zip, '^〒?[ ]?[0-9]{3}-?[0-9]{4}$')"))
    mine = f"select {pad('cast(o_orderkey * 7919 as string)', 12)} as num from {{orders}}"
    rest = f"({wsum('num', K.MY_NUMBER)} % 11)"
    chk("JapaneseMyNumber", mine, {"column": "num"}, rp("num", f"not (({ints('num')})[12] = case when {rest} <= 1 then 0 else 11 - {rest} end)"))
    chk("JapanesePhone", phones, {"column": "jp", "type": "mobile"}, rp("jp", "not " + rx("jp", P.JAPANESE_PHONE["mobile"])))
    cid = f"select o_orderkey, concat(case when o_orderkey % 4 = 0 then '990101' else '110105' end, {YMD}, {pad('cast(o_orderkey % 1000 as string)', 3)}, substr('10X98765432', cast(o_orderkey % 11 as int) + 1, 1)) as id from {{orders}}"
    chk("ChineseID", cid, {"column": "id"},
        rp("id", f"not (o_orderkey % 4 <> 0 and right(id, 1) = substr('10X98765432', ({wsum('left(id, 17)', K.CHINESE_ID)} % 11)::int + 1, 1))"))
    abc = K.USCC_ALPHABET
    uscc = f"select concat(upper(substr(md5(cast(o_orderkey as string)), 1, 17)), substr('{abc}', cast(o_orderkey % 31 as int) + 1, 1)) as code from {{orders}}"
    vals = f"list_transform(string_split(code, ''), lambda x: instr('{abc}', x) - 1)"
    total = f"list_sum(list_transform(({vals})[1:17], lambda x, i: x * ({list(K.USCC_WEIGHTS)})[i]))"
    chk("ChineseUSCC", uscc, {"column": "code"}, rp("code", f"not (({vals})[18] = (31 - {total} % 31) % 31)"))
    chk("ChinesePhone", phones, {"column": "cn"}, rp("cn", "not (" + " or ".join(rx("cn", p) for p in P.CHINESE_PHONE.values()) + ")"))


def found(c: str, kind: str) -> str:
    return rx(c, P.PII[kind])


PEOPLE = """select c_custkey, c_nationkey, c_mktsegment, c_name, cast(c_custkey % 90 as int) as age,
 case when c_custkey % 4 = 0 then 'yes' when c_custkey % 4 = 1 then 'no' else null end as consent,
 case when c_custkey % 3 = 0 then '********' when c_custkey % 3 = 1 then concat('****', substr(c_name, 15, 4)) else c_name end as hidden,
 case when c_custkey % 5 = 0 then 'US' when c_custkey % 5 = 1 then 'JP' when c_custkey % 5 = 2 then 'DE' else 'RU' end as dest,
 case when c_custkey % 6 = 0 then concat(cast(c_custkey as string), '-ssn 123-45-6789') else c_name end as note from {customer}"""


def privacy() -> None:
    chk("PIIDetection", "conversations", {"columns": ["text"], "pii_types": list(P.PII)},
        *[vd(f"text:{k}", f"count(*) filter (where {found('text', k)})", "count(text)", frm="data") for k in P.PII])
    chk("EmailPII", "documents", {"columns": ["text"]}, rp("text", found("text", "email")))
    chk("EmailPII", "documents", {"columns": ["text"], "allowed_domains": ["example.com"]},
        rp("text", f"len(list_filter(regexp_extract_all(text, '{P.PII['email']}'), lambda e: lower(split_part(e, '@', 2)) <> 'example.com')) > 0"),
        key="check_EmailPII_domains")
    chk("PhonePII", "documents", {"columns": ["text"]}, rp("text", found("text", "phone")))
    chk("SSNDetection", "documents", {"columns": ["text"]}, rp("text", found("text", "ssn")))
    chk("CreditCardDetection", "documents", {"columns": ["text"]},
        rp("text", f"len(list_filter(list_transform(regexp_extract_all(text, '{P.PII['credit_card']}'), lambda e: regexp_replace(e, '[ \\-]', '', 'g')), "
           f"lambda e: {sql_luhn('e')})) > 0"))
    def any_pii(c, reg):
        return " or ".join(found(c, k) for k in P.REGULATIONS[reg])
    chk("GDPRCompliance", PEOPLE.replace("c_mktsegment, c_name,", "c_mktsegment,"), {"check_consent": "consent", "sensitive_columns": ["consent"]},
        *[rp(f"pii:{c}", any_pii(c, "gdpr"), f"{c} is not null") for c in ("c_mktsegment", "consent", "hidden", "dest", "note")],
        rp("consent:consent", "coalesce(consent, '') <> 'yes'", every=True), rp("sensitive:consent", "consent is not null", every=True))
    chk("CCPACompliance", "select note, consent, age from (" + PEOPLE + ")", {"check_opt_out": "consent", "minor_age_column": "age"},
        *[rp(f"pii:{c}", any_pii(c, "ccpa"), f"{c} is not null") for c in ("note", "consent")],
        rp("opt_out:consent", "consent is null", every=True), rp("minor:age", "age < 16", "age is not null"))
    cpf = f"len(list_filter(list_transform(regexp_extract_all(tax, '[0-9]{{3}}\\.[0-9]{{3}}\\.[0-9]{{3}}-[0-9]{{2}}'), lambda e: regexp_replace(e, '[.\\-]', '', 'g')), lambda e: {{0}})) > 0"
    def cpf_digit(n):
        r = f"({wsum('e', range(n + 1, 1, -1))} * 10 % 11)"
        return f"(case when {r} = 10 then 0 else {r} end = ({ints('e')})[{n + 1}])"
    tax = f"""select concat(substr({pad('cast(o_orderkey * 100003 as string)', 11)}, 1, 3), '.', substr({pad('cast(o_orderkey * 100003 as string)', 11)}, 4, 3), '.',
 substr({pad('cast(o_orderkey * 100003 as string)', 11)}, 7, 3), '-', substr({pad('cast(o_orderkey * 100003 as string)', 11)}, 10, 2)) as tax, nullif(o_orderpriority, '5-LOW') as purpose from {{orders}}"""
    cpf_sql = cpf.replace("{0}", f"{cpf_digit(9)} and {cpf_digit(10)}")
    chk("LGPDCompliance", tax, {"purpose_column": "purpose"},
        *[rp(f"pii:{c}", any_pii(c, "lgpd"), f"{c} is not null") for c in ("tax", "purpose")],
        rp("cpf:tax", cpf_sql, "tax is not null"), rp("cpf:purpose", "false", "purpose is not null"),
        rp("purpose:purpose", "purpose is null or trim(purpose) = ''", every=True))
    age = "(epoch(timestamp '2001-09-01') - epoch(o_orderdate)) / 86400.0"
    chk("DataRetention", "orders", {"date_column": "o_orderdate", "max_age_days": 1500, "category_column": "o_orderstatus", "category_retention": {"P": 400, "O": 800}},
        rp("o_orderdate", f"{age} > case o_orderstatus when 'P' then 400 when 'O' then 800 else 1500 end"), as_of="2001-09-01 00:00:00")
    chk("MaskingVerification", PEOPLE, {"column": "hidden", "masking_type": "partial"}, rp("hidden", "not regexp_matches(hidden, '^[*#Xx]+[^*#]{0,4}$')"))
    chk("AnonymizationCheck", PEOPLE, {"quasi_identifiers": ["c_nationkey", "c_mktsegment"], "k_anonymity": 8, "sensitive_column": "dest", "l_diversity": 3},
        vd("c_nationkey,c_mktsegment", "count(*) filter (where k < 8 or l < 3)", "count(*)", v="min(k)",
           frm="(select count(*) k, count(distinct dest) l from data group by c_nationkey, c_mktsegment) g"))
    levels = [k for k in P.PII if P.PII_LEVEL[k] not in ("public", "internal")]
    chk("SensitiveDataClassification", "conversations", {"columns": ["text"], "max_allowed_level": "internal"},
        vd("text", " + ".join(f"max(case when {found('text', k)} then 1 else 0 end)" for k in levels), str(len(P.PII))))
    chk("AgeVerification", PEOPLE, {"age_column": "age", "consent_column": "consent"},
        rp("age", "age < 13 or (age < 18 and coalesce(consent, '') <> 'yes')"))
    chk("CrossBorderDataTransfer", PEOPLE, {"country_column": "dest", "allowed_countries": ["US"], "restricted_countries": ["RU"]},
        rp("dest", "dest not in ('US', 'CA', 'JP', 'KR', 'GB', 'CH', 'NZ', 'IL', 'AR', 'UY') or dest = 'RU'"))


ENTROPY = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"


def mi(a: str, b: str) -> str:
    return (f"(select log2(max(t)) + (max(ab) - max(sa) - max(sb)) / max(t) as v from (select sum(n) t, sum(n * log2(n)) ab, null sa, null sb from (select count(*) n from data where {a} is not null and {b} is not null group by {a}, {b}) x "
            f"union all select null, null, sum(n * log2(n)), null from (select count(*) n from data where {a} is not null and {b} is not null group by {a}) x "
            f"union all select null, null, null, sum(n * log2(n)) from (select count(*) n from data where {a} is not null and {b} is not null group by {b}) x) y) g")


def profiling() -> None:
    chk("Cardinality", "part", {"column": "p_type", "max_cardinality": 3}, ag("p_type", "count(distinct p_type)", "v <= 3"))
    chk("UniquenessRatio", "customer", {"column": "c_acctbal", "min_ratio": 0.99}, ag("c_acctbal", "count(distinct c_acctbal) * 1.0 / count(c_acctbal)", "v >= 0.99"))
    chk("Entropy", "orders", {"column": "o_orderpriority", "min_entropy": 2.0}, ag("o_orderpriority", ENTROPY, "v >= 2.0", grouped("o_orderpriority", "o_orderpriority is not null")))
    chk("InformationGain", "lineitem", {"feature_column": "l_linestatus", "target_column": "l_returnflag", "min_gain": 0.1},
        ag("l_linestatus,l_returnflag", "v", "v >= 0.1", mi("l_linestatus", "l_returnflag")))
    for shape, w in (("uniform", "1.0"), ("power_law", "1.0 / r"), ("normal", "exp(-power((r - 1) * 3.0 / greatest(k - 1, 1), 2) / 2)")):
        chk("ValueFrequency", "events", {"column": "user_id", "expected_distribution": shape, "tolerance": 0.05},
            ag("user_id", "max(abs(n / t - w / s))", "v <= 0.05",
               f"(select n, sum(n) over () as t, w, sum(w) over () as s from (select *, {w} as w from (select n, row_number() over (order by n desc, user_id) as r, count(*) over () as k from {grouped('user_id', 'user_id is not null')}) x) y) z"),
            key="check_ValueFrequency" + ("" if shape == "uniform" else f"_{shape}"))
    chk("DistributionShape", "lineitem", {"column": "l_extendedprice", "max_skewness": 0.5, "max_kurtosis": 1.0},
        ag("l_extendedprice", "(select avg(power(l_extendedprice - m, 3)) / power(avg(power(l_extendedprice - m, 2)), 1.5) from data, (select avg(l_extendedprice) m from data) q)",
           "abs(v) <= 0.5 and (select abs(kurtosis_pop(l_extendedprice)) <= 1.0 from data)", "(select 1) x"))
    chk("profiling.MostCommonValue", "events", {"column": "event_type", "max_frequency_ratio": 0.5}, ag("event_type", "max(n) * 1.0 / sum(n)", "v <= 0.5", grouped("event_type", "event_type is not null")))
    mixed = "select case when c_custkey % 9 = 0 then 'n/a' when c_custkey % 4 = 0 then concat(cast(c_custkey as string), '.5') else cast(c_custkey as string) end as v from {customer}"
    chk("DataTypeConsistency", mixed, {"column": "v", "expected_type": "float"}, rp("v", "try_cast(v as double) is null"))


def ml_feature() -> None:
    chk("FeatureNullImpact", NULLS, {"column": "bal", "target_column": "nat", "max_null_ratio": 0.2, "max_impact_score": 5.0},
        ag("bal", "avg(case when bal is null then 1 else 0 end)", "v <= 0.2 and (select abs(avg(nat) filter (where bal is null) - avg(nat) filter (where bal is not null)) <= 5.0 from data)"))
    chk("FeatureScale", "lineitem", {"column": "l_discount", "expected_scale": "minmax", "tolerance": 0.5},
        ag("l_discount", "greatest(abs(min(l_discount)), abs(max(l_discount) - 1))", "v <= 0.5"))
    chk("FeatureScale", "select (l_quantity - 25) / 14 as z from {lineitem}", {"column": "z", "expected_scale": "robust", "tolerance": 0.5},
        ag("z", "greatest(abs(median(z)), abs(quantile_cont(z, 0.75) - quantile_cont(z, 0.25) - 1))", "v <= 0.5"), key="check_FeatureScale_robust")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    prs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    chk("FeatureCorrelationMatrix", "lineitem", {"columns": cols, "max_correlation": 0.5}, *[ag(f"{a},{b}", f"corr({a}, {b})", "abs(v) <= 0.5") for a, b in prs])
    rank = "(rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0)"
    chk("FeatureCorrelationMatrix", "customer", {"columns": ["c_nationkey", "c_acctbal"], "method": "spearman"},
        ag("c_nationkey,c_acctbal", "corr(a, b)", "abs(v) <= 0.9", f"(select {rank.format('c_nationkey')} a, {rank.format('c_acctbal')} b from data) r"), key="check_FeatureCorrelationMatrix_spearman")
    tau = ("(select sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))) as v from "
           "(select s_nationkey a, s_acctbal b from data) x, (select s_nationkey a, s_acctbal b from data) y) g")
    chk("FeatureCorrelationMatrix", "supplier", {"columns": ["s_nationkey", "s_acctbal"], "method": "kendall"},
        ag("s_nationkey,s_acctbal", "v", "abs(v) <= 0.9", tau), key="check_FeatureCorrelationMatrix_kendall")
    chk("TargetLeakage", "lineitem", {"feature_columns": ["l_quantity", "l_tax"], "target_column": "l_extendedprice", "leakage_threshold": 0.6},
        *[ag(c, f"abs(corr({c}, l_extendedprice))", "v <= 0.6") for c in ("l_quantity", "l_tax")])
    bins = f"(select log2(max(t)) + (max(ab) - max(sa) - max(sb)) / max(t) as v from (select 1) one, (select sum(n) t, sum(n * log2(n)) ab from (select count(*) n from b group by f, y)) p, " \
           "(select sum(n * log2(n)) sa from (select count(*) n from b group by f)) q, (select sum(n * log2(n)) sb from (select count(*) n from b group by y)) r) g"
    edges = " + ".join(f"(l_quantity > (select quantile_cont(l_quantity, {i / 10}) from {{lineitem}}))::int" for i in range(1, 10))
    chk("FeatureImportance", "lineitem", {"column": "l_quantity", "target_column": "l_returnflag", "min_importance": 0.01},
        ag("l_quantity", "v * ln(2.0)", "v >= 0.01", bins), ctes={"b": f"select {edges} as f, l_returnflag as y from {{lineitem}}"})
    k, n = "count(*)", "sum(n)"
    chk("FeatureImportance", "lineitem", {"column": "l_extendedprice", "target_column": "l_returnflag", "method": "f_score", "min_importance": 1.0},
        ag("l_extendedprice", f"((sum(n * power(m - g, 2))) / ({k} - 1)) / (sum(n * s) / ({n} - {k}))", "v >= 1.0",
           "(select count(*) n, avg(l_extendedprice) m, var_pop(l_extendedprice) s, (select avg(l_extendedprice) from data) g from data group by l_returnflag) a"),
        key="check_FeatureImportance_f_score")
    chk("FeatureVariance", "lineitem", {"column": "l_tax", "min_variance": 0.01}, ag("l_tax", "var_samp(l_tax)", "v >= 0.01"))
    chk("FeatureOutlierRatio", "events", {"column": "value", "max_outlier_ratio": 0.01},
        vd("value", "count(*) filter (where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a))", "count(value)", "v <= 0.01",
           "count(*) filter (where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) * 1.0 / count(value)",
           "data, (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from data) q"))
    chk("ClassImbalance", "labels", {"column": "toxic", "max_imbalance_ratio": 5, "min_samples_per_class": 20},
        vd("toxic", "count(*) filter (where n < 20)", "count(*)", "v <= 5 and bad = 0", "max(n) * 1.0 / min(n)", grouped("toxic", "toxic is not null")))


def timeseries() -> None:
    lagged = "(select epoch_us(ts) - lag(epoch_us(ts)) over (order by ts) g from (select distinct ts from data) d) w"
    chk("TimeSeriesGap", "events", {"timestamp_column": "ts", "expected_interval": "10m", "tolerance": 0.5},
        vd("ts", "count(*) filter (where g > 900e6)", "count(*) - 1", v="max(g) / 1e6", frm=lagged))
    chk("TimeSeriesInterval", "select distinct date_trunc('hour', ts) as ts from {events}", {"timestamp_column": "ts", "interval": "1h"},
        vd("ts", "count(*) filter (where abs(g - 3600e6) > 360e6)", "count(*) - 1", frm=lagged))
    chk("TimeSeriesDuplicate", "select date_trunc('hour', ts) as h, user_id from {events}", {"timestamp_column": "h", "group_columns": ["user_id"]},
        vd("h", "coalesce(sum(n) filter (where n > 1), 0)", "sum(n)", frm=grouped("user_id, h", "h is not null")))
    order = "(select {0} <= lag({0}) over (order by {1}) bad, {0} < lag({0}) over (order by {1}) less from data) w"
    chk("TimeSeriesMonotonic", "events", {"timestamp_column": "ts", "order_by": "event_id"},
        vd("ts", "count(*) filter (where bad)", "count(*) - 1", frm=order.format("ts", "event_id")))
    chk("TimeSeriesOrder", "orders", {"timestamp_column": "o_orderdate", "order_by": "o_orderkey", "allow_equal": True},
        vd("o_orderdate", "count(*) filter (where less)", "count(*) - 1", frm=order.format("o_orderdate", "o_orderkey")))
    chk("Seasonality", "events", {"timestamp_column": "ts", "value_column": "value", "period": "daily", "min_strength": 0.01},
        ag("value", "sum(n * power(m - g, 2)) / (sum(n * power(m - g, 2)) + sum(n * s))", "v >= 0.01",
           "(select count(*) n, avg(value) m, var_pop(value) s, (select avg(value) from data) g from data group by hour(ts)) a"))
    slope = "regr_slope(value, epoch_us(ts) / 86400e6)"
    r = "corr(value, epoch_us(ts) / 86400e6)"
    chk("Trend", "events", {"timestamp_column": "ts", "value_column": "value", "expected_trend": "stable"},
        ag("value", slope, f"(select abs({r}) * sqrt((count(*) - 2) / (1 - {r} * {r})) < 1.959964 from data)"))
    chk("TrendBreak", "orders", {"timestamp_column": "o_orderdate", "value_column": "o_totalprice", "sensitivity": 0.05},
        ag("o_totalprice", "max(abs(cs / c - (ts - cs) / (n - c)) / sd) filter (where c >= 0.1 * n and c <= 0.9 * n)", "v <= 0.05",
           "(select sum(k) over (order by o_orderdate) c, sum(s) over (order by o_orderdate) cs, n, ts, sd from (select o_orderdate, count(*) k, sum(o_totalprice) s from data group by 1) a, "
           "(select count(*) n, sum(o_totalprice) ts, stddev_samp(o_totalprice) sd from data) b) w"))
    chk("TimeSeriesCompleteness", "events", {"timestamp_column": "ts", "start_date": "2024-01-01", "end_date": "2024-02-15", "min_completeness": 0.6},
        vd("ts", "46 - count(distinct ts::date)", "46", "v >= 0.6", "count(distinct ts::date) / 46.0", "data where ts >= date '2024-01-01' and ts < date '2024-02-16'"))
    chk("TimeSeriesDateRange", "events", {"timestamp_column": "ts", "min_date": "2024-01-05", "max_date": "2024-01-20"},
        rp("ts", "ts not between timestamp '2024-01-05' and timestamp '2024-01-20'"))
    chk("TimeSeriesValueCompleteness", "select cast(d.doc_id % 50 as int) as t, l.quality as q from {documents} d left join {labels} l on d.doc_id = l.doc_id and l.doc_id % 50 < 40",
        {"timestamp_column": "t", "value_column": "q"},
        vd("q", "count(*) filter (where f = 0)", "count(*)", "v <= 0.05", "count(*) filter (where f = 0) * 1.0 / count(*)", "(select count(q) f from data group by t) g"))


A, R = "select * from {lineitem} where l_returnflag = 'A'", "select * from {lineitem} where l_returnflag = 'R'"
E1, E2 = "select * from {events} where ts < timestamp '2024-01-16'", "select * from {events} where ts >= timestamp '2024-01-16'"


def cdfs(c: str, base: str = "r", cur: str = "data") -> str:
    """Rows (x, na, nb, fa, fb, nx): counts and cumulative shares, next value."""
    return (f"(select x, na, nb, sum(na) over w / (sum(na) over ()) fa, sum(nb) over w / (sum(nb) over ()) fb, lead(x) over w as nx, sum(na) over () ta, sum(nb) over () tb from "
            f"(select x, sum(ia)::double na, sum(ib)::double nb from (select {c} x, 1 ia, 0 ib from {base} where {c} is not null union all select {c}, 0, 1 from {cur} where {c} is not null) u group by x) v "
            "window w as (order by x)) k")


def bin_shares(c: str, base: str = "r", cur: str = "data", bins: int = 10) -> str:
    edges = " + ".join(f"({c} > (select quantile_cont({c}, {i / bins}) from {base}))::int" for i in range(1, bins))
    side = "(select {e} bin, count(*) n from {t} where {c} is not null group by 1) {a}"
    return (f"(select greatest(coalesce(a.n, 0) / (select count({c}) from {base}), 1e-6) p, greatest(coalesce(b.n, 0) / (select count({c}) from {cur}), 1e-6) q from "
            f"{side.format(e=edges, t=base, c=c, a='a')} full join {side.format(e=edges, t=cur, c=c, a='b')} on a.bin = b.bin) s")


def value_shares(c: str, base: str = "r", cur: str = "data") -> str:
    return (f"(select greatest(sum(ia) / (select count({c})::double from {base}), 1e-6) p, greatest(sum(ib) / (select count({c})::double from {cur}), 1e-6) q, sum(ia) na, sum(ib) nb from "
            f"(select {c} x, 1 ia, 0 ib from {base} where {c} is not null union all select {c}, 0, 1 from {cur} where {c} is not null) u group by x) s")


JS = "sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2"
PSI = "sum((p - q) * ln(p / q))"


def ks_p(d: str, n1: str, n2: str) -> str:
    ne = f"sqrt({n1} * {n2} * 1.0 / ({n1} + {n2}))"
    lam = f"(({ne} + 0.12 + 0.11 / {ne}) * {d})"
    return (f"(case when {lam} < 0.3 then 1.0 else 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * {lam} * {lam}))) end)")


def drift() -> None:
    def d(name, src, ref, params, *rows, **kw):
        chk(name, src, {**params, "reference_source_id": "r"}, *rows, refs={"r": ref}, **kw)
    n1, n2 = "(select count(l_extendedprice) from r)", "(select count(l_extendedprice) from data)"
    d("KSTest", R, A, {"column": "l_extendedprice"},
      ag("l_extendedprice", "max(abs(fa - fb))", f"(select {ks_p('v', 'n1', 'n2')} from (select {n1} n1, {n2} n2) n) >= 0.05", cdfs("l_extendedprice")))
    d("PSI", R, A, {"column": "l_extendedprice", "threshold": 0.01}, ag("l_extendedprice", PSI, "v <= 0.01", bin_shares("l_extendedprice")))
    d("PSI", E2, E1, {"column": "event_type", "is_categorical": True}, ag("event_type", PSI, "v <= 0.25", value_shares("event_type")), key="check_PSI_categorical")
    e0, e1 = "((na + nb) * t1 / (t1 + t2))", "((na + nb) * t2 / (t1 + t2))"
    z = "(cbrt(v / 4.0) - (1 - 2.0 / 36.0)) / sqrt(2.0 / 36.0)"
    d("ChiSquareDrift", E2, E1, {"column": "event_type"},
      ag("event_type", f"sum(case when {e0} > 5 then power(na - {e0}, 2) / {e0} else 0 end + case when {e1} > 5 then power(nb - {e1}, 2) / {e1} else 0 end)",
         f"1 - {sql_normal(z)} >= 0.05", f"(select *, sum(na) over () * 1.0 t1, sum(nb) over () * 1.0 t2 from {value_shares('event_type')}) y"))
    d("JSDivergence", E2, E1, {"column": "value", "threshold": 0.1}, ag("value", JS, "v <= 0.1", bin_shares("value")))
    d("Wasserstein", E2, E1, {"column": "value", "threshold": 0.01},
      ag("value", "sum(abs(fa - fb) * coalesce(nx - x, 0)) / (select stddev_samp(value) from r)", "v <= 0.01", cdfs("value")))
    d("CSI", R, A, {"column": "l_quantity", "threshold_per_bin": 0.0005, "n_bins": 5},
      vd("l_quantity", "count(*) filter (where abs((p - q) * ln(p / q)) > 0.0005)", "count(*)", v="max(abs((p - q) * ln(p / q)))", frm=bin_shares("l_quantity", bins=5)))
    d("MeanDrift", E2, E1, {"column": "value", "threshold_pct": 0.01, "threshold_abs": 1.0},
      ag("value", "avg(value) - (select avg(value) from r)", "abs(v) / abs((select avg(value) from r)) <= 0.01 and abs(v) <= 1.0"))
    d("VarianceDrift", E2, E1, {"column": "value", "threshold_pct": 0.2},
      ag("value", "abs(stddev_samp(value) - (select stddev_samp(value) from r)) / (select stddev_samp(value) from r)", "v <= 0.2"))
    q = "abs(quantile_cont(value, {0}) - (select quantile_cont(value, {0}) from r)) / abs((select quantile_cont(value, {0}) from r))"
    d("QuantileDrift", E2, E1, {"column": "value", "threshold_pct": 0.02}, ag("value", "greatest(" + ", ".join(q.format(x) for x in (0.25, 0.5, 0.75)) + ")", "v <= 0.02"))
    d("RangeDrift", E2, E1, {"column": "value"},
      ag("value", "greatest(abs(min(value) - (select min(value) from r)), abs(max(value) - (select max(value) from r))) / (select max(value) - min(value) from r)", "v <= 0.1"))
    d("FeatureDrift", R, A, {"columns": ["l_quantity", "l_discount"], "threshold": 0.001, "alert_on_any": False, "min_drift_count": 2},
      vd("l_quantity,l_discount", "count(*) filter (where x > 0.001)", "2", "bad < 2", "max(x)",
         f"(select {PSI} x from {bin_shares('l_quantity')} union all select {PSI} from {bin_shares('l_discount')}) f"))
    d("NullRateDrift", "select quality, lang from (" + LABELLED + ") where lang = 'fr'", "select quality, lang from (" + LABELLED + ") where lang = 'en'", {"column": "quality"},
      ag("quality", "abs(avg((quality is null)::int) - (select avg((quality is null)::int) from r))", "v <= 0.05"))
    new = "(select count(*) from (select l_partkey from data except select l_partkey from r) x)"
    gone = "(select count(*) from (select l_partkey from r except select l_partkey from data) x)"
    a, b = "(select count(distinct l_partkey) from r)", "(select count(distinct l_partkey) from data)"
    d("CardinalityDrift", R, A, {"column": "l_partkey"},
      vd("l_partkey", f"{new} + {gone}", "(select count(*) from (select l_partkey from data union select l_partkey from r) x)", "v <= 0.2 and bad = 0",
         f"abs({b} - {a}) * 1.0 / {a}", "(select 1) x"))


def standard_sql(pts: str) -> str:
    """Columns a and b standardised, rows numbered."""
    return (f"select (a - m1) / s1 as a, (b - m2) / s2 as b, row_number() over (order by a, b) as i from ({pts}) p, "
            f"(select avg(a) m1, stddev_pop(a) s1, avg(b) m2, stddev_pop(b) s2 from ({pts}) t) q")


def core_sql(pts: str, eps: float, n: int) -> dict[str, str]:
    """Core flags by comparing all pairs (the table is small at this scale)."""
    return {"z": standard_sql(pts), "core": f"select x.a, x.b, count(*) >= {n} as core from {{z}} x join {{z}} y on power(x.a - y.a, 2) + power(x.b - y.b, 2) <= {eps * eps!r} group by x.i, x.a, x.b"}


def lof_sql(pts: str, k: int) -> dict[str, str]:
    """Local outlier factors by comparing all pairs."""
    return {"z": standard_sql(pts),
            "nn": f"select i, j, d from (select x.i, y.i as j, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)) as d, row_number() over (partition by x.i order by power(x.a - y.a, 2) + power(x.b - y.b, 2), y.i) r from {{z}} x join {{z}} y on x.i <> y.i) w where r <= {k}",
            "kd": "select i, max(d) as kd from {nn} group by i",
            "lrd": "select nn.i, 1 / (avg(greatest(kd.kd, d)) + 1e-10) as l from {nn} nn join {kd} kd on kd.i = nn.j group by nn.i",
            "lof": "select nn.i, avg(b.l) / max(a.l) as s from {nn} nn join {lrd} b on b.i = nn.j join {lrd} a on a.i = nn.i group by nn.i"}


def anomaly() -> None:
    def frac(cond, total="count(value)"):
        return {"bad": f"count(*) filter (where {cond})", "total": total, "v": f"count(*) filter (where {cond}) * 1.0 / {total}"}
    quart = "data, (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from data) q"
    chk("IQRAnomaly", "events", {"column": "value", "detect_lower": False}, vd("value", ok="v <= 0.05", frm=quart, **frac("value > b + 1.5 * (b - a)")))
    z = "data, (select avg(value) m, stddev_samp(value) s from data) q"
    chk("ZScoreAnomaly", "events", {"column": "value"}, vd("value", ok="v <= 0.05", frm=z, **frac("abs(value - m) / s > 3.0")))
    mad = "data, (select m, (select median(abs(value - m)) from data) d from (select median(value) m from data) x) q"
    chk("MADAnomaly", "events", {"column": "value"}, vd("value", ok="v <= 0.05", frm=mad, **frac("abs(value - m) * 0.6745 / d > 3.5")))
    fence = "value < a - {0} * (b - a) or value > b + {0} * (b - a)"
    chk("TukeyFences", "events", {"column": "value", "detect_extreme": False},
        vd("value", ok="v <= 0.05", frm=quart, **frac(f"({fence.format(1.5)}) and not ({fence.format(3.0)})")))
    pct = "data, (select quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b from data) q"
    chk("PercentileAnomaly", "events", {"column": "value"}, vd("value", ok="v <= 0.02", frm=pct, **frac("value < a or value > b")))
    chk("GrubbsTest", "events", {"column": "value"})
    two = "data, (select avg(o_totalprice) m1, stddev_samp(o_totalprice) s1, avg(o_custkey) m2, stddev_samp(o_custkey) s2 from data) q"
    chk("ZScoreMultivariate", "select o_totalprice, o_custkey from {orders}", {"threshold": 1.5, "method": "mean"},
        vd("o_totalprice,o_custkey", ok="v <= 0.05", frm=two, **frac("(abs(o_totalprice - m1) / s1 + abs(o_custkey - m2) / s2) / 2 > 1.5", "count(*)")))
    limit = chi_square_quantile(0.975, 2)
    x, y = "((l_quantity - m1) / s1)", "((l_extendedprice - m2) / s2)"
    chk("Mahalanobis", "select l_quantity, l_extendedprice from {lineitem}", {"use_robust_covariance": False},
        vd("l_quantity,l_extendedprice", ok="v <= 0.05", **frac(f"({x} * {x} - 2 * r * {x} * {y} + {y} * {y}) / (1 - r * r) > {limit!r}", "count(*)"),
           frm="data, (select avg(l_quantity) m1, stddev_samp(l_quantity) s1, avg(l_extendedprice) m2, stddev_samp(l_extendedprice) s2, corr(l_quantity, l_extendedprice) r from data) q"))
    pts = "select cast(c_nationkey as double) as a, c_acctbal as b from {customer}"
    near = ("(select coalesce(sum(noise::int), 0) bad, count(*) total from (select not p.core and not exists (select 1 from core c where power(c.a - p.a, 2) + power(c.b - p.b, 2) <= 0.04 and c.core) as noise from core p) n) g")
    chk("DBSCAN", pts, {"eps": 0.2, "min_samples": 20}, vd("a,b", "max(bad)", "max(total)", "v <= 0.1", "max(bad) * 1.0 / max(total)", near), ctes=core_sql(pts, 0.2, 20))
    chk("LOF", pts, {"n_neighbors": 20, "contamination": 0.05},
        vd("a,b", "count(*) filter (where s > t)", "count(*)", "v <= 0.1", "count(*) filter (where s > t) * 1.0 / count(*)", "(select s, quantile_cont(s, 0.95) over () as t from lof) f"), ctes=lof_sql(pts, 20))
    many = {"columns": ["l_quantity", "l_extendedprice", "l_discount"]}
    chk("IsolationForest", "lineitem", {**many, "contamination": 0.02, "n_estimators": 50})
    chk("OneClassSVM", "lineitem", {**many, "nu": 0.05})
    chk("EllipticEnvelope", "lineitem", {**many, "contamination": 0.03})
    chk("PCAnomaly", "lineitem", {**many, "n_components": 2})
    chk("AutoEncoder", "lineitem", {**many, "encoding_dim": 1})
    chk("KMeansAnomaly", "lineitem", {**many, "n_clusters": 4})


for part in (business_rule, localization, privacy, profiling, ml_feature, timeseries, drift, anomaly):
    part()
