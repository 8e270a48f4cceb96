"""Queries over the other tables: sources, joins, aggregates, functions, matrices, evidence and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmap.functions import ids, stats
from kinmap.operators import annotate, enrich, matrix, overlap, release
from kinmap.plans.frames import NODES, nodes, table, with_
from kinmap.sources import sinks, text

Q = {}
S = {}


def case(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# --- sources --------------------------------------------------------------------------------------------------------


@case("select l_suppkey as dataset, l_orderkey as sample, l_partkey as feature, coalesce(try_cast(case when l_linenumber = 3 then 'n/a' else l_quantity::varchar end as double), 'nan'::double) as value from lineitem")
def s01_matrix_cells(spark, sf):
    cell = F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("feature"), text.number(cell).alias("value"))


@case("""with n as (select page_id, case when page_id % 3 = 0 then 'data/gse' || (1000 + page_id) || '_family.csv.gz' else regexp_extract(url, '([^/]*)$', 1) || '_raw.txt' end as path from pages),
f as (select page_id, regexp_extract(path, '([^/\\\\]*)$', 1) as name from n)
select page_id, upper(case when regexp_matches(name, '(?i)^gse[0-9]+') then regexp_extract(name, '(?i)^(gse[0-9]+)', 1) else regexp_replace(regexp_replace(name, '(\\.[^.]*)$', ''), '(?i)_RAW', '', 'g') end) as dataset from f""")
def s04_dataset_id(spark, sf):
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data/gse"), (1000 + F.col("page_id")).cast("string"), F.lit("_family.csv.gz"))).otherwise(F.concat(F.regexp_extract("url", "([^/]*)$", 1), F.lit("_raw.txt")))
    return table(spark, sf, "pages").select("page_id", ids.dataset_from_file(path).alias("dataset"))


@case("with r as (select p_partkey as k, p_size as probe, trim(string_split(p_name || ' /// x', '///')[1]) as gene from part) select probe, max_by(gene, k) as gene from r where gene <> '' group by probe")
def s15_probe_first_symbol(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.concat("p_name", F.lit(" /// x")).alias("g"))
    return text.probe_genes(rows, "s", "g", "k")


@case("with f as (select l_partkey as probe, l_suppkey as g, min(l_orderkey * 10 + l_linenumber) as o from lineitem group by 1, 2) select probe, string_agg(g::varchar, ',' order by o, g) as genes from f group by probe")
def s16_probe_multimap(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    out = text.probe_multimap(rows, "l_partkey", "l_suppkey", "o")
    return out.select("probe", F.array_join(F.transform("genes", lambda g: g.cast("string")), ",").alias("genes"))


@case("select distinct l_suppkey as pathway, l_partkey as gene from lineitem where l_returnflag <> 'A' and l_partkey in (select p_partkey from part where p_size > 10)")
def s17_pathway_members(spark, sf):
    universe = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("gene"))
    rows = table(spark, sf, "lineitem").filter("l_returnflag <> 'A'").select(F.col("l_suppkey").alias("pathway"), F.col("l_partkey").alias("gene"))
    return rows.join(universe, "gene", "left_semi").select("pathway", "gene").distinct()


@case("select distinct trim(p_brand) as gene from part where trim(p_brand) <> ''")
def s18_gene_universe(spark, sf):
    return table(spark, sf, "part").select(F.trim("p_brand").alias("gene")).filter("gene <> ''").distinct()


@case("""with found as (select distinct o_custkey as id from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-07-01'), present as (select c_custkey as id from customer where c_acctbal > 0)
select id, case when id in (select id from present) then 'existing' else 'new' end as state from found""")
def s20_discovery_split(spark, sf):
    found = table(spark, sf, "orders").filter("o_orderdate >= '1995-01-01' and o_orderdate < '1995-07-01'").select(F.col("o_custkey").alias("id")).distinct()
    present = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("there"))
    return found.join(present, "id", "left").select("id", F.when(F.col("there"), "existing").otherwise("new").alias("state"))


@case("""with cohort as (select distinct l_orderkey as series, l_partkey as sample from lineitem where l_quantity < 25), series as (select distinct l_orderkey as series, l_partkey as sample from lineitem where l_partkey % 5 <> 0),
j as (select coalesce(c.series, s.series) as series, c.sample as c, s.sample as s from cohort c full join series s on c.series = s.series and c.sample = s.sample)
select series, count(c) filter (s is not null) as kept, count(c) filter (s is null) as missing, count(s) filter (c is null) as excluded, case when count(c) filter (s is null) = 0 then 'complete' else 'incomplete' end as status from j group by series""")
def s21_cohort_filter(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_partkey").alias("sample"), "l_quantity")
    cohort = rows.filter("l_quantity < 25").select("series", "sample").distinct().withColumn("c", F.lit(1))
    series = rows.filter("sample % 5 <> 0").select("series", "sample").distinct().withColumn("s", F.lit(1))
    j = cohort.join(series, ["series", "sample"], "full")
    missing = F.count_if(F.col("s").isNull())
    return j.groupBy("series").agg(F.count_if(F.col("c").isNotNull() & F.col("s").isNotNull()).alias("kept"), missing.alias("missing"), F.count_if(F.col("c").isNull()).alias("excluded"), F.when(missing == 0, "complete").otherwise("incomplete").alias("status"))


_LINES = "lines as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n, role || ' = ' || substr(text, 1, 12) as line, role from conversations)"


@case("with " + _LINES + """, kv as (select conv_id, trim(string_split(line, '=')[1]) as key, trim(substr(line, strpos(line, '=') + 1)) as value from lines)
select conv_id, key, string_agg(distinct value, '; ' order by value) as "values" from kv where value <> '' group by 1, 2""")
def s22_line_attributes(spark, sf):
    key, value = text.key_value(F.concat("role", F.lit(" = "), F.translate(F.substring("text", 1, 12), "=\n\r", "   ")))
    rows = table(spark, sf, "conversations").select("conv_id", key.alias("key"), value.alias("value"))
    return text.fields_of(rows, ["conv_id"], "key", "value")


S["s22_line_attributes"] = S["s22_line_attributes"].replace("substr(text, 1, 12)", "translate(substr(text, 1, 12), '=' || chr(10) || chr(13), '   ')")


@case("select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn)::bigint as record from conversations")
def s23_record_numbers(spark, sf):
    starts = F.col("role") == "user"
    return table(spark, sf, "conversations").select("conv_id", "turn", text.record_number(starts, "conv_id", ["turn"]).alias("record"))


@case("""select conv_id, string_agg(distinct role, '; ' order by role) as "values" from conversations where trim(role) <> '' group by conv_id""")
def s24_field_rollup(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("field", F.lit("role"))
    return text.fields_of(rows, ["conv_id"], "field", "role").select("conv_id", "values")


@case("""with r as (select page_id, list_distinct(regexp_extract_all(url, '[0-9]+')) as d from pages)
select page_id, array_to_string(list_sort(list_transform(d, lambda x: 'GPL' || x)), ';') as platforms from r""")
def s25_summary_normaliser(spark, sf):
    digits = F.regexp_extract_all("url", F.lit("([0-9]+)"), 1)
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.transform(digits, lambda d: F.concat(F.lit("GPL"), d)))), ";").alias("platforms"))


@case("""with h as (select doc_id, sha256(coalesce(lang, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(n_chars::varchar, '')) as hash from documents)
select doc_id, hash, case when doc_id % 4 = 0 then 'cached' else 'pending' end as state from h""")
def s27_metadata_pending(spark, sf):
    docs = table(spark, sf, "documents")
    hashed = docs.select("doc_id", F.sha2(F.concat_ws(ids.UNIT, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "n_chars")]), 256).alias("hash"))
    cached = hashed.filter("doc_id % 4 = 0").select("doc_id", "hash", F.lit("cached").alias("state"))
    return cached.unionByName(hashed.join(cached, ["doc_id", "hash"], "left_anti").withColumn("state", F.lit("pending")))


@case("select event_id, event_type as field, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null and event_type <> ''")
def s28_candidate_rows(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"))
    return rows.filter("value is not null and field <> ''")


@case("select doc_id from (select doc_id from labels union select doc_id from documents where n_chars > 5000) where doc_id not in (select doc_id from documents where source = 'src1')")
def s29_fetch_missing(spark, sf):
    docs = table(spark, sf, "documents")
    wanted = table(spark, sf, "labels").select("doc_id").union(docs.filter("n_chars > 5000").select("doc_id")).distinct()
    return wanted.join(docs.filter("source = 'src1'").select("doc_id"), "doc_id", "left_anti")


_LOG = "case when regexp_matches(lower(line), 'licens') then 'licence' when regexp_matches(lower(line), 'password|secret|token') then 'secret' when regexp_matches(lower(line), '@') then 'address' end"


@case(f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), k as (select doc_id, {_LOG} as kind from l) select doc_id, kind, count(*) as n from k where kind is not null group by all")
def s31_line_diagnostics(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return text.diagnostics(lines, "line", {"licence": "licens", "secret": "password|secret|token", "address": "@"}).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@case("with s as (select d.doc_id, case when l.doc_id is null then 'unlabelled' when l.toxic = 1 then 'quarantined' when l.quality = 0 then 'rejected' when d.n_chars < 200 then 'short' else 'imported' end as status from documents d left join labels l using (doc_id)) select status, count(*) as n from s group by status")
def s33_import_gate(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    status = F.when(F.col("l").isNull(), "unlabelled").when(F.col("toxic") == 1, "quarantined").when(F.col("quality") == 0, "rejected").when(F.col("n_chars") < 200, "short").otherwise("imported")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@case("""with r as (select distinct l_partkey as probe, l_suppkey as gene from lineitem), p as (select p_partkey as probe from part)
select p.probe, r.gene, s.s_name as name from p left join r using (probe) left join supplier s on s.s_suppkey = r.gene""")
def s35_annotation_export(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("probe"), F.col("l_suppkey").alias("gene")).distinct()
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gene"), F.col("s_name").alias("name"))
    probes = table(spark, sf, "part").select(F.col("p_partkey").alias("probe"))
    return probes.join(pairs, "probe", "left").join(names, "gene", "left").select("probe", "gene", "name").orderBy("probe", F.asc_nulls_last("gene"))


# --- sinks ----------------------------------------------------------------------------------------------------------


@case("""select doc_id, '"' || replace(case when regexp_matches(t, '^[\\t\\r\\n]') or regexp_matches(t, '^\\s*[=+\\-@]') then '''' || t else t end, '"', '""') || '"' as cell
from (select doc_id, coalesce(case when doc_id % 5 = 0 then '=' || substr(text, 1, 40) when doc_id % 5 = 1 then ' -"' || substr(text, 1, 40) else substr(text, 1, 40) end, '') as t from documents)""")
def k11_csv_cell(spark, sf):
    piece = F.substring("text", 1, 40)
    cell = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), piece)).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(' -"'), piece)).otherwise(piece)
    return table(spark, sf, "documents").select("doc_id", ids.csv_cell(cell).alias("cell"))


@case(with_(NODES) + """select 'manifest' as record_type, '1' as version, null::bigint as id, null::varchar as accession, null::bigint as a, null::bigint as b union all
select 'node', null, id, accession, null, null from nodes union all select 'edge', null, null, null, x.id, y.id from nodes x join nodes y on x.id < y.id and x.tissue = y.tissue""")
def k10_research_export(spark, sf):
    n = nodes(spark, sf)
    e = n.select(F.col("id").alias("a"), "tissue").join(n.select(F.col("id").alias("b"), "tissue"), "tissue").filter("a < b").select("a", "b")
    n = n.select("id", "accession")
    return sinks.research_rows({"version": "1"}, n, e)


# --- joins ----------------------------------------------------------------------------------------------------------


@case("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def j03_latest_row(spark, sf):
    return release.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@case("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def j05_anti_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@case("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def j04_semi_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 100000")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@case("select o_orderkey from orders left join (select distinct l_orderkey from lineitem where l_linenumber > 2) l on l_orderkey = o_orderkey where l_orderkey is null order by o_orderkey limit 1000")
def j06_resume_set(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(1_000)


@case("with x as (select p_partkey as id from part where p_size > 5), y as (select distinct l_partkey as id from lineitem where l_quantity > 45) select count(*) filter (y.id is null) as without_value, count(*) filter (x.id is null) as outside from x full join y on x.id = y.id")
def j07_reconciliation(spark, sf):
    x = table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("x"))
    y = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("y")).distinct()
    return x.join(y, F.col("x") == F.col("y"), "full").agg(F.count_if(F.col("y").isNull()).alias("without_value"), F.count_if(F.col("x").isNull()).alias("outside"))


@case("with t as (select p_partkey as id, coalesce(nullif(case when p_size % 3 = 0 then p_brand else '' end, ''), lower(p_type)) as term from part) select x.id as a, y.id as b, count(*) as shared from t x join t y on x.term = y.term and x.id < y.id group by 1, 2")
def j08_canonical_term_join(spark, sf):
    term = F.coalesce(F.nullif(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(""), F.lit("")), F.lower("p_type"))
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), term.alias("term"))
    return t.select(F.col("id").alias("a"), "term").join(t.select(F.col("id").alias("b"), "term"), "term").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


_SHARED = """c as (select l_suppkey as d, l_partkey as s, count(*) as c from lineitem group by 1, 2),
ov as (select x.d as a, y.d as b, sum(least(x.c, y.c))::bigint as shared from c x join c y on x.s = y.s and x.d < y.d group by 1, 2),
sz as (select d as id, sum(c)::bigint as size from c group by 1)"""


@case("with " + _SHARED + " select * from ov")
def j09_overlap_pairs(spark, sf):
    return overlap.overlap_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


def _overlap(spark, sf):
    rows = table(spark, sf, "lineitem")
    sizes = rows.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("size"))
    return overlap.with_metrics(overlap.overlap_counts(rows, "l_suppkey", "l_partkey"), sizes, 0.25)


_METRICS = """m as (select a, b, shared, x.size as na, y.size as nb, shared / x.size as fa, shared / y.size as fb, shared / (x.size + y.size - shared) as j, shared / least(x.size, y.size) as oc
  from ov join sz x on x.id = a join sz y on y.id = b),
k as (select *, case when shared = 0 then 'none' when shared = na and shared = nb then 'exact' when oc >= 0.25 then 'major' else 'minor' end as class from m)"""


@case("with " + _SHARED + ", " + _METRICS + " select a, b, shared, round(fa, 9) as fraction_a, round(fb, 9) as fraction_b, round(j, 9) as jaccard, round(oc, 9) as coefficient, class from k")
def c23_overlap_metrics(spark, sf):
    cols = ("fraction_a", "fraction_b", "jaccard", "coefficient")
    return _overlap(spark, sf).select("a", "b", "shared", *[F.round(c, 9).alias(c) for c in cols], "class")


@case("with " + _SHARED + ", " + _METRICS + " select class, class in ('exact', 'major') as excluded, count(*) as n from k group by all")
def c24_policy_exclusion(spark, sf):
    return _overlap(spark, sf).groupBy("class", overlap.excluded(F.col("class")).alias("excluded")).agg(F.count("*").alias("n"))


@case("with s as (select l_suppkey as d, l_partkey as s from lineitem group by all) select x.d as a, y.d as b, string_agg(x.s::varchar, ',' order by x.s) as shared from s x join s y on x.s = y.s and x.d < y.d group by 1, 2")
def u04_array_intersection(spark, sf):
    return overlap.shared_lists(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey").select("a", "b", F.array_join(F.transform("shared", lambda v: v.cast("string")), ",").alias("shared"))


@case()
def j10_sample_matching(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("dataset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("accession"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")).alias("hash"))
    return overlap.matched_samples(rows, rows)


@case("with v as (select l_suppkey % 10 as stratum, l_suppkey as id, l_orderkey, row_number() over (partition by l_suppkey order by l_orderkey desc, l_linenumber desc) as r from lineitem), cur as (select id, l_orderkey, stratum from v where r = 1) select l.l_suppkey as id, count(*) as pairs from lineitem l join cur on cur.id = l.l_suppkey and cur.l_orderkey = l.l_orderkey group by 1")
def j15_current_version(spark, sf):
    rows = table(spark, sf, "lineitem")
    current = release.latest(rows, ["l_suppkey"], [F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_suppkey", "l_orderkey")
    return rows.join(current, ["l_suppkey", "l_orderkey"]).groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("pairs"))


@case("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 3)")
def j17_missing_endpoint(spark, sf):
    members = table(spark, sf, "part").filter("p_size > 3").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("m"))
    return table(spark, sf, "lineitem").join(members, "l_partkey", "left").filter("m is null").select("l_orderkey", "l_linenumber")


@case("select json_extract_string(e.props, '$.k') as k, count(*) as n, count(n_nationkey) as matched from events e left join nation on n_nationkey = try_cast(json_extract_string(e.props, '$.k') as int) group by 1")
def j21_json_path_join(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    joined = e.join(table(spark, sf, "nation"), F.col("k").try_cast("int") == F.col("n_nationkey"), "left")
    return joined.groupBy("k").agg(F.count("*").alias("n"), F.count("n_nationkey").alias("matched"))


# --- aggregates, windows, sets --------------------------------------------------------------------------------------


@case("select stratum, sha256(string_agg(k, chr(0) order by k) || chr(0)) as family from (select distinct o_custkey as stratum, 'O' || o_orderkey as k from orders) group by stratum")
def a02_ordered_set_hash(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("stratum"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("k")).distinct()
    return rows.groupBy("stratum").agg(ids.sorted_set_hash(F.collect_list("k")).alias("family"))


@case("select count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem")
def a05_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@case("select l_suppkey as pathway, count(distinct l_partkey) as size, min(l_returnflag) as first_flag from lineitem group by 1 having count(distinct l_partkey) between 200 and 600")
def a06_having_range(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("pathway")).agg(F.countDistinct("l_partkey").alias("size"), F.min("l_returnflag").alias("first_flag")).filter("size between 200 and 600")


@case("select o_orderstatus as status, count(*) as n from orders group by 1")
def a07_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@case("with u as (select label, i, embedding[i]::double as x from embeddings, range(1, 65) t(i)) select label, (i - 1)::int as feature, round(avg(x), 9) as mean, round(stddev_samp(x), 9) as sd from u group by all")
def a10_feature_moments(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "x"))
    return rows.groupBy("label", "feature").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_samp("x"), 9).alias("sd"))


@case("select d.lang as field, case when l.quality = 1 then 'concordant' when l.quality = 0 then 'mismatch' else 'missing' end as status, count(*) as n, l.quality is distinct from 1 as blocking from documents d left join labels l using (doc_id) group by all")
def a12_audit_matrix(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("field")).join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "concordant").when(F.col("quality") == 0, "mismatch").otherwise("missing")
    return rows.groupBy("field", status.alias("status")).agg(F.count("*").alias("n")).withColumn("blocking", F.col("status") != "concordant")


@case("with f as (select p_brand as brand, p_type as v, min(p_partkey) as o, min(p_size) as s, bool_or(p_size = 1) as u from part group by 1, 2) select brand, string_agg(v, ' / ' order by o) as label, min(s) as least_size, bool_or(u) as unreviewed from f group by brand")
def a13_multi_value_fold(spark, sf):
    first = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("v")).agg(F.min("p_partkey").alias("o"), F.min("p_size").alias("s"), F.bool_or(F.col("p_size") == 1).alias("u"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), " / ")
    return first.groupBy("brand").agg(joined.alias("label"), F.min("s").alias("least_size"), F.bool_or("u").alias("unreviewed"))


@case("select p_type as family, count(*) as n from part group by 1 order by n desc, family")
def a14_family_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


@case("select distinct p_type as value from part order by 1")
def a19_distinct_values(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("value")).distinct().orderBy("value")


@case("with r as (select o_orderkey, o_orderstatus, row_number() over (order by o_orderdate, o_orderkey) <= 500 as inside from orders) select case when inside then o_orderstatus else 'pending' end as status, count(*) as n from r group by 1")
def a20_budget_report(spark, sf):
    rows = table(spark, sf, "orders")
    inside = rows.orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey", F.lit(True).alias("i"))
    return rows.join(inside, "o_orderkey", "left").groupBy(F.when(F.col("i"), F.col("o_orderstatus")).otherwise("pending").alias("status")).agg(F.count("*").alias("n"))


@case(with_(NODES) + "select array_to_string(list_sort(list(distinct sample_count)), ',') as sizes from nodes where sample_count >= 2")
def a21_corpus_sizes(spark, sf):
    sizes = nodes(spark, sf).filter("sample_count >= 2").agg(F.array_sort(F.collect_set("sample_count")).alias("s"))
    return sizes.select(F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sizes"))


@case("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity)::double as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def a22_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@case("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def w06_latest_per_pair(spark, sf):
    return release.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@case("select l_orderkey, l_linenumber, (row_number() over (partition by l_orderkey order by l_linenumber) - 1)::int as position from lineitem")
def w08_row_position(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("position"))


@case("select l_partkey as feature from lineitem group by 1 having count(distinct l_returnflag || l_linestatus) = (select count(distinct l_returnflag || l_linestatus) from lineitem)")
def u02_feature_intersection(spark, sf):
    """Features that every dataset holds; a dataset is a pair of flags."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.concat("l_returnflag", "l_linestatus").alias("dataset"))
    every = rows.agg(F.countDistinct("dataset").alias("datasets"))
    return rows.groupBy("feature").agg(F.countDistinct("dataset").alias("d")).join(F.broadcast(every), F.col("d") == F.col("datasets"), "left_semi").select("feature")


@case("select o_custkey as id, 'new' as side from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P') union all select o_custkey, 'existing' from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P')")
def u03_key_set_difference(spark, sf):
    o = table(spark, sf, "orders")
    f, p = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FP")
    return f.subtract(p).withColumn("side", F.lit("new")).union(f.intersect(p).withColumn("side", F.lit("existing")))


@case("with e as (select unnest(embedding) as v, unnest(range(0, 64)) as i, vec_id from embeddings) select vec_id, string_agg(i::varchar, ',' order by i) as top from (select vec_id, i, row_number() over (partition by vec_id order by v desc, i) as r from e) where r <= 5 group by vec_id")
def t05_top_features(spark, sf):
    ranked = F.array_sort(F.transform(F.col("embedding"), lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    top = F.array_sort(F.transform(F.slice(ranked, 1, 5), lambda x: x["i"]))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(top, lambda i: i.cast("string")), ",").alias("top"))


@case("with l as (select doc_id, source, n_chars, row_number() over (partition by source, lang order by doc_id) as r, lang from documents) select doc_id, source, lang from l where r <= 4 order by source, lang, r limit 128")
def t11_characteristic_budget(spark, sf):
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return table(spark, sf, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 4").orderBy("source", "lang", "r").limit(128).select("doc_id", "source", "lang")


@case("select doc_id from labels where quality = 0 order by doc_id limit 50")
def t12_review_queue(spark, sf):
    return table(spark, sf, "labels").filter("quality = 0").orderBy("doc_id").limit(50).select("doc_id")


@case("select event_id, ts from events where ts <= timestamp '2024-01-15' and event_type <> 'view' order by ts, event_id limit 100")
def t13_due_jobs(spark, sf):
    return table(spark, sf, "events").filter("ts <= timestamp_ntz '2024-01-15' and event_type <> 'view'").orderBy("ts", "event_id").limit(100).select("event_id", "ts")


# --- scalar functions -----------------------------------------------------------------------------------------------


@case("select o_orderkey, 'pair_' || substr(sha256('ord' || chr(31) || o_orderkey || chr(31) || coalesce(o_orderstatus, '')), 1, 24) as id from orders")
def c01_stable_id(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ids.stable_id("pair", F.lit("ord"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"))


@case("select o_orderkey, least('c' || o_custkey, 'o' || o_orderkey) as a, greatest('c' || o_custkey, 'o' || o_orderkey) as b from orders")
def c02_ordered_pair(spark, sf):
    x, y = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    a, b = ids.ordered_pair(x, y)
    return table(spark, sf, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))


@case("select sha256(string_agg(p_name, chr(10) order by p_partkey)) as sha256, sha1(string_agg(p_name, chr(10) order by p_partkey)) as sha1 from part")
def c05_feature_hash(spark, sf):
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    return table(spark, sf, "part").agg(names.alias("n")).select(ids.ordered_hash(F.col("n")).alias("sha256"), ids.ordered_hash(F.col("n"), bits=1).alias("sha1"))


@case("select vec_id, sha1(array_to_string(list_transform(embedding, lambda x: (round(x::double * 1e6))::bigint::varchar), ',')) as hash from embeddings")
def c06_sample_hash(spark, sf):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.sha1(F.array_join(whole, ",")).alias("hash"))


@case("select doc_id, regexp_matches(lower(case when doc_id % 2 = 0 then sha256(source) else source end), '^[0-9a-f]{64}$') as valid, nullif(upper(trim('  ' || source || ' ')), '') as id from documents")
def c07_validate_and_normalise(spark, sf):
    value = F.when(F.col("doc_id") % 2 == 0, F.sha2("source", 256)).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", ids.is_sha256(value).alias("valid"), ids.normal_id(F.concat(F.lit("  "), F.col("source"), F.lit(" "))).alias("id"))


@case("select p_partkey, regexp_replace(lower(p_name || ' -- ' || p_type), '[^a-z0-9]', '', 'g') as term, substr(regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) as slug from part")
def c09_terms_and_slugs(spark, sf):
    name = F.concat("p_name", F.lit(" -- "), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", ids.ascii_term(name).alias("term"), ids.slug(name).alias("slug"))


@case("select p_partkey, string_split(p_brand || ':' || p_partkey, ':')[1] in ('Brand#11', 'Brand#12', 'Brand#21') as allowed from part")
def c10_prefix_check(spark, sf):
    prefix = F.substring_index(F.concat("p_brand", F.lit(":"), F.col("p_partkey").cast("string")), ":", 1)
    return table(spark, sf, "part").select("p_partkey", prefix.isin("Brand#11", "Brand#12", "Brand#21").alias("allowed"))


@case("select o_orderkey, 'GSE' || substr(o_orderkey::varchar, 1, greatest(length(o_orderkey::varchar) - 3, 0)) || 'nnn' as bucket from orders")
def c18_accession_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ids.accession_bucket(F.concat(F.lit("GSE"), F.col("o_orderkey").cast("string"))).alias("bucket"))


_PHI20 = "case when z = 0 then 0.5 else 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln(abs(z)) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())))) end"


@case(f"with z as (select p_partkey, (p_partkey % 1201 - 600) / 100.0::double as z from part) select p_partkey, round({_PHI20}, 9) as p from z")
def c20_normal_cdf(spark, sf):
    z = (F.col("p_partkey") % 1201 - 600) / 100.0
    return table(spark, sf, "part").select("p_partkey", z.alias("z")).select("p_partkey", F.round(stats.normal_cdf(F.col("z")), 9).alias("p"))


@case("""with x as (select p_partkey, p_size::double * 9 - 20 as x from part)
select p_partkey, round(case when x <= 5 then 1.0 when x < 20 then 1.0 + (2.5 - 1.0) * (x - 5) / 15 when x < 100 then 2.5 + (2.0 - 2.5) * (x - 20) / 80 when x < 400 then 2.0 + (6.0 - 2.0) * (x - 100) / 300 else 6.0 end, 9) as y from x""")
def c21_interpolation(spark, sf):
    grid, values = (F.array(*[F.lit(v) for v in vs]) for vs in ((5.0, 20.0, 100.0, 400.0), (1.0, 2.5, 2.0, 6.0)))
    return table(spark, sf, "part").select("p_partkey", F.round(stats.interpolate(F.col("p_size").cast("double") * 9 - 20, grid, values), 9).alias("y"))


_HITS = """u as (select p_partkey as gene from part), m as (select distinct l_suppkey as pathway, l_partkey as gene from lineitem where l_partkey in (select gene from u)),
r as (select p_partkey as gene from part where p_brand = (select min(p_brand) from part)),
n as (select (select count(*) from u) as n, (select count(*) from r) as d),
s as (select pathway, count(*) as size, count(*) filter (gene in (select gene from r)) as overlap from m group by 1),
t as (select s.*, n.n, n.d, list_sum(list_transform(range(overlap, least(size, d) + 1), lambda i: exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma(d - i + 1) - lgamma(n - size - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)))) as tail from s, n where size between 10 and 2000),
pv as (select *, round(least(1.0, tail), 9) as p from t), rk as (select *, p * count(*) over () / row_number() over (order by p, pathway) as raw, row_number() over (order by p, pathway) as r from pv),
qv as (select *, round(least(1.0, min(raw) over (order by r desc rows unbounded preceding)), 9) as q from rk)"""


@case("with " + _HITS + " select pathway, size::int as size, overlap::int as overlap, round(size * d::double / n, 9) as expected, round(overlap / (size * d::double / n), 9) as fold, p, q from qv where overlap >= 1")
def m21_enrichment(spark, sf):
    part = table(spark, sf, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    members = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pathway"), F.col("l_partkey").alias("gene"))
    return enrich.enrichment(members, part.select(F.col("p_partkey").alias("gene")), part.filter(F.col("p_brand") == brand).select(F.col("p_partkey").alias("gene")), 10, 2_000)


@case("with " + _HITS + " select pathway, p, q from qv where overlap >= 5 order by q, p, -(overlap / (size * d::double / n)), pathway limit 20")
def t07_pathway_order(spark, sf):
    return m21_enrichment(spark, sf).filter("overlap >= 5").orderBy("q", "p", F.desc("fold"), "pathway").limit(20).select("pathway", "p", "q")


@case("select event_id, event_type || '_' || user_id as forward, user_id || '_' || event_type as backward, json_extract_string(props, '$.k') as k, round(1 / (1 + abs(value)), 9) as similarity, concat_ws(' ', nullif(event_type, ''), nullif(trim(' '), ''), nullif(props, '')) as description from events")
def c25_event_texts(spark, sf):
    blank = F.nullif(F.trim(F.lit(" ")), F.lit(""))
    user = F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        "event_id", F.concat_ws("_", "event_type", user).alias("forward"), F.concat_ws("_", user, "event_type").alias("backward"), F.get_json_object("props", "$.k").alias("k"),
        F.round(1 / (1 + F.abs("value")), 9).alias("similarity"), F.concat_ws(" ", F.nullif("event_type", F.lit("")), blank, F.nullif("props", F.lit(""))).alias("description"),
    )


@case("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') < '2024-01-10T00:00:00Z' as early from events")
def c26_clock_text(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp"), (stamp < "2024-01-10T00:00:00Z").alias("early"))


@case("""with b as (select event_id, least(86400, (30 * pow(2, greatest(event_id % 15, 1) - 1))::bigint) as base, ('0x' || substr(sha256(event_id::varchar), 1, 8))::bigint as h from events)
select event_id, (base + h % greatest(floor(base / 4)::bigint, 1))::bigint as seconds from b""")
def c27_backoff(spark, sf):
    return table(spark, sf, "events").select("event_id", ids.backoff_seconds((F.col("event_id") % 15).cast("int"), F.col("event_id")).cast("long").alias("seconds"))


@case("select event_id, coalesce(case when isfinite(value) then value end, 0.0) as value, coalesce(nullif(trim(event_type), ''), 'unknown') as kind from events")
def c33_coercion(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.when(matrix.finite(F.col("value")), F.col("value")), F.lit(0.0)).alias("value"), F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("unknown")).alias("kind"))


@case("with r as (select doc_id, source, case when doc_id % 3 = 0 then 'accepted' else 'unreviewed' end as state from documents), m as (select source, bool_or(state = 'accepted' ) as a from r group by 1) select r.doc_id, r.source, r.state from r join m using (source) where state = 'accepted' or not a")
def c32_annotation_selection(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "accepted").otherwise("unreviewed").alias("state"))
    return annotate.selected(rows, ["source"])


# --- matrices -------------------------------------------------------------------------------------------------------

_LONG = "mat as (select l_suppkey % 4 as dataset, l_orderkey as sample, l_partkey % 40 as feature, l_orderkey * 10 + l_linenumber as row, case when l_linenumber = 5 and l_partkey % 40 < 25 then 'nan'::double else l_quantity end as value from lineitem)"


def _matrix(spark, sf, *more) -> DataFrame:
    value = F.when((F.col("l_linenumber") == 5) & (F.col("l_partkey") % 40 < 25), float("nan")).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("dataset"), F.col("l_orderkey").alias("sample"), (F.col("l_partkey") % 40).alias("feature"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), value.alias("value"), *more)


@case("with " + _LONG + """, f as (select dataset, feature, count(*) as n, count(*) filter (not isnan(value)) as k, var_samp(value) filter (not isnan(value)) as v from mat group by 1, 2), s as (select dataset, count(distinct sample) as samples from mat group by 1),
a as (select dataset, sum(n)::bigint as cells, (sum(n) - sum(k))::bigint as nonfinite, max(coalesce(v, 0)) as largest from f group by 1)
select dataset, samples, cells, nonfinite, case when samples < 2 then 'too few samples' when nonfinite > 0.01 * cells then 'too many missing' when largest <= 1e-12 then 'no variance' else 'ok' end as status from a join s using (dataset)""")
def f20_matrix_quality(spark, sf):
    return matrix.quality(_matrix(spark, sf))


@case("with " + _LONG + " select dataset, sample, feature, row, round(case when not isnan(value) then value else coalesce(avg(value) filter (not isnan(value)) over (partition by dataset, feature), 0.0) end, 9) as value from mat")
def f20_imputed(spark, sf):
    return matrix.impute(_matrix(spark, sf)).withColumn("value", F.round("value", 9))


@case("with " + _LONG + """, feats as (select range as feature from range(0, 50, 2)), cells as (select dataset, sample, feature, arg_min(value, row) as value from mat group by 1, 2, 3), g as (select distinct dataset, sample from mat)
select g.dataset, g.sample, feats.feature, cells.value from g cross join feats left join cells on cells.dataset = g.dataset and cells.sample = g.sample and cells.feature = feats.feature""")
def f21_alignment(spark, sf):
    feats = spark.range(0, 50, 2).select(F.col("id").alias("feature"))
    # row numbers repeat: arg_min keeps the cell that is stored first
    stored = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    return matrix.align(_matrix(spark, sf, *stored), feats, ("file", "at"))


@case("with " + _LONG + ", h as (select distinct dataset, feature from mat) select dataset, count(*) filter (feature % 2 = 0) as present, 25 - count(*) filter (feature % 2 = 0) as missing, count(*) filter (feature % 2 <> 0) as extra from h group by 1")
def f21_alignment_counts(spark, sf):
    return matrix.alignment_counts(_matrix(spark, sf), spark.range(0, 50, 2).select(F.col("id").alias("feature")))


@case("with " + _LONG + " select feature from mat group by 1 having bool_and(not isnan(value)) and count(distinct dataset) = 4")
def f22_finite_everywhere(spark, sf):
    return matrix.finite_everywhere(_matrix(spark, sf), 4)


@case("with h as (select c_custkey as dataset, md5(floor(c_acctbal)::bigint::varchar) as h from customer), bad as (select distinct x.dataset from h x join h y on x.h = y.h and x.dataset <> y.dataset) select distinct dataset from h where dataset not in (select dataset from bad)")
def f23_shared_profile_drop(spark, sf):
    """Datasets none of whose profiles is another's; a dataset is a customer, its profile the whole units of a balance."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset"), F.md5(F.floor("c_acctbal").cast("string").cast("binary")).alias("h"))
    return overlap.unshared(rows, "dataset", "h")


@case("with e as (select l_suppkey as a, l_partkey as b, l_discount as f, l_linenumber as n from lineitem) select 'fraction' as \"check\", count(*) filter (not (f between 0 and 0.09)) as violations, count(*) filter (not (f between 0 and 0.09)) = 0 as passed from e union all select 'duplicate', count(*), count(*) = 0 from (select a, b, n from e group by 1, 2, 3 having count(*) > 1)")
def f24_guards(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("f"), F.col("l_linenumber").alias("n"))
    return release.checks({"fraction": e.filter(~F.col("f").between(0, 0.09)), "duplicate": e.groupBy("a", "b", "n").count().filter("count > 1")})


# --- evidence and annotations ---------------------------------------------------------------------------------------

_SPANS = "q as (select b.item_id, d.doc_id, d.text as src, b.text as quote from benchmark b join documents d on contains(d.text, b.text))"


def _quotes(spark, sf):
    quotes = table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("quote"))
    sources = table(spark, sf, "documents").select("doc_id", F.col("text").alias("src"))
    return annotate.quoted(sources, "doc_id", "src", quotes, "item_id", "quote")


@case("with " + _SPANS + " select item_id, doc_id, (strpos(src, quote) - 1)::int as start, (strpos(src, quote) - 1 + length(quote))::int as stop from q")
def n02_span_search(spark, sf):
    """Every whole benchmark text in every whole document."""
    start, stop = annotate.span_of(F.col("src"), F.col("quote"))
    return _quotes(spark, sf).select("item_id", "doc_id", start.alias("start"), stop.alias("stop"))


@case("with " + _SPANS + ", s as (select *, strpos(src, quote) - 1 + case when doc_id % 3 = 0 then 1 else 0 end as a from q) select item_id, doc_id, a >= 0 and substr(src, a + 1, length(quote)) = quote as holds from s")
def n03_span_validation(spark, sf):
    a = F.position(F.col("quote"), F.col("src")) - 1 + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return _quotes(spark, sf).select("item_id", "doc_id", annotate.span_holds(F.col("src"), a, a + F.length("quote"), F.col("quote")).alias("holds"))


@case("select conv_id, turn, 'turns.' || turn || '.' || role as field, substr(text, 1, 20) as value from conversations")
def n01_evidence_flattening(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.concat_ws(".", F.lit("turns"), F.col("turn").cast("string"), "role").alias("field"), F.substring("text", 1, 20).alias("value"))


@case("select n_nationkey, case n_name when 'FRANCE' then 9606 when 'GERMANY' then 10090 when 'JAPAN' then 10116 end as taxon from nation")
def n07_exact_map(spark, sf):
    known = spark.createDataFrame([("FRANCE", 9606), ("GERMANY", 10090), ("JAPAN", 10116)], "n_name string, taxon int")
    return table(spark, sf, "nation").join(F.broadcast(known), "n_name", "left").select("n_nationkey", "taxon")


@case("""with t as (select p_partkey as id, p_name as name, p_size > 45 as obsolete from part), l as (select distinct upper(p_name) || '.' as label from part union select distinct p_type from part),
k as (select l.label, count(distinct t.id) as n, min(t.id) as one from l left join t on not t.obsolete and regexp_replace(lower(t.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(l.label), '[^a-z0-9]', '', 'g') group by 1)
select label, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as status, case when n = 1 then one end as term from k""")
def n09_label_resolution(spark, sf):
    part = table(spark, sf, "part")
    terms = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 45).alias("obsolete"))
    labels = part.select(F.concat(F.upper("p_name"), F.lit(".")).alias("label")).union(part.select("p_type")).distinct()
    return annotate.resolve(labels, terms, ids.ascii_term)


@case("""with t as (select p_partkey as id, p_type as name, p_size > 40 as obsolete from part), c as (select doc_id, 1 + doc_id % 2500 as id, case when doc_id % 3 = 0 then null else 'x' end as label from documents)
select c.doc_id, case when t.id is null then 'not_in_release' when c.label is null then 'missing' when t.obsolete then 'obsolete' when length(t.name) % 2 = 0 then 'concordant' else 'mismatch' end as status from c left join t on t.id = c.id""")
def n11_candidate_audit(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), (F.col("p_size") > 40).alias("obsolete"))
    rows = table(spark, sf, "documents").select("doc_id", (1 + F.col("doc_id") % 2500).alias("cid"), F.when(F.col("doc_id") % 3 != 0, "x").alias("label"))
    joined = rows.join(terms, F.col("cid") == F.col("id"), "left")
    return joined.select("doc_id", F.when(F.col("id").isNull(), "not_in_release").when(F.col("label").isNull(), "missing").when(F.col("obsolete"), "obsolete").when(F.length("name") % 2 == 0, "concordant").otherwise("mismatch").alias("status"))


@case("""with e as (select doc_id as k, case when quality = 1 then 'accepted' else 'unreviewed' end as state, case when toxic = 1 then 'human' end as reviewer from labels), n as (select doc_id as k from documents where doc_id % 2 = 0)
select k, case when reviewer is null and state = 'unreviewed' and k % 2 <> 0 then 'superseded' else state end as state, reviewer from e union all select k, 'unreviewed', null from n where k not in (select k from e)""")
def n12_replace_generated(spark, sf):
    existing = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), F.when(F.col("quality") == 1, "accepted").otherwise("unreviewed").alias("state"), F.when(F.col("toxic") == 1, "human").alias("reviewer"))
    new = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.lit("unreviewed").alias("state"), F.lit(None).cast("string").alias("reviewer"))
    return annotate.replace_generated(existing, new, ["k"])


@case("with c as (select conv_id, list(distinct turn) as cited from conversations group by 1) select conv_id, len(list_filter(cited, lambda t: t not in (0, 1, 2))) as uncited, len(cited)::int as n from c")
def n16_citation_check(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("cited"))
    return rows.select("conv_id", F.size(F.array_except("cited", F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)]))).cast("long").alias("uncited"), F.size("cited").alias("n"))


@case("with g as (select l_orderkey as id, list(p_name order by l_linenumber, p_name) as names from lineitem join part on p_partkey = l_partkey group by 1) select id, len(list_filter(names, lambda x: contains(lower(x), 'a 1') or contains(lower(x), '7'))) > 0 as found, array_to_string(names[1:3], '|') as shown from g")
def n18_mechanism_search(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    g = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]).alias("names"))
    return g.select("id", F.exists("names", lambda x: F.lower(x).contains("a 1") | F.lower(x).contains("7")).alias("found"), F.array_join(F.slice("names", 1, 3), "|").alias("shown"))


# --- releases -------------------------------------------------------------------------------------------------------


@case("with e as (select c_custkey as k, 'old' as v from customer where c_custkey % 2 = 0), n as (select o_custkey as k, max(o_orderstatus) as v from orders group by 1) select k, v from n where k not in (select k from e)")
def d03_insert_ignore(spark, sf):
    existing = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return release.insert_ignore(existing, new, ["k"], [F.desc("v")])


@case("with e as (select c_custkey as k, c_mktsegment as v, c_acctbal as d from customer), n as (select o_custkey as k, max(o_orderstatus) as v from orders group by 1) select coalesce(n.k, e.k) as k, coalesce(n.v, e.v) as v, case when n.k is null then e.d end as d from e full join n on e.k = n.k")
def d04_upsert(spark, sf):
    existing = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_acctbal").alias("d"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderstatus").alias("v"))
    return release.upsert(existing, new, ["k"], [F.asc("v")], reset=("d",))


@case("select o_custkey as k, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as current, count(*) - 1 as superseded from orders group by 1")
def d02_promote_version(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"), (F.count("*") - 1).alias("superseded"))


@case("select event_id, case when event_type = 'view' and ts < timestamp '2024-01-10' then 'expired' when value > 90 then 'dead' when event_id % 7 = 0 then 'retry' else 'running' end as state from events")
def d12_job_states(spark, sf):
    state = F.when((F.col("event_type") == "view") & (F.col("ts") < F.expr("timestamp_ntz '2024-01-10'")), "expired").when(F.col("value") > 90, "dead").when(F.col("event_id") % 7 == 0, "retry").otherwise("running")
    return table(spark, sf, "events").select("event_id", state.alias("state"))


@case("""select 'orphan lines' as "check", count(*) as violations, count(*) = 0 as passed from lineitem where l_orderkey not in (select o_orderkey from orders) union all
select 'negative price', count(*), count(*) = 0 from orders where o_totalprice < 0 union all select 'customers without orders', count(*), count(*) = 0 from customer where c_custkey not in (select o_custkey from orders)""")
def d13_release_audit(spark, sf):
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    return release.checks({
        "orphan lines": li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "negative price": o.filter("o_totalprice < 0"),
        "customers without orders": c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
    })


@case("select x.l_orderkey as id, x.l_suppkey is not distinct from y.l_suppkey and x.l_partkey is not distinct from y.l_partkey as valid from (select * from lineitem where l_linenumber = 1) x left join (select * from lineitem where l_linenumber = 2) y using (l_orderkey)")
def d17_cache_validity(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.filter("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_partkey")
    y = li.filter("l_linenumber = 2").select("l_orderkey", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return x.join(y, "l_orderkey", "left").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey").eqNullSafe(F.col("s")) & F.col("l_partkey").eqNullSafe(F.col("p"))).alias("valid"))


_SECRETS = {"aws": "AKIA[0-9A-Z]{16}", "private": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "token": "gh[pousr]_[A-Za-z0-9]{20,}", "password": "(?i)password[[:space:]]*[:=]", "assigned": '(?i)(token|secret|api_key)[[:space:]]*[:=][[:space:]]*"[0-9a-f]{16,}"'}


@case(" union all ".join(f"select doc_id, '{k}' as marker from documents where regexp_matches(text, '{p}')" for k, p in _SECRETS.items()))
def d21_credential_scan(spark, sf):
    docs = table(spark, sf, "documents")
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p.replace("[[:space:]]", r"\s")), k) for k, p in _SECRETS.items()]))
    return docs.select("doc_id", F.explode(found).alias("marker"))
