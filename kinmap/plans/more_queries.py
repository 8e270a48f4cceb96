"""Further queries: loaders, exports, lookups, state changes and compositions."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmap.functions import facets, ids, stats
from kinmap.functions.lineage import cut
from kinmap.operators import annotate, discovery, enrich, explanation, graph, matrix, overlap, pairs, release, signature
from kinmap.operators.query import compile_query, execute
from kinmap.plans import frames, graph_queries
from kinmap.plans.frames import CAL, NODES, PAIRS, calibrated, nodes, table, text_pairs, with_
from kinmap.sources import sinks

Q = {}
S = {}


def case(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@case("select event_id, (json_extract_string(props, '$.k'))::int as k from events")
def s12_json_documents(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"].alias("k"))


@case("select r_name as region, count(*) as nations from region join nation on n_regionkey = r_regionkey group by 1")
def s14_catalog_views(spark, sf):
    for name in ("region", "nation"):
        table(spark, sf, name).createOrReplaceTempView(f"kinmap_{name}")
    return spark.sql("select r_name as region, count(*) as nations from kinmap_region join kinmap_nation on n_regionkey = r_regionkey group by r_name")


@case(with_(CAL) + "select a, b, score, least(1.0, greatest(0.0, p * 1.2 - 0.1)) as p, least(1.0, greatest(0.0, q * 1.1 - 0.1)) as q from cal where a % 10 <> 3 and b % 10 <> 3 and a % 17 <> 0")
def s32_published_loader(spark, sf):
    rows = calibrated(spark, sf).select("a", "b", F.when(F.col("a") % 17 == 0, float("nan")).otherwise(F.col("score")).alias("score"), (F.col("p") * 1.2 - 0.1).alias("p"), (F.col("q") * 1.1 - 0.1).alias("q"))
    return discovery.loaded_edges(rows, nodes(spark, sf).filter("id % 10 <> 3"))


@case(with_(CAL) + "select 'duplicates' as \"check\", 0::bigint as violations, true as passed union all select 'family', 0, true union all select 'finite', 0, true union all select 'recomputed q', 0, true")
def s34_release_import(spark, sf):
    rows = calibrated(spark, sf).select("a", "b", "score", "p", "q")
    again = stats.benjamini_hochberg(rows, "p", "q2").withColumn("q2", F.round("q2", 9))
    n = nodes(spark, sf).agg(F.count("*").alias("n"))
    short = rows.agg(F.count("*").alias("k")).crossJoin(n).filter("k <> n * (n - 1) div 2")
    bad = ~(matrix.finite(F.col("score")) & matrix.finite(F.col("p")) & matrix.finite(F.col("q")))
    return release.checks({"duplicates": rows.groupBy("a", "b").count().filter("count > 1"), "family": short, "finite": rows.filter(bad), "recomputed q": again.filter("abs(q - q2) > 1e-12")})


@case()
def k07_signature_metadata(spark, sf):
    return sinks.signature_metadata(signature.signatures(table(spark, sf, "embeddings"), "label", "embedding"))


@case()
def k08_static_export(spark, sf):
    """The graph as one JSON row: a bounded drawing of the strongest edges with its nodes, and their checksum."""
    edges = graph_queries.t02_union_topk(spark, sf).orderBy("q", "score", "a", "b").limit(500)
    return sinks.static_graph(nodes(spark, sf), edges, ["id", "accession", "community"], ["a", "b", "q", "score"])


@case("select l_orderkey as id, string_agg(string_split(p_name, ' ')[1] || case when contains(p_type, 'A') then '*' else '' end, ',' order by l_linenumber, p_partkey) as features from lineitem join part on p_partkey = l_partkey group by 1")
def k09_explainer_projection(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return discovery.projected_features(rows, "l_orderkey", ["l_linenumber", "p_partkey"], F.col("p_name"), F.col("p_type").contains("A"))


def _view(spark, sf):
    return graph_queries._view(spark, sf)


@case(with_(CAL) + graph_queries._TERMS + ", f as (select a, b, q, score from v where q <= 1 and percentile >= 0.9 order by q, score, a, b limit 101 offset 50) select a, b, q, score, (select count(*) from f) > 100 as has_more from f order by q, score, a, b limit 100")
def f10_query_page(spark, sf):
    query = compile_query({"and": [{"edge.q_value": {"lte": 1.0}}, {"edge.score_percentile": {"gte": 0.9}}]})
    rows = execute(_view(spark, sf), query, limit=100, offset=50, probe=True).select("a", "b", "q", "score")
    total = rows.agg((F.count("*") > 100).alias("has_more"))
    return rows.orderBy("q", "score", "a", "b").limit(100).crossJoin(F.broadcast(total))


@case(with_(CAL) + graph_queries._TERMS + f" select a, b, q, score from v where q <= 1 and percentile >= 0.8 and {graph_queries._HAS.format('a', 'tissue')} and {graph_queries._HAS.format('b', 'tissue')} and {graph_queries._SHARED.format('tissue')} order by q, score, a, b limit 5000")
def f17_discovery_query(spark, sf):
    return graph_queries._run(spark, sf, discovery.discovery_ast(q_max=1.0, percentile=0.8, relation="same_tissue"))


@case(with_(CAL) + graph_queries._TERMS + " select a, b, q, score from v where percentile >= 0.95 and exists (select 1 from ok where field = 'tissue' and contains(term, 'ski') and ok.id in (a, b)) order by q, score, a, b limit 5000")
def f17_discovery_contains(spark, sf):
    return graph_queries._run(spark, sf, discovery.discovery_ast(percentile=0.95, tissue=" Ski "))


@case("select event_id, case when event_type = 'click' and isfinite(value) then value end as text from events")
def f19_computed_text(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select("event_id", discovery.computed_text(F.col("value"), F.when(F.col("event_type") == "click", "computed").otherwise("given")).alias("text"))


@case(with_(PAIRS) + "select case when a % 10 = 0 then a else b end as a, case when a % 10 = 0 then b else a end as b, cosine from pairs where (a % 10 = 0) <> (b % 10 = 0)")
def j11_cross_scoring(spark, sf):
    """Every new vector with every old one: a tenth of the table, spread over it, is new."""
    rows = table(spark, sf, "embeddings")
    out = pairs.cross_pairs(rows.filter("vec_id % 10 = 0"), rows.filter("vec_id % 10 <> 0"), "vec_id", "embedding")
    return out.select("a", "b", F.round("value", 6).alias("cosine"))


@case(with_(PAIRS) + "select a, count(*) as partners from pairs group by a")
def j12_upper_triangle(spark, sf):
    return text_pairs(spark, sf).groupBy("a").agg(F.count("*").alias("partners"))


@case("""with f as (select s_suppkey as id, (2 + (s_suppkey * 7) % 60)::double as size, [5.0 + s_suppkey % 3, 20.0, 45.0] as grid, [1.0, 2.0 + s_suppkey % 5, 1.5] as mu from supplier),
x as (select a.id as a, b.id as b, b.size as xb, a.grid as g, a.mu as m from f a join f b on a.id < b.id)
select a, b, round(case when xb <= g[1] then m[1] when xb < g[2] then m[1] + (m[2] - m[1]) * (xb - g[1]) / (g[2] - g[1]) when xb < g[3] then m[2] + (m[3] - m[2]) * (xb - g[2]) / (g[3] - g[2]) else m[3] end, 9) as mu from x""")
def j14_profile_lookup(spark, sf):
    key = F.col("s_suppkey")
    f = table(spark, sf, "supplier").select(key.alias("id"), (2 + (key * 7) % 60).cast("double").alias("size"), F.array(5.0 + key % 3, F.lit(20.0), F.lit(45.0)).alias("grid"), F.array(F.lit(1.0), 2.0 + key % 5, F.lit(1.5)).alias("mu"))
    both = f.select(F.col("id").alias("a"), "grid", "mu").join(f.select(F.col("id").alias("b"), "size"), F.expr("a < b"))
    return both.select("a", "b", F.round(stats.interpolate(F.col("size"), F.col("grid"), F.col("mu")), 9).alias("mu"))


@case(with_(CAL) + ", wanted as (select a, b from cal where percentile >= 0.98), m as (select id from nodes where label <> 4) select w.a, w.b, c.q, count(*) over () = (select count(*) from wanted) as all_there from wanted w join cal c on c.a = w.a and c.b = w.b where w.a in (select id from m) and w.b in (select id from m)")
def j16_member_edges(spark, sf):
    rows = calibrated(spark, sf)
    members = nodes(spark, sf).filter("label <> 4").select("id")
    return graph.member_edges(rows.filter("percentile >= 0.98").select("a", "b"), rows.select("a", "b", "q"), members).select("a", "b", "q", "all_there")


@case("select distinct l_suppkey as pathway, l_partkey as gene from lineitem where l_partkey in (select p_partkey from part where p_size = 7) and l_partkey % 2 = 0")
def j20_gene_set(spark, sf):
    genes = table(spark, sf, "part").filter("p_size = 7 and p_partkey % 2 = 0").select(F.col("p_partkey").alias("gene"))
    return enrich.gene_pathways(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pathway"), F.col("l_partkey").alias("gene")), genes)


@case(with_(CAL) + ", s as (select id from nodes where id % 9 = 0) select (select count(*) from s) as datasets, count(*) as edges, count(*) filter (q <= 0.99999) as significant, count(*) filter (coalesce(overlap_class, 'none') <> 'none') as overlapping, count(text_percentile) as text_scored from cal where a in (select id from s) and b in (select id from s)")
def a15_selection_summary(spark, sf):
    chosen = nodes(spark, sf).filter("id % 9 = 0").select("id")
    edges = calibrated(spark, sf, ("a", "b", "q", "percentile"), members=chosen)
    counts = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("q") <= 0.99999).alias("significant"), F.count_if(F.coalesce("overlap_class", F.lit("none")) != "none").alias("overlapping"), F.count("text_percentile").alias("text_scored"))
    return chosen.agg(F.count("*").alias("datasets")).crossJoin(counts)


@case(with_(CAL) + """, f as (select a, b, p, a % 5 as family from cal), r as (select *, row_number() over (partition by family order by p, a, b) as k, count(*) over (partition by family) as n from f)
select family, a, b, round(least(1.0, min(p * n / k) over (partition by family order by k desc rows unbounded preceding)), 9) as q from r""")
def w03_bh_by_family(spark, sf):
    rows = calibrated(spark, sf).select((F.col("a") % 5).alias("family"), "a", "b", "p")
    return stats.benjamini_hochberg(rows, "p", "q", by=("family",)).select("family", "a", "b", F.round("q", 9).alias("q"))


@case()
def w10_trajectory(spark, sf):
    """Best, worst and random objective at every size, for every pair of datasets."""
    sig = cut(signature.signatures(table(spark, sf, "embeddings"), "label", "embedding"))
    out = signature.explain(signature.scores(sig, sig), sig, k=20).select("a", "b", F.explode("trajectory").alias("t"))
    return out.select("a", "b", "t.k", *[F.round(f"t.{c}_objective", 6).alias(c) for c in ("best", "worst", "random")])


@case("select user_id, event_id, lag(event_id) over w as before, lead(event_id) over w as after, ntile(4) over w as quarter, dense_rank() over (partition by user_id order by event_type) as kind from events window w as (partition by user_id order by ts, event_id)")
def w11_other_windows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind"))


@case("(select l_partkey as id from lineitem where l_returnflag = 'A' except all select l_partkey from lineitem where l_returnflag = 'R') union all (select l_partkey from lineitem where l_returnflag = 'A' and l_linenumber = 1 intersect all select l_partkey from lineitem where l_returnflag = 'R' and l_linenumber = 1)")
def u07_multiset_operations(spark, sf):
    rows = table(spark, sf, "lineitem")
    side = lambda f, more="true": rows.filter((F.col("l_returnflag") == f) & F.expr(more)).select(F.col("l_partkey").alias("id"))
    return side("A").exceptAll(side("R")).unionAll(side("A", "l_linenumber = 1").intersectAll(side("R", "l_linenumber = 1")))


@case("select n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' as json from nation")
def c03_canonical_json(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("json"))


@case("select p_brand as brand, sha256('features-v1' || chr(10) || string_agg(p_name, chr(10) order by p_partkey)) as forward, sha256('features-v1' || chr(10) || string_agg(p_name, chr(10) order by p_partkey desc)) as backward from part group by 1")
def c04_fingerprints(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("n"))
    digest = lambda v: ids.ordered_hash(F.concat(F.array(F.lit("features-v1")), v))
    return g.select("brand", digest(F.col("n")).alias("forward"), digest(F.reverse("n")).alias("backward"))


@case(with_(NODES) + f"select id, case when id % 3 = 0 then {facets.sql_disease('disease')} end as family from nodes")
def c13_concordant_facet(spark, sf):
    return nodes(spark, sf).select("id", F.when(F.col("id") % 3 == 0, facets.disease_family(F.col("disease"))).alias("family"))


@case("""with h as (select p_partkey, list_reduce(list_concat([2166136261::bigint], list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((xor(h, c) * 16777619) & 4294967295)) as h from part)
select p_partkey, abs(case when h >= 2147483648 then h - 4294967296 else h end) % 360 as hue from h""")
def c15_colour_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", discovery.hue(F.col("p_name")).alias("hue"))


@case("select s_suppkey, case s_nationkey % 6 when 0 then 'circle' when 1 then 'square' when 2 then 'diamond' when 3 then 'triangle' when 4 then 'hexagon' else 'cross' end as shape from supplier")
def c16_shape_map(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", discovery.shape_of(F.col("s_nationkey")).alias("shape"))


@case("with p as (select p_partkey, case when p_partkey % 50 = 0 then 0.0::double when p_partkey % 3 = 0 then p_partkey / 7e6 else p_partkey / 2001.0 end as p from part) select p_partkey, case when p = 0 then '0' when p < 0.001 then regexp_replace(printf('%.2e', p), 'e([+-])0?(\\d+)$', 'e\\1\\2') else printf('%.3f', p) end as shown from p")
def c17_probability_format(spark, sf):
    k = F.col("p_partkey")
    p = F.when(k % 50 == 0, 0.0).when(k % 3 == 0, k / 7e6).otherwise(k / 2001.0)
    return table(spark, sf, "part").select("p_partkey", p.alias("p")).select("p_partkey", discovery.shown_probability(F.col("p")).alias("shown"))


@case("with g as (select l_orderkey as id, p_brand as gene, max(l_extendedprice) as s from lineitem join part on p_partkey = l_partkey group by 1, 2) select id, 'Order ' || id || ': ' || string_agg(gene, ', ' order by s desc, gene) as prompt from g group by id")
def c31_prompt_text(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return discovery.prompt_text(rows, "l_orderkey", "p_brand", "l_extendedprice", "Order")


# --- kernels as compositions ----------------------------------------------------------------------------------------


@case("select vec_id, label from embeddings order by sha256('pool-11|' || vec_id) limit 200")
def m09_pool(spark, sf):
    """A pool of 200 rows of the corpus, the first in the order of a seeded hash."""
    draw = F.sha2(F.concat(F.lit("pool-11|"), F.col("vec_id").cast("string")), 256)
    return table(spark, sf, "embeddings").orderBy(draw).limit(200).select("vec_id", "label")


@case()
def m15_network(spark, sf):
    from kinmap.plans.kernel_queries import m12_bootstrap_pvalues

    return stats.benjamini_hochberg(m12_bootstrap_pvalues(spark, sf), "p", "q").filter("q <= 1").select("a", "b", "score", "p", F.round("q", 6).alias("q"))


@case()
def m19_edge_explanations(spark, sf):
    """Best and worst features of every pair with the names they stand for."""
    sig = cut(signature.signatures(table(spark, sf, "embeddings"), "label", "embedding"))
    out = signature.explain(signature.scores(sig, sig), sig, k=6)
    named = table(spark, sf, "part").select((F.col("p_partkey") - 1).cast("int").alias("feature"), F.col("p_name").alias("name"))
    sides = [out.select("a", "b", F.lit(s).alias("side"), F.posexplode(s).alias("place", "feature")) for s in ("best", "worst")]
    return sides[0].unionByName(sides[1]).join(named, "feature").select("a", "b", "side", "place", "feature", "name")


@case()
def m20_explanation_artifact(spark, sf):
    """Explanations as stored artifacts: written under a hash of all they depend on, and only missing ones made again."""
    sig = cut(signature.signatures(table(spark, sf, "embeddings"), "label", "embedding"))
    pairs = signature.scores(sig, sig).select("a", "b")
    done = explanation.replay(pairs, sig, None, k=6)
    again = explanation.replay(pairs, sig, done, k=6)
    return again.select("a", "b", "dependency", "made", F.sha2("payload", 256).alias("sha256"))


@case("with f as (select vec_id, i - 1 as feature, embedding[i]::double as score from embeddings, range(1, 65) t(i)) select vec_id, feature::int as feature, score, p_name as name, p_partkey % 5 = 0 as ambiguous from f join part on p_partkey = feature + 1")
def m22_feature_records(spark, sf):
    f = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "score"))
    names = table(spark, sf, "part").select((F.col("p_partkey") - 1).cast("int").alias("feature"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5 == 0).alias("ambiguous"))
    return annotate.feature_records(f, names).select("vec_id", "feature", "score", "name", "ambiguous")


@case("with o as (select o_orderkey as a, o_custkey as b from orders), m as (select l_orderkey || '_' || l_suppkey as k, min(l_partkey) as v from lineitem group by 1) select a, b, coalesce(x.v, y.v) as v from o left join m x on x.k = a || '_' || b left join m y on y.k = b || '_' || a")
def m23_analysis_merge(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    m = table(spark, sf, "lineitem").groupBy(F.concat_ws("_", "l_orderkey", "l_suppkey").alias("k")).agg(F.min("l_partkey").alias("v"))
    return release.merged_analysis(o, m, "k", "v")


@case()
def d15_assemble(spark, sf):
    """One run: signatures, shared samples, scores, p, and q over all pairs and over those without a shared sample."""
    from kinmap.plans.kernel_queries import m12_bootstrap_pvalues

    rows = m12_bootstrap_pvalues(spark, sf)
    samples = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("d"), (F.col("vec_id") % 60).alias("s"))
    shared = overlap.overlap_counts(samples, "d", "s")
    rows = rows.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    rows = stats.benjamini_hochberg(rows, "p", "q").withColumn("pi", F.when(F.col("shared") < 5, F.col("p")))
    return stats.benjamini_hochberg(rows, "pi", "independent_q").select("a", "b", "score", "p", "shared", F.round("q", 6).alias("q"), F.round("independent_q", 6).alias("independent_q"))


@case()
def d16_ingest(spark, sf):
    """Align, check, impute and fit; datasets that fail the check are set aside with the reason."""
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("dataset"), F.col("vec_id").alias("sample"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))
    rows = rows.filter("dataset <> 3 or sample % 500 < 4").withColumn("value", F.when((F.col("dataset") == 5) & (F.col("sample") % 7 == 0), float("nan")).otherwise(F.col("value")))
    status = matrix.quality(rows)
    good = matrix.impute(rows.join(status.filter("status = 'ok'").select("dataset"), "dataset", "left_semi"))
    vectors = good.groupBy("dataset", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"]).alias("v"))
    sig = signature.signatures(vectors, "dataset", "v").select("dataset", F.size("weights").alias("axes"))
    return status.join(sig, "dataset", "left").select("dataset", "samples", "nonfinite", "status", "axes")


@case()
def p04_legacy_pipeline(spark, sf):
    """The older pipeline whole: align, drop shared datasets and features that aren't finite everywhere, fit, score, p, q."""
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("dataset"), F.col("vec_id").alias("sample"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))
    # one dataset lacks a feature's values, and two hold one profile
    rows = rows.withColumn("value", F.when((F.col("dataset") == 3) & (F.col("feature") == 7), float("nan")).when(F.col("dataset").isin(4, 5) & (F.col("sample") == F.min("sample").over(Window.partitionBy("dataset"))), F.lit(1.0)).otherwise(F.col("value")))
    profiles = rows.groupBy("dataset", "sample").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("feature", "value")))), 256).alias("hash"))
    apart = cut(overlap.unshared(profiles, "dataset", "hash"))
    kept = rows.join(apart, "dataset", "left_semi")
    fit = kept.join(matrix.finite_everywhere(kept, apart.count()), "feature", "left_semi")
    vectors = fit.groupBy("dataset", "sample").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).getField("value").alias("v"))
    sig = cut(signature.signatures(vectors, "dataset", "v"))
    sizes = [r[0] for r in sig.select("samples").distinct().collect()]  # no more than sample counts differ
    profiles = signature.null_profiles(sig, vectors, "v", sizes, draws=50)
    out = signature.calibrate_pairs(signature.scores(sig, sig), profiles, sig.select("dataset", "samples"), exact=True)
    return stats.benjamini_hochberg(out, "p", "q").select("a", "b", F.round("score", 6).alias("score"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


# --- graph details --------------------------------------------------------------------------------------------------


@case(with_(NODES) + "select coalesce(community, 'unassigned') as community, min(x) as left, max(x) as right, min(y) as bottom, max(y) as top, round(avg(x), 9) as centre_x, round(avg(y), 9) as centre_y from nodes group by 1")
def g07_bounds(spark, sf):
    n = nodes(spark, sf)
    return n.groupBy(F.coalesce("community", F.lit("unassigned")).alias("community")).agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("bottom"), F.max("y").alias("top"), F.round(F.avg("x"), 9).alias("centre_x"), F.round(F.avg("y"), 9).alias("centre_y"))


@case(with_(CAL) + ", s as (select a as id, b as other, q, score from cal union all select b, a, q, score from cal), t as (select *, row_number() over (partition by id order by q, score, other) as r from s) select n.id, n.accession, string_agg(other::varchar, ',' order by r) as neighbours from nodes n join t using (id) where r <= 6 group by 1, 2")
def g11_dataset_detail(spark, sf):
    sides = graph.endpoints(frames.foremost(spark, sf, 6, ("a", "b", "q", "score")).select("a", "b", "q", "score"))
    first = sides.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("q", "score", "other"))).filter("r <= 6")
    lists = first.groupBy(F.col("node").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"].cast("string")), ",").alias("neighbours"))
    return nodes(spark, sf).select("id", "accession").join(lists, "id")


# --- annotations ----------------------------------------------------------------------------------------------------


@case("""with d as (select doc_id, text as src, lower(text) as low, lower(substr(text, 20, 8)) as quote from documents),
f as (select doc_id, src, quote, list_filter(range(0, length(src)), lambda i: substr(src, i + 1, length(quote)) = quote) as exact, list_filter(range(0, length(src)), lambda i: substr(low, i + 1, length(quote)) = lower(quote)) as blind from d)
select doc_id, (case when substr(src, 16, length(quote)) = quote then 15 when len(exact) > 0 then list_sort(list_transform(exact, lambda i: {'d': abs(i - 15), 'i': i}))[1].i
  when len(blind) > 0 then list_sort(list_transform(blind, lambda i: {'d': abs(i - 15), 'i': i}))[1].i end)::int as start from f""")
def n04_span_grounding(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("src"))
    rows = docs.withColumn("quote", F.lower(F.substring("src", 20, 8))).withColumn("at", F.lit(15))
    return rows.select("doc_id", annotate.ground(F.col("src"), F.col("at"), F.col("quote")).alias("start"))


@case("select doc_id, quality is null as no_value, toxic = 1 as unknown, (quality is null) = (toxic = 1) as consistent from labels")
def n05_known_or_unknown(spark, sf):
    unknown = F.col("toxic") == 1
    no_value, consistent = annotate.known_or_unknown(F.col("quality"), unknown)
    return table(spark, sf, "labels").select("doc_id", no_value.alias("no_value"), unknown.alias("unknown"), consistent.alias("consistent"))


@case("select d.doc_id, coalesce(case when d.doc_id % 3 <> 0 then d.lang end, case when l.quality = 1 then 'model' end, 'unknown') as value from documents d left join labels l using (doc_id)")
def n06_structured_first(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", annotate.first_given(F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.when(F.col("quality") == 1, F.lit("model"))).alias("value"))


@case("select doc_id, field, value, case when doc_id % 4 = 0 then 'accepted' else 'unreviewed' end as state from (select doc_id, 'lang' as field, lang as value from documents union all select doc_id, 'source', source from documents) where value is not null")
def n08_assertion_rows(spark, sf):
    return annotate.assertion_rows(table(spark, sf, "documents"), "doc_id", ["lang", "source"], F.col("doc_id") % 4 == 0)


@case("with w as (select distinct 1 + doc_id % 2500 as id from documents) select w.id, case when p.p_partkey is null then 'missing' when p.p_size > 45 then 'obsolete' else 'present' end as status, p.p_name as name from w left join part p on p.p_partkey = w.id")
def n10_ontology_index(spark, sf):
    wanted = table(spark, sf, "documents").select((1 + F.col("doc_id") % 2500).alias("id"))
    return annotate.term_index(wanted, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 45).alias("obsolete")))


@case("select doc_id, case when doc_id % 10 = 0 then 'rejected' when quality = 1 then 'accepted' else 'unreviewed' end as state, case when doc_id % 10 = 0 then 1 else 0 end as audited from labels")
def n13_review(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("unreviewed").alias("state"))
    return annotate.reviewed(rows, rows.filter("doc_id % 10 = 0").select("doc_id", F.lit("rejected").alias("state")), "doc_id")


@case("select d.doc_id from documents d left join (select doc_id, sha256(source) as h from documents where doc_id % 3 = 0) c on c.doc_id = d.doc_id and c.h = sha256(d.source || case when d.doc_id % 6 = 0 then 'x' else '' end) where c.doc_id is null")
def n14_pending_annotations(spark, sf):
    docs = table(spark, sf, "documents")
    cached = docs.filter("doc_id % 3 = 0").select("doc_id", F.sha2("source", 256).alias("h"))
    now = docs.select("doc_id", F.sha2(F.concat("source", F.when(F.col("doc_id") % 6 == 0, "x").otherwise("")), 256).alias("h"))
    return annotate.pending(now, cached, "doc_id", "h").select("doc_id")


@case("with g as (select l_orderkey as id, list(l_partkey order by l_linenumber, l_partkey) as p, list(l_suppkey order by l_linenumber, l_suppkey) as s from lineitem group by 1) select id, array_to_string(case when id % 2 = 0 then p[1:3] end, ',') as candidates, array_to_string(p[1:5], ',') as features, array_to_string(s[1:2], ',') as pathways from g")
def n17_compact_evidence(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col(c).alias("v")))), lambda x: x["v"].cast("string")).alias(n) for n, c in (("p", "l_partkey"), ("s", "l_suppkey"))])
    packed = rows.select("id", discovery.compact_evidence(F.col("p"), F.col("p"), F.col("s"), F.col("id") % 2 == 0).alias("e"))
    return packed.select("id", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("candidates", "features", "pathways")])


# --- releases -------------------------------------------------------------------------------------------------------


@case("select id, accession, null::varchar as reviewer, 1 as version from (" + with_(NODES) + "select id, accession from nodes where id % 2 = 0) union all select id, accession, 'r', 2 from (" + with_(NODES) + "select id, accession from nodes where id % 2 = 1)")
def d01_additive_columns(spark, sf):
    n = nodes(spark, sf).select("id", "accession")
    new = n.filter("id % 2 = 1").select("id", "accession", F.lit("r").alias("reviewer"), F.lit(2).alias("version"))
    return release.add_columns(n.filter("id % 2 = 0").withColumn("version", F.lit(1)), new)


@case("select o_orderkey, coalesce(l.price, o_totalprice) as price from orders left join (select l_orderkey, round(sum(l_extendedprice), 2) as price from lineitem where l_linenumber <= 2 group by 1) l on l_orderkey = o_orderkey")
def d05_update_from(spark, sf):
    sums = table(spark, sf, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return release.update_from(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), sums, ["o_orderkey"], "price")


@case("with a as (select p_partkey as id, p_name, p_size from part), b as (select p_partkey as id, p_name, case when p_partkey % 97 = 0 then p_size + 1 else p_size end as p_size from part) select a.id from a join b using (id) where a.p_name <> b.p_name or a.p_size <> b.p_size")
def d06_artifact_mismatch(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    return release.mismatches(a, a.withColumn("p_size", F.when(F.col("id") % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))), ["id"], ["p_name", "p_size"])


@case("select o_custkey as run, o_orderkey as companion from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') where r = 1")
def d09_companion(spark, sf):
    rows = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return release.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("companion"))


@case("select user_id, event_type, min(event_id) as first_run from events group by 1, 2")
def d14_run_ledger(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("first_run"))
    return release.insert_ignore(rows.filter("false"), rows, ["user_id", "event_type"], [F.asc("first_run")])


@case("select l_orderkey as id, sha256(string_agg(sha256(l_partkey::varchar), ',' order by sha256(l_partkey::varchar))) as dependency from (select distinct l_orderkey, l_partkey from lineitem) group by 1")
def d18_dependency_hash(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.sha2(F.col("l_partkey").cast("string"), 256).alias("h")).distinct()
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("dependency"))


@case("select event_id, case when value is null or not isfinite(value) then 'quarantine' when value < 0 then 'quarantine' else 'accept' end as route from events")
def r03_input_validation(spark, sf):
    return release.routed(table(spark, sf, "events"), matrix.finite(F.col("value")) & (F.col("value") >= 0)).select("event_id", "route")


@case("select (row_number() over (order by o_orderkey) - 1) // 1000 as page, o_orderkey from orders where o_orderkey > 2500")
def r05_cursor_pages(spark, sf):
    rows = table(spark, sf, "orders").filter("o_orderkey > 2500").select("o_orderkey")
    return stats.ranked(rows, "o_orderkey", [], "n").select(F.expr("(n - 1) div 1000").alias("page"), "o_orderkey")


@case("with v as (select vec_id as id, embedding::double[] as v from embeddings) select x.id as a, y.id as b, round(pow(list_distance(x.v, y.v), 2), 6) as value from v x join v y on x.id < y.id")
def x01_pluggable_metric(spark, sf):
    """Another metric in the same blocks: squared distance instead of cosine."""
    far = lambda x, y: (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return pairs.all_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", far).select("a", "b", F.round("value", 6).alias("value"))


def manifest_of(rows) -> str:
    """Canonical text of a small table, for manifests."""
    return sinks.canonical_json([json.loads(r) for r in rows.toJSON().collect()])



