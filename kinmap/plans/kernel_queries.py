"""Queries of the numerical kernels, of events in time, and of graph building; those that SQL can't express have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.functions.lineage import cut
from kinmap.operators import layout, signature
from kinmap.plans.frames import calibrated, nodes, table
from kinmap.streaming import delta

Q = {}
S = {}
#: Null signatures of each size, the reference's default.
DRAWS = 100


def case(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _signatures(spark, sf):
    return signature.signatures(table(spark, sf, "embeddings"), "label", "embedding")


@case()
def m01_signatures(spark, sf):
    sig = _signatures(spark, sf)
    return sig.select("dataset", "features", "samples", F.size("weights").alias("axes"), F.round(F.get("weights", F.lit(0)), 6).alias("first_weight"))


@case("select label::bigint as dataset, 64 as features, count(*)::int as samples, true as weights_sum, true as orthonormal from embeddings group by 1")
def m03_signature_invariants(spark, sf):
    return signature.invariants(_signatures(spark, sf)).select("dataset", "features", "samples", "weights_sum", "orthonormal")


@case()
def m07_signature_scores(spark, sf):
    sig = cut(_signatures(spark, sf))
    return signature.scores(sig, sig).select("a", "b", F.round("score", 6).alias("score"))


@case()
def m04_score_by_sql(spark, sf):
    """The same scores from exploded components: an independent form of the kernel."""
    sig = _signatures(spark, sf)
    parts = sig.select("dataset", "features", "share", F.posexplode("loadings").alias("i", "v"), "weights").withColumn("w", F.get("weights", F.col("i"))).drop("weights", "i")
    x = parts.select(F.col("dataset").alias("a"), F.col("v").alias("x"), F.col("w").alias("wx"), "features", "share")
    y = parts.select(F.col("dataset").alias("b"), F.col("v").alias("y"), F.col("w").alias("wy"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    term = (F.col("wx") + F.col("wy")) * F.pow(dot, F.lit(2))
    total = x.join(y, F.expr("a < b")).groupBy("a", "b", "features", "share").agg(F.sum(term).alias("t"))
    score = (2 * F.col("share") * F.col("features") - F.col("t")) / (2 * (1 - F.col("share")))
    return total.select("a", "b", F.round(F.greatest(F.lit(0.0), score), 6).alias("score"))


@case()
def m10_null_bank(spark, sf):
    """Null signatures on a grid that brackets the signatures' own sample counts."""
    low, high = _signatures(spark, sf).agg(F.min("samples"), F.max("samples")).first()
    bank = signature.null_bank(table(spark, sf, "embeddings"), "embedding", signature.size_grid(low, high), DRAWS)
    return bank.select("size", "draw", "features", F.size("weights").alias("axes"), F.round(F.get("weights", F.lit(0)), 6).alias("first_weight"))


def _profiles(spark, sf, sig):
    low, high = sig.agg(F.min("samples"), F.max("samples")).first()
    return signature.null_profiles(sig, table(spark, sf, "embeddings"), "embedding", signature.size_grid(low, high), DRAWS)


@case()
def m11_null_profiles(spark, sf):
    out = _profiles(spark, sf, cut(_signatures(spark, sf)))
    return out.select("dataset", "size", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


def _rounded(rows):
    return rows.select("a", "b", F.round("score", 6).alias("score"), F.round("p", 6).alias("p"))


@case()
def m12_bootstrap_pvalues(spark, sf):
    """Pairs of datasets against null samples of exactly the other's size."""
    sig = cut(_signatures(spark, sf))
    sizes = [r[0] for r in sig.select("samples").distinct().collect()]  # no more than sample counts differ
    profiles = signature.null_profiles(sig, table(spark, sf, "embeddings"), "embedding", sizes, DRAWS)
    return _rounded(signature.calibrate_pairs(signature.scores(sig, sig), profiles, sig.select("dataset", "samples"), exact=True))


@case()
def m14_streaming_calibration(spark, sf):
    """Pairs against stored profiles on a grid, then q: what an update does without new draws."""
    from kinmap.functions import stats

    sig = cut(_signatures(spark, sf))
    stored = cut(_profiles(spark, sf, sig))
    rows = signature.calibrate_pairs(signature.scores(sig, sig), stored, sig.select("dataset", "samples"), exact=False)
    return stats.benjamini_hochberg(rows, "p", "q").select("a", "b", F.round("score", 6).alias("score"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@case()
def m16_feature_explanations(spark, sf):
    """Best and worst features of every pair of datasets."""
    sig = cut(_signatures(spark, sf))
    out = signature.explain(signature.scores(sig, sig), sig, k=8)
    named = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("a", "b", named("best"), named("worst"), F.round("objective", 6).alias("objective"), F.round("least", 6).alias("least"))


def _plain_signatures(spark, sf):
    """A signature-like row a label, from its three first vectors with weights 3, 2 and 1: the objective's inputs need not be fitted."""
    rows = table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("dataset")).agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))), 1, 3).alias("s"))
    return rows.select("dataset", F.transform("s", lambda x: x["v"]).alias("loadings"), F.array(*[F.lit(float(w)) for w in (3, 2, 1)]).alias("weights"))


_AXES = """axes as (select label::bigint as d, i, embedding::double[] as v, 4.0 - i as w from (select label, embedding, row_number() over (partition by label order by vec_id) as i from embeddings) where i <= 3),
crossed as (select x.d as a, y.d as b, x.i as i, y.i as j, x.w + y.w as c, x.v as p, y.v as q from axes x join axes y on x.d < y.d)"""


@case("with " + _AXES + " select a, b, round(sum(c * pow(list_dot_product(p[1:5], q[1:5]), 2)), 9) as kernel, round(sum(c * pow(list_dot_product(p[1:5], q[1:5]), 2)), 9) as by_sql from crossed group by a, b")
def m18_set_objective(spark, sf):
    """The objective on the first five features, by the kernel that searches and by scaled loadings in SQL functions."""
    sig = cut(_plain_signatures(spark, sf))
    pairs = sig.select(F.col("dataset").alias("a")).join(sig.select(F.col("dataset").alias("b")), F.expr("a < b"))
    sets = pairs.withColumn("chosen", F.array(*[F.lit(i) for i in range(5)]))
    kernel = signature.values(sets, sig).withColumnRenamed("objective", "kernel")
    return kernel.join(signature.objective_of(sets, sig), ["a", "b"]).select("a", "b", F.round("kernel", 9).alias("kernel"), F.round("objective", 9).alias("by_sql"))


@case("with " + _AXES + """, alone as (select a, b, r, sum(c * p[r] * p[r] * q[r] * q[r]) as v from crossed, range(1, 65) t(r) group by a, b, r)
select a, b, (arg_max(r, v) - 1)::int as best, round(max(v), 9) as objective, (arg_min(r, v) - 1)::int as worst, round(min(v), 9) as least from alone group by a, b""")
def m16_single_feature(spark, sf):
    """The best and the worst set of one feature, where the search has an exact answer in SQL."""
    sig = cut(_plain_signatures(spark, sf))
    pairs = sig.select(F.col("dataset").alias("a")).join(sig.select(F.col("dataset").alias("b")), F.expr("a < b"))
    out = signature.explain(pairs, sig, k=1)
    return out.select("a", "b", F.get("best", F.lit(0)).alias("best"), F.round("objective", 9).alias("objective"), F.get("worst", F.lit(0)).alias("worst"), F.round("least", 9).alias("least"))


@case()
def m17_set_explanations(spark, sf):
    """One set of features for all pairs of a group of datasets."""
    sig = cut(_signatures(spark, sf))
    pairs = signature.scores(sig, sig).withColumn("kind", F.col("a") % 3)
    out = signature.explain_sets(pairs, sig, "kind", k=8)
    return out.select("kind", "pairs", F.array_join(F.transform("best", lambda x: x.cast("string")), ",").alias("best"), F.round("objective", 6).alias("objective"), F.round("least", 6).alias("least"))


@case()
def k05_wide_matrix(spark, sf):
    from kinmap.sources import sinks

    sig = cut(_signatures(spark, sf))
    ids = [r["dataset"] for r in sig.select("dataset").orderBy("dataset").collect()]  # of ten datasets
    return sinks.wide_matrix(signature.scores(sig, sig).withColumn("score", F.round("score", 6)), ids, "score")


@case()
def g01_communities(spark, sf):
    edges = calibrated(spark, sf, ("a", "b", "score"), below=0.75).select("a", "b", (1 - F.col("score")).alias("weight"))
    return layout.label_communities(nodes(spark, sf).select("id"), edges, rounds=6)


@case()
def g04_layout(spark, sf):
    return layout.separate(nodes(spark, sf).select("id", "x", "y"), target=0.02)


@case("select time_bucket(interval 1 day, ts) as start, time_bucket(interval 1 day, ts) + interval 1 day as \"end\", event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def r08_tumbling_windows(spark, sf):
    out = delta.windowed(table(spark, sf, "events"), "ts", "1 day", None, "2 days", ["event_type"], "value")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "total": F.round("total", 6)})


@case("""with o as (select *, case when ts - lag(ts) over w > interval 6 hours or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from o) select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from g group by user_id, s""")
def r08_sessions(spark, sf):
    out = delta.sessions(table(spark, sf, "events"), "ts", "6 hours", "2 days", ["user_id"])
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@case("select user_id, max(event_id) as version from (select user_id, event_id from events where event_id % 2 = 0 union all select user_id, event_id from events where event_id % 3 = 0) group by 1")
def r07_current_version(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"))
    return delta.current_versions(rows.filter("version % 2 = 0"), rows.filter("version % 3 = 0"), ["user_id"], "version").select("user_id", "version")


@case("""with p as (select user_id, ts, max(event_id) as last_purchase from events where event_type = 'purchase' group by 1, 2)
select e.user_id, e.ts, e.event_id, p.last_purchase from (select * from events where event_type = 'view') e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def j23_asof_join(spark, sf):
    """As-of join as one window over both sides, no range join."""
    from pyspark.sql import Window

    rows = table(spark, sf, "events").filter("event_type in ('view', 'purchase')")
    side = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy("ts", side, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return rows.withColumn("last_purchase", bought).filter("event_type = 'view'").select("user_id", "ts", "event_id", "last_purchase")
