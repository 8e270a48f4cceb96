"""Queries over stored things: archives, signature stores, calibrations and text releases, jobs, cursors and names."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile

from pyspark.sql import functions as F

from kinmap.functions import ids, registered
from kinmap.functions.lineage import cut, shared_dir
from kinmap.operators import community, jobs, pairs, publish, signature
from kinmap.plans import frames, graph_queries, kernel_queries
from kinmap.plans.frames import CAL, PAIRS, P, table, with_
from kinmap.sources import archives, sinks, store, text

Q = {}
S = {}


def case(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    """A new folder where all executors see it."""
    return f"{shared_dir(spark)}/kinmap-{name}-{uuid.uuid4().hex[:12]}"


# --- archives -------------------------------------------------------------------------------------------------------


@case("""select r_name as archive, r_name <> 'ASIA' as safe, case when r_name <> 'ASIA' then count(n_nationkey) end as files, case when r_name <> 'ASIA' then sum(length(n_name))::bigint end as bytes
from region join nation on n_regionkey = r_regionkey group by 1""")
def s06_archive_reports(spark, sf):
    """A tar file a region with a file a nation; one of them leads out of its folder."""
    folder = _folder(spark, "tar")
    rows = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("n")).collect()  # five rows
    for r in rows:
        held = io.BytesIO()
        with tarfile.open(fileobj=held, mode="w:gz") as out:
            for name in sorted(r["n"]):
                m = tarfile.TarInfo(("../" if r["r_name"] == "ASIA" else "cel/") + name.replace(" ", "_") + ".CEL")
                m.size = len(name)
                out.addfile(m, io.BytesIO(name.encode()))
        store.write(spark, f"{folder}/{r['r_name']}.tar.gz", held.getvalue())
    name = F.regexp_replace(F.regexp_extract("path", "([^/]*)[.]tar[.]gz$", 1), "%20", " ")
    return archives.reports(spark, f"{folder}/*.tar.gz").select(name.alias("archive"), "safe", "files", "bytes")


@case("""with m as (select n_regionkey, 'GSE' || (100 + n_nationkey) as accession, 'id,GSM' || n_nationkey || '_x,plain,gsm' || (n_nationkey + 1) || chr(10) || n_name || chr(10) as body, n_nationkey as k from nation)
select accession, length(body) as size, sha256(body) as sha256, 'GSM' || k || ',,GSM' || (k + 1) as samples from m""")
def s08_zip_members(spark, sf):
    """The members of a ZIP file a region, each named by an accession."""
    folder = _folder(spark, "zip")
    rows = table(spark, sf, "nation").collect()  # 25 rows
    for region in sorted({r["n_regionkey"] for r in rows}):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
            out.writestr("readme.txt", "no accession")
            for r in rows:
                if r["n_regionkey"] == region:
                    out.writestr(f"data/gse{100 + r['n_nationkey']}.csv", f"id,GSM{r['n_nationkey']}_x,plain,gsm{r['n_nationkey'] + 1}\n{r['n_name']}\n")
        store.write(spark, f"{folder}/{region}.zip", held.getvalue())
    found = archives.zip_members(spark, f"{folder}/*.zip")
    return found.select("accession", "size", "sha256", F.array_join(F.transform("sample_ids", lambda x: F.coalesce(x, F.lit(""))), ",").alias("samples"))


@case("select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) as heading from pages")
def s30_page_fields(spark, sf):
    """The fields of a page that a prompt needs."""
    return table(spark, sf, "pages").select("page_id", text.tag_text(F.col("html"), "title").alias("title"), text.tag_text(F.col("html"), "h1").alias("heading"))


# --- stores ---------------------------------------------------------------------------------------------------------


def _stored(spark, sf):
    """Signatures in a store with another feature list's beside them."""
    folder, sig = _folder(spark, "signatures"), kernel_queries._signatures(spark, sf)
    sinks.write_signatures(sig, folder, "64-values")
    sinks.write_signatures(sig.limit(1).withColumn("features", F.lit(9)), folder, "9-values")
    return sinks.read_signatures(spark, folder, "64-values")


@case("select label::bigint as dataset, 64 as features, count(*)::int as samples, 0.5::double as share from embeddings group by 1")
def s09_signature_scan(spark, sf):
    """Stored signatures, without their loadings."""
    return _stored(spark, sf).select("dataset", "features", "samples", "share")


@case()
def s10_profile_scan(spark, sf):
    """Stored null profiles of one pool and feature list."""
    folder, sig = _folder(spark, "profiles"), cut(kernel_queries._signatures(spark, sf))
    sinks.write_profiles(kernel_queries._profiles(spark, sf, sig), folder, pool="embeddings", features="64-values")
    out = sinks.read_profiles(spark, folder, pool="embeddings", features="64-values")
    return out.select("dataset", "size", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@case("select vec_id, label, round(list_dot_product(embedding::double[], embedding::double[]), 6) as length from embeddings")
def s11_pool_scan(spark, sf):
    """A stored pool of whole rows."""
    pool = cut(table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")))
    return pool.select("vec_id", "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@case(with_(CAL) + "select a, b, q from cal where percentile >= 0.99")
def k06_edge_tsv(spark, sf):
    """Edges as tab-separated text, as an older reader finds them."""
    folder = _folder(spark, "tsv")
    sinks.write_tsv(frames.calibrated(spark, sf, ("a", "b", "q", "percentile"), percentile=0.99).select("a", "b", "q"), folder)
    return spark.read.schema("a long, b long, q double").option("sep", "\t").option("header", True).csv(folder)


# --- releases -------------------------------------------------------------------------------------------------------


@case(with_(PAIRS, P) + """, k as (select a, b, p, row_number() over (order by p, a, b) as r, count(*) over () as n from ps)
select a, b, p, round(least(1.0, min(p * n / r) over (order by r desc rows unbounded preceding)), 7) as q from k""")
def d07_staged_calibration(spark, sf):
    """A calibration that takes its family in batches, one of them twice, and is finalised once it is whole."""
    rows = cut(frames.with_p(frames.text_pairs(spark, sf)).select("a", "b", "score", "p"))
    held = publish.Calibrations(spark, _folder(spark, "calibrations"))
    name = held.open("stratum", "frozen", rows.count(), pool="p", algorithm="a")
    for part in (0, 1, 1):
        held.add(name, f"part-{part}", rows.filter(F.col("a") % 2 == part))
    return held.finalize(name).select("a", "b", "p", F.round("q", 7).alias("q"))


@case(with_(PAIRS) + "select a, b, cosine, round(cume_dist() over (order by cosine), 9) as percentile from pairs")
def d08_text_release(spark, sf):
    """A text release over a list of records, finalised with percentiles."""
    held = publish.TextReleases(spark, _folder(spark, "text"))
    records = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("text"))
    name = held.open("cosine-v1", records, "vec_id", "text")
    return held.finalize(name, cut(frames.text_pairs(spark, sf).select("a", "b", "cosine"))).select("a", "b", "cosine", F.round("percentile", 9).alias("percentile"))


# --- jobs and cursors -----------------------------------------------------------------------------------------------

_NOW = "timestamp '2024-01-15 00:00:00'"
_JOBS = """jobs as (select event_id as job, event_type as kind, case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'retry' else 'succeeded' end as status,
  (event_id % 3)::int as attempts, 2 as most_attempts, case when event_id % 4 = 1 then 'w' || (event_id % 2 + event_id % 3) end as worker,
  case when event_id % 4 = 1 then ts end as lease_until, case when event_id % 4 = 2 then ts end as retry_at, ts as created from events)"""


def _jobs(spark, sf):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    status = F.when(k % 4 == 0, "queued").when(k % 4 == 1, "running").when(k % 4 == 2, "retry").otherwise("succeeded")
    return table(spark, sf, "events").select(
        k.alias("job"), F.col("event_type").alias("kind"), status.alias("status"), (k % 3).cast("int").alias("attempts"), F.lit(2).alias("most_attempts"),
        F.when(k % 4 == 1, F.concat(F.lit("w"), (k % 2 + k % 3).cast("string"))).alias("worker"), F.when(k % 4 == 1, ts).alias("lease_until"), F.when(k % 4 == 2, ts).alias("retry_at"), ts.alias("created"),
    )


def _shown(rows):
    return rows.select("job", "status", "attempts", "worker", F.col("lease_until").cast("timestamp_ntz").alias("lease_until"), F.col("retry_at").cast("timestamp_ntz").alias("retry_at"))


_REAPED = f""", reaped as (select job, kind, created, most_attempts, attempts, status = 'running' and lease_until <= {_NOW} as gone, attempts < most_attempts as again, status, worker, lease_until, retry_at from jobs),
after as (select job, kind, created, attempts, case when gone and again then 'retry' when gone then 'dead' else status end as status, case when not coalesce(gone, false) then worker end as worker,
  case when not coalesce(gone, false) then lease_until end as lease_until, case when gone then case when again then {_NOW} end else retry_at end as retry_at from reaped)"""


@case("with " + _JOBS + _REAPED + " select job, status, attempts, worker, lease_until, retry_at from after")
def r06_reaped_jobs(spark, sf):
    return _shown(jobs.reap(_jobs(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp")))


@case("with " + _JOBS + _REAPED + f""", taken as (select job from after where status in ('queued', 'retry') and coalesce(retry_at <= {_NOW}, true) and kind in ('view', 'click') order by created, job limit 200)
select job, case when t then 'running' else status end as status, (attempts + t::int)::int as attempts, case when t then 'me' else worker end as worker,
  case when t then {_NOW} + interval 300 seconds else lease_until end as lease_until, retry_at from (select *, job in (select job from taken) as t from after)""")
def r06_claimed_jobs(spark, sf):
    return _shown(jobs.claim(_jobs(spark, sf), "me", F.lit("2024-01-15 00:00:00").cast("timestamp"), 200, kinds=("view", "click")))


@case("with " + _JOBS + f""" select job, status, attempts, worker, case when status = 'running' and worker = 'w1' and lease_until > {_NOW} then {_NOW} + interval 60 seconds else lease_until end as lease_until, retry_at from jobs""")
def r06_heartbeats(spark, sf):
    return _shown(jobs.heartbeat(_jobs(spark, sf), "w1", F.lit("2024-01-15 00:00:00").cast("timestamp"), 60))


@case("with " + _JOBS + f""", f as (select *, status = 'running' and worker = 'w1' and lease_until > {_NOW} as held, case job % 3 when 0 then 'done' when 1 then 'retryable' else 'permanent' end as outcome from jobs)
select job, case when not coalesce(held, false) then status when outcome = 'done' then 'succeeded' when outcome = 'retryable' and attempts < most_attempts then 'retry' else 'dead' end as status from f""")
def r06_finished_jobs(spark, sf):
    rows = _jobs(spark, sf)
    outcome = F.when(F.col("job") % 3 == 0, "done").when(F.col("job") % 3 == 1, "retryable").otherwise("permanent")
    return jobs.finish(rows, rows.select("job", outcome.alias("outcome")), "w1", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("job", "status")


@case("select page, min(o_orderkey) as first, max(o_orderkey) as last, count(*) as n from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 500 as page from orders) group by page")
def r04_cursor_pages(spark, sf):
    rows = jobs.cursor_pages(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500)
    return rows.groupBy("page").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n"))


# --- names and functions --------------------------------------------------------------------------------------------


@case("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none.x') as none from events")
def c28_json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none.x").alias("none"))


@case("select doc_id, concat_ws(' ', nullif(trim(split_part(text, chr(10), 1)), ''), nullif(trim(source), ''), nullif(trim(case when doc_id % 3 = 0 then '  ' else lang end), '')) as description from documents")
def c29_description(spark, sf):
    first = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select("doc_id", ids.description(first, F.col("source"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang"))).alias("description"))


@case("select event_id, round(1 / (1 + abs(value)), 9) as similarity from events")
def c30_similarity(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(ids.similarity(F.abs("value")), 9).alias("similarity"))


_PATHS = """['a/b.json', '/a/b', 'a/../b', 'a/./b', 'a//b', 'a/', 'C:/x', 'a\\b.txt', 'con/x', 'x/LPT1.txt', 'a./b', 'b /c', 'x?y', 'ok/Ünï.txt', '', 'lpt0/x']"""


@case("with p as (select p_partkey, replace(" + _PATHS + "[(p_partkey % 16 + 1)::int], chr(92), '/') as plain from part) select p_partkey, case when len(list_filter(string_split(plain, '/'), lambda x: x in ('', '.', '..') or regexp_matches(x, '[ .]$') or regexp_matches(x, '[<>:\"|?*]') or regexp_matches(x, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$'))) = 0 then plain end as path from p")
def c34_portable_paths(spark, sf):
    paths = ["a/b.json", "/a/b", "a/../b", "a/./b", "a//b", "a/", "C:/x", "a\\b.txt", "con/x", "x/LPT1.txt", "a./b", "b /c", "x?y", "ok/Ünï.txt", "", "lpt0/x"]
    return table(spark, sf, "part").select("p_partkey", ids.portable_path(frames.pick(tuple(paths), F.col("p_partkey") % 16)).alias("path"))


@case("select doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(strip_accents(first)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), ''), 'export') as slug from (select doc_id, split_part(text, chr(10), 1) as first from documents)")
def c19_export_slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.export_slug(F.substring_index("text", "\n", 1)).alias("slug"))


@case("select regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as term, count(*) as n, round(sum(1 / (1 + p_size::double)), 9) as weight, (select count(*) from (select unnest([5, 8, 12, 16, 20, 25, 30, 40, 50]) as s) where s between 8 and 40) as sizes from part group by 1")
def x06_registered_functions(spark, sf):
    """The engine's functions by name in SQL: scalars and a table function."""
    registered.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("kinmap_part")
    return spark.sql("select kinmap_term(p_name) as term, count(*) as n, round(sum(kinmap_similarity(cast(p_size as double))), 9) as weight, (select count(*) from kinmap_size_grid(8, 40)) as sizes from kinmap_part group by 1")


@case("with v as (select doc_id as id, [length(text)::double, len(regexp_extract_all(text, '[^ ]+'))::double, 1.0] as v from documents where text is not null) select id, round(sqrt(list_dot_product(v, v)), 6) as length from v")
def x03_pluggable_embedder(spark, sf):
    """Vectors of texts by any function of a batch of texts."""

    def sizes(texts: list[str]):
        return [[float(len(t)), float(len([w for w in t.split(" ") if w])), 1.0] for t in texts]

    out = pairs.embedded(table(spark, sf, "documents").filter("text is not null"), "doc_id", "text", sizes)
    return out.select("id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


# --- graph building -------------------------------------------------------------------------------------------------


@case()
def g06_modularity_snapshot(spark, sf):
    """Communities, coordinates, modularity and stability of the drawn graph."""
    edges = graph_queries.t02_union_topk(spark, sf).select("a", "b", F.greatest("percentile", F.lit(1e-9)).alias("weight"))
    return community.snapshot(frames.nodes(spark, sf).select("id"), edges, resolution=0.5)
