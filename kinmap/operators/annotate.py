"""Evidence spans, label resolution and annotation state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def span_of(source: Column, quote: Column) -> tuple[Column, Column]:
    """Offsets [start, end) of the first exact occurrence; null where there is none."""
    at = F.position(quote, source)
    start = F.when(at > 0, at - 1)
    return start, start + F.length(quote)


def span_holds(source: Column, start: Column, end: Column, quote: Column) -> Column:
    return F.coalesce((start >= 0) & (end >= start) & (F.substring(source, start + 1, end - start) == quote), F.lit(False))


@F.arrow_udf(IntegerType())
def _nearest(source: pa.Array, quote: pa.Array, blind_source: pa.Array, blind_quote: pa.Array, start: pa.Array) -> pa.Array:
    """Start of the occurrence nearest to start, the earlier of two as near, in source or else in blind_source: two searches a text."""

    def place(text: str | None, wanted: str | None, at: int | None) -> int | None:
        if text is None or wanted is None:
            return None
        after = text.find(wanted, 0 if at is None else max(0, at))
        before = -1 if at is None or at < 0 else text.rfind(wanted, 0, at + len(wanted))
        if before < 0 or (after >= 0 and after - at < at - before):
            return after if after >= 0 else None
        return before

    out = []
    for s, q, bs, bq, at in zip(*(c.to_pylist() for c in (source, quote, blind_source, blind_quote, start)), strict=True):
        found = place(s, q, at)
        out.append(place(bs, bq, at) if found is None else found)
    return pa.array(out, pa.int32())


def ground(source: Column, start: Column, quote: Column) -> Column:
    """Start of the quote: as given where it fits, else the nearest exact, else the nearest case-blind occurrence; null for none."""
    exact = F.when(F.substring(source, start + 1, F.length(quote)) == quote, start)
    left = lambda c: F.when(exact.isNull(), c)
    return F.coalesce(exact, _nearest(left(source), left(quote), left(F.lower(source)), left(F.lower(quote)), start.cast("int")))


def quoted(sources: DataFrame, source_id: str, source: str, quotes: DataFrame, quote_id: str, quote: str, words: int = 3) -> DataFrame:
    """(source_id, source, quote_id, quote) of every source that holds a quote, whole and exactly.

    A quote's second and following words stand whole in every source that holds it, so their run is looked up among
    the runs of the sources' words, and only sources that have it are searched. Quotes of too few words for that are
    searched in every source. A blank or null quote is held by nothing.
    """
    split = lambda c: F.split(c, r"\s+")
    named = quotes.filter(F.length(F.trim(quote)) > 0).select(F.col(quote_id), F.col(quote), split(F.col(quote)).alias("_w"))
    run = lambda w, at: F.xxhash64(*[F.get(w, at + k) for k in range(words)])
    keyed = named.filter(F.size("_w") >= words + 2).select(quote_id, run(F.col("_w"), F.lit(1)).alias("_k"))
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - words), lambda i: run(F.col("_w"), i))
    texts = sources.select(source_id, split(F.col(source)).alias("_w")).filter(F.size("_w") >= words)
    met = texts.select(source_id, F.explode(F.array_distinct(runs)).alias("_k")).join(keyed, "_k").select(source_id, quote_id).distinct()
    found = sources.select(source_id, source).join(met, source_id).join(quotes.select(quote_id, quote), quote_id)
    short = named.filter(F.size("_w") < words + 2).select(quote_id, quote)
    searched = sources.select(source_id, source).join(short, F.expr(f"contains(`{source}`, `{quote}`)"))
    both = found.select(source_id, source, quote_id, quote).unionByName(searched.select(source_id, source, quote_id, quote))
    return both.filter(F.expr(f"contains(`{source}`, `{quote}`)"))


def resolve(labels: DataFrame, terms: DataFrame, key) -> DataFrame:
    """label and status: resolved to one id, ambiguous, or unresolved. terms: id, name, obsolete; key normalises names."""
    names = terms.filter("not obsolete").select("id", key(F.col("name")).alias("k")).filter("k <> ''").distinct()
    found = labels.select("label", key(F.col("label")).alias("k")).distinct().join(names, "k", "left")
    counted = found.groupBy("label").agg(F.countDistinct("id").alias("n"), F.min("id").alias("one"))
    return counted.select("label", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("term"))


def selected(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted rows; unreviewed ones only where the same keys have no accepted row."""
    any_ = F.max((F.col("state") == "accepted").cast("int")).over(Window.partitionBy(*keys))
    return assertions.withColumn("_any", any_).filter((F.col("state") == "accepted") | ((F.col("state") == "unreviewed") & (F.col("_any") == 0))).drop("_any")


def replace_generated(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """State after a machine run: its rows are added once, machine rows it no longer makes are superseded, human ones stay."""
    mine = new.select(*keys).distinct().withColumn("_made", F.lit(True))
    kept = existing.join(mine, keys, "left")
    state = F.when((F.col("reviewer").isNull()) & F.col("_made").isNull() & (F.col("state") == "unreviewed"), "superseded").otherwise(F.col("state"))
    added = new.join(existing.select(*keys).distinct(), keys, "left_anti")
    return kept.withColumn("state", state).select(*existing.columns).unionByName(added.select(*existing.columns))


def feature_records(features: DataFrame, names: DataFrame) -> DataFrame:
    """features (.., feature, score) with the name each stands for and whether that is ambiguous; unnamed ones go."""
    return features.join(names.select("feature", "name", "ambiguous"), "feature")


def known_or_unknown(value: Column, unknown: Column) -> tuple[Column, Column]:
    """(no value, consistent): a field has a value, or says that it is unknown, and never both or neither."""
    return value.isNull(), value.isNull() == unknown


def first_given(*sources: Column) -> Column:
    """The first source that has a value, else `unknown`."""
    return F.coalesce(*sources, F.lit("unknown"))


def assertion_rows(run: DataFrame, id: str, fields: list[str], accepted: Column) -> DataFrame:
    """(id, field, value, state): a row for each field that has a value."""
    given = run.select(id, F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]).alias("_f"))
    return given.select(id, F.explode("_f").alias("field", "value")).filter("value is not null").withColumn("state", F.when(accepted, "accepted").otherwise("unreviewed"))


def term_index(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, status, name) of wanted ids: present, obsolete or missing in terms (id, name, obsolete)."""
    found = wanted.select("id").distinct().join(terms.select("id", "name", "obsolete", F.lit(True).alias("_there")), "id", "left")
    return found.select("id", F.when(F.col("_there").isNull(), "missing").when(F.col("obsolete"), "obsolete").otherwise("present").alias("status"), "name")


def reviewed(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """(key, state, audited): states after reviews (key, state), which leave a mark in the audit."""
    given = reviews.select(key, F.col("state").alias("_new"))
    return rows.join(given, key, "left").select(key, F.coalesce("_new", "state").alias("state"), F.col("_new").isNotNull().cast("int").alias("audited"))


def pending(records: DataFrame, cached: DataFrame, key: str, hash: str) -> DataFrame:
    """Records (key, hash) that no cached result of the same hash stands for."""
    return records.select(key, hash).join(cached.select(key, hash), [key, hash], "left_anti")
