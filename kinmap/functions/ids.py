"""Identity as columns: stable ids, ordered pairs, fingerprints and normalisers."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\u001f"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix, and 24 hexadecimal digits of a hash of the parts; a null part counts as the empty text."""
    joined = F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Smaller and larger endpoint; a pair of one is an error."""
    same = F.raise_error(F.lit("a pair needs two endpoints"))
    return F.when(a == b, same).otherwise(F.least(a, b)), F.greatest(a, b)


def ordered_hash(values: Column, separator: str = "\n", bits: int = 256) -> Column:
    """Hash of values in the order they stand in; bits 1 for SHA-1."""
    joined = F.array_join(values, separator)
    return F.sha1(joined) if bits == 1 else F.sha2(joined, bits)


def sorted_set_hash(values: Column) -> Column:
    """Hash of texts sorted bytewise, each followed by a NUL."""
    return F.sha2(F.concat(F.array_join(F.array_sort(values), "\0"), F.lit("\0")), 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("^[0-9a-f]{64}$"), F.lit(False))


def normal_id(text: Column, upper: bool = True) -> Column:
    """Trimmed and in one case; null where nothing is left."""
    return F.nullif((F.upper if upper else F.lower)(F.trim(text)), F.lit(""))


def ascii_term(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def accession_bucket(accession: Column) -> Column:
    """GSE, the accession's digits but the last three, and nnn, as archives name folders."""
    digits = F.regexp_extract(accession, "([0-9]+)$", 1)
    return F.concat(F.lit("GSE"), F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))), F.lit("nnn"))


def dataset_from_file(path: Column) -> Column:
    """Leading GSE number of a file name, else its stem without _RAW; in upper case."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(\.[^.]*)$", ""), "(?i)_RAW", "")
    series = F.regexp_extract(name, "(?i)^(GSE[0-9]+)", 1)
    return F.upper(F.when(series != "", series).otherwise(stem))


def slug(text: Column, longest: int = 64) -> Column:
    """ASCII letters and digits with single dashes between, lower case, bounded."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, longest)


def export_slug(text: Column, longest: int = 64) -> Column:
    """A file name's stem from any title: compatibility forms taken apart, accents dropped, then as slug(); `export` for nothing."""
    return F.coalesce(F.nullif(slug(_plain(text), longest), F.lit("")), F.lit("export"))


@F.arrow_udf(StringType())
def _plain(text: pa.Array) -> pa.Array:
    apart = (None if t is None else unicodedata.normalize("NFKD", t) for t in text.to_pylist())
    return pa.array([None if t is None else "".join(c for c in t if not unicodedata.combining(c)) for t in apart], pa.string())


def description(*parts: Column) -> Column:
    """The parts that aren't blank, trimmed, with a space between."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def portable_path(path: Column) -> Column:
    """The path with plain slashes, or null where it isn't a relative path to a file that every system can hold."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(plain, "/")
    # Device names of some systems.
    device = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    good = lambda x: ~x.isin("", ".", "..") & (F.length(x) <= 255) & ~x.rlike(r"[ .]$") & ~x.rlike(r'[\x00-\x1F<>:"|?*]') & ~x.rlike(device)
    return F.when((F.length(path) <= 2048) & F.forall(parts, good), plain)


def csv_cell(value: Column) -> Column:
    """A quoted cell that a spreadsheet won't run: a leading quote where text starts like a formula, or with a tab or line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"\A[\t\r\n]|\A\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def backoff_seconds(attempts: Column, job: Column) -> Column:
    """Doubling delay of at most a day, and up to a quarter of it more by a hash of the job."""
    base = F.least(F.lit(86_400), (F.lit(30) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1)).cast("long"))
    jitter = F.conv(F.substring(F.sha2(job.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return base + jitter % F.greatest(F.floor(base / 4).cast("long"), F.lit(1))
