"""URL filters: pattern rules indexed by their rarest literal token, over a table of host and path rules.

Host and path rules allow or block a host with all its subdomains from a path prefix on; the longest that fits a URL
decides. Where none fits, pattern rules decide. A pattern is literal text with `*` (anything), `^` (one character that
is no ASCII letter or digit, or the end), `|` at either end (start or end of the URL) and `||` at the start (start of
the host or of one of its labels); `@@` in front makes it an exception, which wins over blocks. Patterns are matched
against the URL in lower case. A run of letters and digits in a pattern with a separator on either side must be a whole
token of any URL that matches, so each rule is filed under that of its tokens that is in the fewest distinct URLs.
The tokens of a URL fetch the rules filed under them, and only those run their regular expression. Rules without such
a token (none by default) run against every URL.

All by DataFrame functions. The rules are configuration, at most MOST_RULES of them and MOST_TEXT characters, so their
table is broadcast.
URLs are judged once each: only distinct ones are exploded, and a URL that fills a third of the rows is one row there.

Cases: a null URL, or one without `://`, has empty host and path, fits no host rule, and is allowed (a pattern is run
only against URLs with `://`). An empty path fits only rules with an empty path. Repeated rows and null ids are
judged row by row. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 100_000
#: Characters of all patterns together, whose table is broadcast.
MOST_TEXT = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path prefix)
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Gambling, pills, adult and malware addresses, and an exception for pages of help with them.
PATTERNS = (
    "^casino^", "^casino-win.", "^free-bets.", "^bets^", "^poker^", "^slots^", "^jackpot^", "^viagra^", "^cialis^", "^cheap-pills.", "^pills^",
    "^xxx^", "^porn^", "^adult-*.", "^escort^", "^payday-loans^", "^replica-*^watches^", "^free-download^*.exe|", "||ads.*^banner^", "||click.*^redirect^",
    "^torrent^", "^warez^", "^keygen^", "^crack^*^serial^", "@@^gambling-help^", "@@^responsible-gaming^",
)
_END, _SEP = "(?:$)", "(?:[^a-z0-9]|$)"


def to_regex(pattern: str) -> str:
    """Regular expression that Java, RE2 and Python read alike; found anywhere in the lower-case URL."""
    body = pattern.removeprefix("@@")
    start = end = ""
    if body.startswith("||"):
        body, start = body[2:], r"^[^:]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    out = []
    for i, c in enumerate(body):
        first = i == 0 and not start
        out.append(".*" if c == "*" else ("(?:^|[^a-z0-9])" if first else _SEP) if c == "^" else re.sub(r"([^a-z0-9])", r"\\\1", c))
    return "(?s)" + start + "".join(out) + end


def tokens_of(pattern: str) -> list[str]:
    """Runs of letters and digits that are whole tokens wherever the pattern matches."""
    body = pattern.removeprefix("@@")
    body = body.replace("||", "\0") if body.startswith("||") else body
    return sorted({m[0] for m in re.finditer(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", body) if (m.start() > 0) and m.end() < len(body)})


def lowered(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(url), "[^a-z0-9]+"))


def file_rules(urls: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(token, pattern, regex, exception): each rule under its rarest token; a null token where it has none.

    urls: distinct URLs. Only the counts of the rules' own tokens reach the driver.
    """
    spark = urls.sparkSession
    if len(patterns) > MOST_RULES or sum(map(len, patterns)) > MOST_TEXT:
        raise ValueError(f"more than {MOST_RULES} rules, or {MOST_TEXT} characters of them")
    own = {p: tokens_of(p) for p in patterns}
    named = sorted({t for ts in own.values() for t in ts})
    known = spark.createDataFrame([(t,) for t in named], "token string")
    counts = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(F.broadcast(known), "token").groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.collect()} if named else {}
    rows = [(min(ts, key=lambda t: (seen.get(t, 0), t)) if ts else None, p, to_regex(p), p.startswith("@@")) for p, ts in own.items()]
    return spark.createDataFrame(rows, "token string, pattern string, regex string, exception boolean")


def read_rules(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Patterns of a rule file in any store: one a line, without blank lines and those that begin with an exclamation mark.

    At most MOST_RULES lines, which is what reaches the driver.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '!')")
    found = [r["value"] for r in lines.limit(MOST_RULES + 1).collect()]
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(dict.fromkeys(found))


def judge(pages: DataFrame, host_rules: tuple = HOST_RULES, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """page_id, url, host, path, rule, pattern and verdict of every row."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url")
    urls = rows.filter(F.instr("url", "://") > 0).select("url").distinct()
    filed = file_rules(urls, patterns)
    hit = F.expr("rlike(low, regex)")
    fetched = urls.select("url", lowered(F.col("url")).alias("low"), F.explode(_tokens(F.col("url"))).alias("token")).join(F.broadcast(filed), "token").filter(hit)
    matched = fetched.select("url", "pattern", "exception")
    if any(not tokens_of(p) for p in patterns):
        rest = urls.select("url", lowered(F.col("url")).alias("low")).join(F.broadcast(filed.filter("token is null")), F.expr("rlike(low, regex)"))
        matched = matched.unionByName(rest.select("url", "pattern", "exception"))
    table = spark.createDataFrame([(h, p, a, len(h) + len(p)) for a, h, p in host_rules], "rule_host string, rule_path string, action string, size int")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = (
        hosts.select("url", "path", F.explode(suffixes).alias("rule_host"))
        .join(F.broadcast(table), "rule_host")
        .filter(F.expr("startswith(path, rule_path)"))
        .select("url", F.struct((-F.col("size")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"), "action").alias("fit"))
    )
    found = (
        fits.unionByName(matched.select("url", F.struct("exception", "pattern").alias("match")), allowMissingColumns=True)
        .groupBy("url")
        .agg(F.min("fit").alias("fit"), F.max("match.exception").alias("excepted"), F.min(F.when(~F.col("match.exception"), F.col("match.pattern"))).alias("pattern"))
    )
    by_method = F.when(F.col("pattern").isNotNull() & ~F.coalesce("excepted", F.lit(False)), "block").otherwise("allow")
    return rows.join(found, "url", "left").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("fit.rule").alias("rule"),
        F.when(F.col("fit").isNull(), F.col("pattern")).alias("pattern"), F.coalesce("fit.action", by_method).alias("verdict"),
    )


def sql(host_rules: tuple = HOST_RULES, patterns: tuple[str, ...] = PATTERNS) -> str:
    """The same verdicts in DuckDB, with every rule run against every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"({quote(h)}, {quote(p)}, {quote(a)})" for a, h, p in host_rules)
    any_of = lambda ps: " or ".join(f"regexp_matches({low}, {quote(to_regex(p))})" for p in ps) or "false"
    blocks = [p for p in patterns if not p.startswith("@@")]
    first = " ".join(f"when regexp_matches({low}, {quote(to_regex(p))}) then {quote(p)}" for p in sorted(blocks))
    excepted = any_of([p for p in patterns if p.startswith("@@")])
    return f"""
with rules(h, p, action) as (values {rules}),
parts as (
  select row_number() over () as k, page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
best as (
  select k, min(struct_pack(size := -(length(h) + length(p)), rule := h || p, action := action)) as fit
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k),
matched as (
  select k, page_id, url, host, path, case when contains(url, '://') then case {first} end end as pattern,
    coalesce(contains(url, '://') and ({excepted}), false) as excepted from parts)
select page_id, host, path, fit.rule as rule, case when fit is null then pattern end as pattern,
  coalesce(fit.action, case when pattern is not null and not excepted then 'block' else 'allow' end) as verdict
from matched left join best using (k)"""
