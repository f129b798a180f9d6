"""URL filters: path rules first, then the reputation of the host.

Labelled page outcomes are added up by host, registered domain and suffix. Each
level's rate is shrunk towards the level above it by a beta prior whose strength
is fitted on the data; a host is blocked if the lower bound of its posterior bad
rate passes ``limit``. DataFrame functions only.

The tables at hand label no pages, only documents. As a stand-in the query takes the
label of the document whose identifier is the page's; the two have nothing to do with
each other, so on these tables all hosts are about alike and none is blocked. Real
outcomes are the argument ``labels`` of :func:`url_filters`.

Defined cases: a url that is null or has no ``://`` has an empty host and path,
fits no rule and is judged as host ``''``; a page without a label adds no
outcome; a label repeated for a page is bad if one of its rows is; repeated pages
each count and return; empty tables give an empty result or no reputation (allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onset.llm.common import ascii_lower, beta_prior, join_few, written

#: verdict, rule: host, then the start of the path
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Public suffixes of more than one label; the rest are a host's last label.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "co.kr"]
LIMIT, Z = 0.5, 1.645


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    pattern = r"^([^/?#]*)([^?#]*)"
    return F.coalesce(ascii_lower(F.regexp_extract(rest, pattern, 1)), F.lit("")), F.coalesce(F.regexp_extract(rest, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. The rules are
    a list in the plan, so they are few; a longer rule is tried first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, start = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, its port left out."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.", -1)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), F.lit(n)), ".")
    long = last(2).isin(LONG_SUFFIXES)
    return F.when(long, last(3)).otherwise(last(2)), F.when(long, last(2)).otherwise(last(1))


def _strength(groups: DataFrame) -> float:
    """Observations that the prior of a level is worth: one row to the driver."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    seen = groups.where(F.col("n") > 0).agg(F.sum(n), F.sum(bad), F.sum(n * n), F.sum(bad * bad / n), F.count("*")).first()
    alpha, beta = beta_prior(*seen)
    return alpha + beta


def reputation(outcomes: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``host``, ``n``, ``bad``, posterior ``mean``, lower bound ``bound`` and
    ``blocked`` from rows of ``host`` and ``bad`` (null: not labelled)."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = written(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = (total[1] or 0) / total[0] if total[0] else 0.0
    weak, mid, strong = _strength(suffixes), _strength(domains), _strength(hosts)
    shrunk = lambda n, bad, prior, worth: (F.col(bad) + prior * worth) / (F.col(n) + worth)
    suffixes = suffixes.select("suffix", shrunk("n", "bad", F.lit(overall), weak).alias("of_suffix"))
    domains = join_few(domains, suffixes, ["suffix"], "inner", "domain").select("domain", "suffix", shrunk("n", "bad", F.col("of_suffix"), mid).alias("of_domain"))
    rated = join_few(hosts, domains, ["domain", "suffix"], "inner", "host").withColumn("mean", shrunk("n", "bad", F.col("of_domain"), strong))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + (strong + 1)))
    return rated.select("host", "n", "bad", "mean", (F.col("mean") - sd * z).alias("bound")).withColumn("blocked", F.col("bound") > limit)


def url_filters(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = LIMIT, key: str = "page_id", url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, one row a page.

    A label's row is bad if its quality is 0 or it is toxic; labels with neither
    are no outcome. Pages and labels meet once, on the page's id; only blocked
    hosts are joined back.
    """
    parts = dict(zip(("host", "path"), url_parts(F.col("url")), strict=True))
    seen = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select("page_id", *(c.alias(k) for k, c in parts.items()))
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    known = labels.select(F.col(label_key).alias("page_id"), bad.alias("bad")).where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    judged = reputation(seen.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), limit)
    blocked = judged.where("blocked").select("host", F.lit("block").alias("by_host"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return join_few(seen, blocked, ["host"], "left", "page_id").select(F.col("page_id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))


def _strength_sql(name: str, table: str) -> str:
    """The worth of a level's prior, a table ``name`` of one row, from its ``n`` and ``bad``."""
    return f"""{name}m AS (SELECT sum(n)::DOUBLE AS n, least(greatest(sum(bad) / sum(n), 1e-6), 1 - 1e-6) AS m, sum(n)::DOUBLE - sum(n::DOUBLE * n) / sum(n) AS room, sum(bad::DOUBLE * bad / n) AS spread, count(*) AS g FROM {table} WHERE n > 0),
{name}r AS (SELECT *, least(greatest(CASE WHEN room > g - 1 THEN ((spread - n * m * m) / (m * (1 - m)) - (g - 1)) / (room - (g - 1)) ELSE 0 END, 1e-3), 0.5) AS rho FROM {name}m),
{name} AS (SELECT CASE WHEN n IS NULL OR n = 0 THEN 2.0 WHEN g < 2 OR room <= 0 THEN 10.0 ELSE (1 - rho) / rho END AS s FROM {name}r)"""


def filters_sql(rules: list[tuple[str, str]] = RULES, limit: float = LIMIT, z: float = Z) -> str:
    """:func:`url_filters` of the tables ``pages`` and ``labels`` in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    whens = {"rule": "", "says": ""}
    for says, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, start = rule.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}')"
        whens["rule"] += f" WHEN {fits} THEN '{rule}'"
        whens["says"] += f" WHEN {fits} THEN '{says}'"
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    last = lambda n: f"array_to_string(lb[greatest(1, len(lb) - {n - 1}):], '.')"
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
l AS (SELECT doc_id, max(CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
hh AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS lb FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
h AS (SELECT *, CASE WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM hh),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
{_strength_sql('ws', 's')}, {_strength_sql('wd', 'd')}, {_strength_sql('wh', 'h')}, o AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS m FROM h),
sr AS (SELECT suffix, (bad + o.m * ws.s) / (n + ws.s) AS r FROM s, o, ws), dr AS (SELECT domain, d.suffix, (bad + sr.r * wd.s) / (n + wd.s) AS r FROM d JOIN sr USING (suffix), wd),
hr AS (SELECT host, n, (bad + dr.r * wh.s) / (n + wh.s) AS m, wh.s FROM h JOIN dr USING (domain, suffix), wh), b AS (SELECT host FROM hr WHERE m - sqrt(m * (1 - m) / (n + (s + 1))) * {z} > {limit}), j AS (SELECT page_id, host, path, CASE{whens['rule']} END AS rule, CASE{whens['says']} END AS says FROM p)
SELECT page_id, j.host, path, rule, coalesce(says, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN b ON b.host = j.host"""
