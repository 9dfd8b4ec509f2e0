"""URL filter: rules first, then empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.za", "co.kr", "com.tr", "com.ar", "com.tw")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(rows: DataFrame) -> float:
    """Prior weight from the spread of rates x/n around their means (beta-binomial moments)."""
    v = F.expr("m * (1 - m)")
    spread, even, more = rows.filter("n > 0").agg(F.sum(F.expr("n * (x / n - m) * (x / n - m)")), F.sum(v), F.sum(v * (F.col("n") - 1))).first()
    rho = (spread - even) / more if more else 0.5
    return 1 / min(0.9, max(0.001, rho)) - 1


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, rate and bound: what is known of every host in ``outcomes`` (host, bad: 1, 0 or null for unlabelled).

    The rate of a suffix is shrunk towards all, a registered domain's towards its suffix, a host's towards its domain;
    each level's prior weight is estimated from the spread over that level. bound is the lower posterior bound of the
    host's rate of bad pages: mean less z posterior standard deviations. A host without labels has its domain's prior.
    """
    sums = (F.sum("x").alias("x"), F.sum("n").alias("n"))
    labels = F.split("host", r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"), F.count("bad").alias("n"))
    hosts = hosts.withColumn("parts", F.when((F.size(labels) >= 2) & two.isin(*SUFFIXES), 2).otherwise(1))
    hosts = staged(hosts.withColumn("suffix", F.expr(r"substring_index(host, '.', -parts)")).withColumn("domain", F.expr(r"substring_index(host, '.', -parts - 1)")).drop("parts"))
    domains = staged(hosts.groupBy("suffix", "domain").agg(*sums))
    suffixes = staged(domains.groupBy("suffix").agg(*sums))
    bad, n = suffixes.agg(F.sum("x"), F.sum("n")).first()
    prior = ((bad or 0) + 0.5) / ((n or 0) + 1)
    suffixes = suffixes.withColumn("m", F.lit(prior))
    w = _strength(suffixes)
    suffixes = staged(suffixes.selectExpr("suffix", f"({w}D * m + x) / ({w}D + n) as m"))
    domains = domains.join(suffixes, "suffix")
    w = _strength(domains)
    domains = staged(domains.selectExpr("domain", f"({w}D * m + x) / ({w}D + n) as m"))
    hosts = hosts.join(domains, "domain")
    w = _strength(hosts)
    hosts = hosts.selectExpr("host", f"{w}D * m + x as a", f"{w}D * (1 - m) + n - x as b")
    return hosts.selectExpr("host", "a / (a + b) as rate", f"a / (a + b) - {z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound")


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    Pages that a rule fits are the labelled outcomes (block: bad). A page without a rule is blocked if the lower
    posterior bound of its host's rate of bad pages exceeds ``threshold``. A null url, or one without ``://``, has
    host and path '' and is judged as a host of that name. Repeated pages are each judged; an empty table gives
    an empty result; other columns are not read.
    """
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    read = read.withColumn("rule", rule).withColumn("said", verdict)
    scores = staged(reputations(read.select("host", (F.col("said") == "block").cast("int").alias("bad"))))
    joined = read.join(scores, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"))


def oracle(rules: tuple[tuple[str, str], ...] = RULES, z: float = 1.645, threshold: float = 0.5) -> str:
    """DuckDB SQL for ``judged``."""
    fits = lambda t: "((host = '{0}' or host like '%.{0}') and starts_with(path, '/{1}'))".format(*t.split("/", 1))
    longest = sorted(rules, key=lambda r: -len(r[1]))
    rule = "case " + " ".join(f"when {fits(t)} then '{t}'" for _, t in longest) + " end"
    said = "case " + " ".join(f"when {fits(t)} then '{w}'" for w, t in longest) + " end"
    weight = lambda t: f"(select 1 / least(0.9, greatest(0.001, case when sum(m*(1-m)*(n-1)) <> 0 then (sum(n*(x/n-m)*(x/n-m)) - sum(m*(1-m))) / sum(m*(1-m)*(n-1)) else 0.5 end)) - 1 from {t} where n > 0)"
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"""
    with p as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
    r as (select *, {rule} as rule, {said} as said from p),
    h0 as (select host, sum(case when said = 'block' then 1 else 0 end)::double as x, count(said)::double as n, string_split(host, '.') as l from r group by host),
    h1 as (select *, case when len(l) >= 2 and array_to_string(l[-2:], '.') in ({two}) then 2 else 1 end as k from h0),
    h as (select host, x, n, array_to_string(l[-k:], '.') as suffix, array_to_string(l[-k-1:], '.') as domain from h1),
    d0 as (select suffix, domain, sum(x) as x, sum(n) as n from h group by all),
    s0 as (select suffix, sum(x) as x, sum(n) as n from d0 group by all),
    s1 as (select *, (select (sum(x) + 0.5) / (sum(n) + 1) from s0) as m from s0),
    s2 as (select suffix, ({weight('s1')} * m + x) / ({weight('s1')} + n) as m from s1),
    d1 as (select d0.*, m from d0 join s2 using (suffix)),
    d2 as (select domain, ({weight('d1')} * m + x) / ({weight('d1')} + n) as m from d1),
    h2 as (select h.*, m from h join d2 using (domain)),
    h3 as (select host, {weight('h2')} * m + x as a, {weight('h2')} * (1 - m) + n - x as b from h2),
    h4 as (select host, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from h3)
    select page_id, r.host, path, rule, coalesce(said, case when bound > {threshold} then 'block' else 'allow' end) as verdict from r join h4 using (host)"""
