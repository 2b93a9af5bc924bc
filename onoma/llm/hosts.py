"""URL filter by empirical-Bayes host reputation (operator 6, native).

Labelled outcomes (1 = bad page) are counted per host and shrunk down a
chain of beta-binomial priors: all pages -> suffix -> registered domain ->
host. Each level's prior has the parent's posterior mean and a strength (a
pseudo-count) fitted by the method of moments over all groups of that level.
A host is blocked when the lower bound of its posterior (normal approximation
of the beta, ``z`` standard deviations) is above ``max_bad``: a page is only
blocked on evidence, and an unseen host inherits its domain's posterior.

Skew: counting aggregates before the shuffle. To bring verdicts back, hosts
holding more than 1/``HOT_SHARE`` of the rows (at most ``HOT_SHARE`` of them,
a proven bound) are broadcast and their pages never shuffle; the other hosts
are joined by a shuffle, which no host can dominate.

Null urls and urls without ``://`` have an empty host and path; they are
judged as the group of the empty host. Ties between rules cannot arise
(equal-length rules are different hosts or paths); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import lower_ascii, materialize

#: Fixed rules of the contract: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
HOT_SHARE = 1000
MAX_BAD = 0.35
#: Bad pages and pages assumed before any label.
ALL_PRIOR = (1, 10)
Z = 1.645
#: Bounds of a prior's fitted strength, in pages.
STRENGTH = (2.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label of a host: its public suffix in the simple one-label model."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """Last two labels of a host: its registered domain in the one-label model."""
    return F.substring_index(host, ".", -2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shrunk(groups: DataFrame, n: str, k: str, prior: Column) -> DataFrame:
    """Adds ``post``, ``strength`` from the counts n, k and the prior mean.

    Moments of the beta-binomial: with m the pooled mean and v the
    n-weighted variance of group rates, v = m(1-m)/n * (1 + (n-1) rho) gives
    rho, and the strength is 1/rho - 1.
    """
    stat = groups.agg(
        F.sum(n).alias("sn"),
        F.sum(k).alias("sk"),
        F.count(F.when(F.col(n) > 0, 1)).alias("g"),
        F.sum(F.when(F.col(n) > 0, F.col(k) * F.col(k) / F.col(n))).alias("skk"),
        F.sum(F.when(F.col(n) > 0, F.col(n) * F.col(n))).alias("snn"),
    ).select(
        (F.col("sk") / F.nullif(F.col("sn"), F.lit(0))).alias("m"),
        "sn", "sk", "g", "skk", "snn",
    )
    # ANOVA estimate of the intra-group correlation
    msb = (F.col("skk") - F.col("sk") * F.col("m")) / F.nullif(F.col("g") - 1, F.lit(0))
    msw = (F.col("sk") - F.col("skk")) / F.nullif(F.col("sn") - F.col("g"), F.lit(0))
    n0 = (F.col("sn") - F.col("snn") / F.col("sn")) / F.nullif(F.col("g") - 1, F.lit(0))
    rho = (msb - msw) / F.nullif(msb + (n0 - 1) * msw, F.lit(0.0))
    lo, hi = STRENGTH
    fitted = F.when(rho > 0, F.greatest(F.least(1 / rho - 1, F.lit(hi)), F.lit(lo))).otherwise(F.lit(hi))
    stat = stat.select(F.coalesce(fitted, F.lit(hi)).alias("strength"))
    return groups.crossJoin(F.broadcast(stat)).withColumn(  # stat is one row
        "post", (F.col(k) + F.col("strength") * prior) / (F.col(n) + F.col("strength"))
    )


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n_pages, n, k, post, lower``: every host of ``pages``.

    ``pages`` has ``host`` and ``key``; ``outcomes`` has ``key`` and ``bad``
    (0/1, one row per key). Keys without outcome count as unlabelled.
    """
    labelled = (
        pages.filter(F.col("key").isNotNull()).select("host", "key").join(outcomes.select("key", "bad"), "key")
        .groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
    )
    hosts = (
        pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).join(labelled, "host", "left")
        .withColumns({
            "n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0)),
            "domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host")),
        })
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn_"), F.sum("dk").alias("sk_"))
    # before any label a page is bad with probability ALL_PRIOR[0] / ALL_PRIOR[1]
    whole = suffixes.agg(
        ((F.coalesce(F.sum("sk_"), F.lit(0)) + ALL_PRIOR[0]) / (F.coalesce(F.sum("sn_"), F.lit(0)) + ALL_PRIOR[1])).alias("all_mean")
    )
    suffixes = suffixes.crossJoin(F.broadcast(whole))  # one row
    suffixes = _shrunk(suffixes, "sn_", "sk_", F.col("all_mean")).select("suffix", F.col("post").alias("s_post"))
    domains = _shrunk(domains.join(suffixes, "suffix"), "dn", "dk", F.col("s_post")).select("domain", F.col("post").alias("d_post"))
    hosts = _shrunk(hosts.join(domains, "domain"), "n", "k", F.col("d_post"))
    size = F.col("n") + F.col("strength")
    lower = F.col("post") - Z * F.sqrt(F.col("post") * (1 - F.col("post")) / (size + 1))
    return hosts.select("host", "n_pages", "n", "k", "post", F.greatest(lower, F.lit(0.0)).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_lower`` for every page.

    ``pages`` has ``page_id, url, key``; see ``host_reputation`` for ``key``.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "key", host.alias("host"), path.alias("path"))
    rep = materialize(host_reputation(split, outcomes), "hosts")
    total = rep.agg(F.sum("n_pages")).first()[0] or 0
    rep = rep.withColumn("hot", F.col("n_pages") * HOT_SHARE > F.lit(total))
    view = split.select("page_id", "host", "path")
    hot = rep.filter("hot").select("host", "post", "lower")  # fewer than HOT_SHARE rows
    cold = rep.filter("not hot").select("host", "post", "lower")
    both = view.join(F.broadcast(hot), "host").unionByName(
        view.join(F.broadcast(hot.select("host")), "host", "left_anti").join(cold, "host")
    )
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return both.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"),
        F.col("post").alias("bad_rate"), F.col("lower").alias("bad_lower"),
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """``key, bad``: a document labelled low quality or toxic is a bad page."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.max(bad.cast("int")).alias("bad")
    )


def page_key(url: Column) -> Column:
    """Document number in a page's path (``/<lang>/<number>``), else null."""
    number = F.regexp_extract(split_url(url)[1], r"^/[^/]*/([0-9]{1,18})(?:[^0-9]|$)", 1)
    return F.when(number != "", number.cast("long"))
