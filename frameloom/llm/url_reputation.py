"""URL filtering by rules and by empirical-Bayes host reputation.

A rule names a host and a path prefix; it fits that host and its subdomains, and
the longest fitting rule decides. Urls without a rule are judged by the share of
bad pages expected of their host: labelled outcomes are shrunk with beta-binomial
priors, from all labels to the public suffix, from the suffix to the registered
domain and from there to the host. A host is blocked when even the lower bound of
its posterior bad share, the ``RISK`` quantile of its beta distribution, exceeds ``max_bad``.

Outcomes: a page shows the document whose number is its path's second part, as in
/en/685.html; the labels of that document are the page's.

Everything is DataFrame expressions. Defined results: a null url, or one without
``://``, has empty host and path, no rule and the verdict allow; repeated pages are
all returned; a page that has several labels counts once, as bad if any is; no
labels at all means no evidence, so the method allows; other columns of the input
are ignored. Ties between rules of one length go to the longer host, then to the
smaller text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm import beta
from frameloom.llm.common import lower_ascii, materialize, settled

#: Suffixes of two labels under which names are registered, unless others are given: common ones, not the whole public list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_BAD, RISK = 0.3, 0.05


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, host_length, rule, verdict) of the rule that decides, or null."""
    if not rules:
        return F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    found = None
    for verdict, rule_host, rule_path in ranked:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def public_suffix(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The last two labels if they are a known suffix, else the last one; an address stays whole."""
    last_two = F.substring_index(host, ".", -2)
    return (
        F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$|^\["), host)
        .when(last_two.isin(*suffixes), last_two)
        .otherwise(F.substring_index(host, ".", -1))
    )


def registered_domain(host: Column, suffix: Column) -> Column:
    labels = F.size(F.split(suffix, r"\."))
    return F.when(host == suffix, host).otherwise(
        F.concat_ws(".", F.slice(F.split(host, r"\."), -F.least(labels + 1, F.size(F.split(host, r"\."))), F.least(labels + 1, F.size(F.split(host, r"\."))))))


def _shrink(groups: DataFrame, prior: str, known: str, out: str) -> DataFrame:
    """Add ``{out}_a`` and ``{out}_b``: beta posterior of each group around ``prior``, its parent's mean.

    The concentration comes from the between-group variance of the whole level by
    the method of moments: E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho). With fewer than
    two groups to compare the prior stays as weak as one label, and it never weighs more
    than ``known``, the labels and prior labels behind the parent's mean.
    """
    n, bad, m = F.col("n").cast("double"), F.col("bad").cast("double"), F.col(prior)
    excess = n * F.pow(bad / n - m, 2) / (m * (1 - m)) - 1
    moments = groups.where("n > 1").agg(F.sum(excess).alias("over"), F.sum(n - 1).alias("pairs"), F.count("*").alias("groups")).first()
    rho = moments["over"] / moments["pairs"] if moments["groups"] > 1 else 0.5
    rho = min(max(rho, 1e-3), 0.5)
    kappa = F.least(F.lit((1 - rho) / rho), F.col(known))
    return groups.withColumns({f"{out}_a": kappa * m + bad, f"{out}_b": kappa * (1 - m) + n - bad})


def host_reputation(pages: DataFrame, outcomes: DataFrame, risk: float = RISK, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per host: host, n_labelled, n_bad, bad_mean, bad_bound.

    pages: page_id, host. outcomes: page_id, bad (0 or 1; null rows are left out).
    """
    once = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    suffix = public_suffix(F.col("host"), suffixes)
    hosts = (
        pages.where("host <> ''").join(once, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("suffix", suffix).withColumn("domain", registered_domain(F.col("host"), F.col("suffix")))
    )
    hosts = materialize(hosts, "url-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)  # inside (0, 1) whatever the labels

    def up(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def prior(level: str) -> list[Column]:
        weight = F.col(f"{level}_a") + F.col(f"{level}_b")
        return [(F.col(f"{level}_a") / weight).alias(f"{level}_mean"), weight.alias(f"{level}_weight")]

    top = up(hosts, "suffix").withColumns({"all_mean": F.lit(overall), "all_weight": F.lit(float((total["n"] or 0) + 2))})
    suffixes = _shrink(top, "all_mean", "all_weight", "suffix")
    domains = _shrink(up(hosts, "suffix", "domain").join(suffixes.select("suffix", *prior("suffix")), "suffix"), "suffix_mean", "suffix_weight", "domain")
    each = _shrink(hosts.join(domains.select("domain", *prior("domain")), "domain"), "domain_mean", "domain_weight", "host")
    a, b = F.col("host_a"), F.col("host_b")
    parts = settled(each, ["host", "n", "bad", "host_a", "host_b"], log_b=beta.log_beta(a, b))
    bound = settled(parts, ["host", "n", "bad", "host_a", "host_b"], bad_bound=beta.quantile(risk, a, b, F.col("log_b")))
    return bound.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), (a / (a + b)).alias("bad_mean"), "bad_bound")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, risk: float = RISK, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, verdict and the evidence."""
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = materialize(host_reputation(parsed.select("page_id", "host"), outcomes, risk, suffixes), "host-reputation")
    ruled = parsed.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return ruled.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
        F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), "bad_mean", "bad_bound",
    )


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad of the pages whose path names a labelled document: bad if it is of low quality or toxic."""
    number = F.regexp_extract(url_path(F.col("url")), r"^/[^/]*/([0-9]{1,18})(?![0-9])", 1).try_cast("long")
    shown = pages.select("page_id", number.alias("doc_id")).where("page_id is not null and doc_id is not null")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.select("doc_id", bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad")).where("bad is not null")
    return shown.join(known, "doc_id").select("page_id", "bad")
