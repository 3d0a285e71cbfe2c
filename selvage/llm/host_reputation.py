"""Judgement of urls by rules and by an empirical-Bayes reputation of their hosts.

Labelled pages say which outcomes a host had. A host's rate of bad pages is shrunk towards that of its registered
domain, the domain's towards its suffix's, and the suffix's towards that of all labelled pages, each time without the
unit's own outcomes, so that none counts twice. At each step a beta-binomial prior, fitted by moments to the rates of
all units of that step, gives the weight of the parent's rate.
A host is blocked if the lower posterior bound of its bad rate is over `limit`, so that few outcomes block nobody.

The registered domain is the suffix and one label more. Suffixes come from a table of rules as public lists have them
(`co.uk`, `*.ck` for any label there, `!www.ck` for an exception), of which the exception, else the longest that fits
wins, and the last label where none fits. Without a table a stated default holds: the last label, or the last two if
these are one of SECOND_LEVEL under a two-letter country label. Rules of verdicts take precedence over reputations: the
longest that fits wins.

A host with a large part of the pages is dealt to many tasks where pages meet their hosts' rates.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule, and has the reputation of
all pages; labels of unknown pages count for nothing; null labels are left out; several labels of one page count as
one with the worst; without any label nothing is blocked by reputation; other columns pass through, and those of the
outputs' names are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import aside, lower_ascii, spread_join, written

#: Fixed: labels that form a suffix together with a country's.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def host_of(url: Column) -> Column:
    """From the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(host: Column) -> Column:
    """Struct of suffix and registered domain by the default rule."""
    labels = F.split(host, r"\.")
    last, second, third = (F.coalesce(F.try_element_at(labels, F.lit(-n)), F.lit("")) for n in (1, 2, 3))
    double = (F.length(last) == 2) & second.isin(SECOND_LEVEL) & (third != "")
    suffix = F.when(double, F.concat_ws(".", second, last)).otherwise(last)
    domain = F.when(double, F.concat_ws(".", third, second, last)).when(second != "", F.concat_ws(".", second, last)).otherwise(last)
    return F.struct(suffix.alias("suffix"), domain.alias("domain"))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (one row a host) with suffix and domain; suffixes: a table whose first column has the rules."""
    if suffixes is None:
        return hosts.select("*", registered(F.col("host")).alias("_r")).select(*hosts.columns, "_r.*")
    rules = suffixes.select(lower_ascii(F.trim(F.col(suffixes.columns[0]))).alias("_rule")).where("_rule <> ''").distinct()
    deepest = rules.agg(F.max(F.size(F.split("_rule", r"\.")))).first()[0] or 1  # one number
    labels = F.split("host", r"\.")
    size = F.size("_labels")
    tail = lambda n: F.array_join(F.slice("_labels", size - n + 1, n), ".")
    taken = hosts.select("host").withColumn("_labels", labels).withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(deepest + 1)))))
    tries = taken.select("host", "_n", F.explode(F.array(tail(F.col("_n")), F.concat(F.lit("!"), tail(F.col("_n"))), F.when(F.col("_n") > 1, F.concat(F.lit("*."), tail(F.col("_n") - 1))))).alias("_rule")).where("_rule is not null")
    fits = tries.join(rules, "_rule").groupBy("host").agg(F.max_by(F.struct("_n", F.col("_rule").startswith("!").alias("_but")), F.struct(F.col("_rule").startswith("!"), "_n")).alias("_best"))
    n = F.when(F.col("_best._but"), F.col("_best._n") - 1).otherwise(F.coalesce("_best._n", F.lit(1)))
    found = hosts.join(fits, "host", "left").withColumn("_labels", labels).withColumn("_n", n)
    return found.select(*hosts.columns, tail(F.col("_n")).alias("suffix"), tail(F.least(F.col("_n") + 1, size)).alias("domain"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of the verdict and the text of the longest rule (verdict, host, path) that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of_host, of_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of_host + of_path).alias("rule"))).otherwise(out)
    return out


def _prior_weight(units: DataFrame) -> float:
    """The weight (in outcomes) of the parent's rate, by moments over units with n outcomes, bad of them, and the parent's rate."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), 2))
    noise = F.sum(F.col("above") * (1 - F.col("above")))
    between = (spread - noise) / F.greatest(F.sum("n") - F.count("*"), F.lit(1))
    mean = F.sum(F.col("n") * F.col("above") * (1 - F.col("above"))) / F.sum("n")
    weight = F.when(between > 0, F.least(F.greatest(mean / between - 1, F.lit(1.0)), F.lit(1e4))).otherwise(F.lit(1e4))
    return units.where("n > 0").agg(F.coalesce(weight, F.lit(1e4))).first()[0]  # one number


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n_rows, n, bad, rate and deviation of the posterior, from host, bad (0, 1, or null if not labelled) and n_rows of pages. One row for each host."""
    hosts = outcomes.groupBy("host").agg(F.sum("n_rows").alias("n_rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(with_domains(hosts, suffixes), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()  # two numbers
    whole = bad / n if n else 0.0

    def shrunk(units: DataFrame) -> DataFrame:
        weight = F.lit(_prior_weight(units))
        return units.withColumn("weight", weight).withColumn("rate", (F.col("bad") + weight * F.col("above")) / (F.col("n") + weight))

    def below(units: DataFrame, parents: DataFrame, by: str) -> DataFrame:
        """units with the rate of their parent without them."""
        joined = units.join(parents.select(by, *[F.col(c).alias(f"_{c}") for c in ("n", "bad", "above", "weight")]), by)
        rest = F.col("_bad") - F.col("bad") + F.col("_weight") * F.col("_above")
        return joined.withColumn("above", rest / (F.col("_n") - F.col("n") + F.col("_weight"))).drop("_n", "_bad", "_above", "_weight")

    suffix_rates = shrunk(suffixes.withColumn("above", (F.lit(float(bad or 0)) - F.col("bad") + whole) / (F.lit(float(n or 0)) - F.col("n") + 1)))
    domain_rates = shrunk(below(domains, suffix_rates, "suffix"))
    host_rates = shrunk(below(hosts, domain_rates, "domain"))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    return host_rates.select("host", "n_rows", "n", "bad", "rate", deviation.alias("deviation"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", page_id: str = "page_id", label_id: str = "doc_id", bad: Column | None = None, limit: float = 0.5, bound: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict, and the host's n, bad, rate and lower bound.

    bad: a condition over the labels' columns; by default a toxic page or one of low quality. A host without labels has
    its domain's rate."""
    out = ("host", "path", "rule", "verdict", "n_labelled", "n_bad", "bad_rate", "bad_lower")
    bad = bad if bad is not None else (F.col("toxic") == 1) | (F.col("quality") == 0)
    known = labels.select(F.col(label_id).alias("_page"), bad.alias("_bad")).where("_page is not null and _bad is not null")
    known = known.groupBy("_page").agg(F.max(F.col("_bad").cast("int")).alias("bad"))
    seen = pages.select(F.col(page_id).alias("_page"), host_of(F.col(url)).alias("host")).groupBy("_page", "host").agg(F.count("*").alias("n_rows"))
    # a page without an id has no label, and doesn't wait for one
    met = seen.where("_page is not null").join(known, "_page", "left").select("host", "bad", "n_rows")
    met = met.unionByName(seen.where("_page is null").select("host", F.lit(None).cast("int").alias("bad"), "n_rows"))
    hosts = written(reputations(met, suffixes), "rates")
    counts = hosts.select("host", F.col("n_rows").alias("_n"))
    lower = F.greatest(F.col("rate") - bound * F.col("deviation"), F.lit(0.0))
    rates = hosts.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.col("rate").alias("bad_rate"), lower.alias("bad_lower"))
    put, back = aside(pages, out)
    judged = pages.select(*put, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = spread_join(judged, rates, ["host"], counts, ["path", f"_u{pages.columns.index(page_id)}_"], "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_lower") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*back, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "n_bad", "bad_rate", "bad_lower")
