"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Pages with a known outcome (good or not) are counted by host, registered domain and suffix.
Each level's rate is a beta-binomial posterior whose prior is the level above: suffixes under
the overall rate, domains under their suffix, hosts under their domain.  The prior's strength
at each level is found by moments: the less the rates of a level vary beyond chance, the more
a level trusts the one above.  A host is blocked if the upper bound of its posterior, its mean and
``DEVIATIONS`` standard deviations (the normal approximation of the beta quantile), is under
``LEAST``; hand-written rules come first.

All hosts are counted once, in one pass over the pages, and stored; everything else is small.

Defined results: a null url, or one without ``://``, has empty host and path and the empty
domain's rate; hosts without labels have their domain's rate, and so on up; with no labels at all the
rate is 1/2 under a prior of two pages.  A user name, a port and a last dot do not count for the domain;
an address (IPv4 in four numbers, IPv6 in brackets) is its own domain under the suffix ``address``.
Repeated pages are judged each, repeated outcomes counted each; null outcomes are no outcomes, and
null page ids have none.  An empty table gives an empty result; extra columns are ignored by ``judge``
and kept by ``allowed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, scratch

#: Standard deviations of the bound, and the rate of good pages below which a host is blocked.
DEVIATIONS, LEAST = 1.645, 0.5
#: Bounds of a prior's strength in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Public suffixes of two or three labels that are known besides the last label: common ones of the public
#: suffix list (fixed values); callers with the whole list pass it.
SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "net.uk", "nhs.uk", "sch.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "co.nz", "org.nz", "net.nz", "ac.nz", "govt.nz", "com.br", "net.br", "org.br", "gov.br", "edu.br", "co.in", "net.in", "org.in", "ac.in", "gov.in", "com.cn", "net.cn",
    "org.cn", "edu.cn", "gov.cn", "com.tw", "org.tw", "edu.tw", "com.hk", "org.hk", "edu.hk", "com.sg", "edu.sg", "com.my", "co.kr", "or.kr", "ac.kr", "go.kr", "com.mx",
    "org.mx", "com.ar", "org.ar", "com.co", "com.pe", "com.ve", "com.tr", "org.tr", "edu.tr", "gov.tr", "com.ua", "co.il", "org.il", "ac.il", "co.za", "org.za", "ac.za",
    "com.eg", "com.sa", "com.pk", "com.bd", "com.vn", "co.th", "ac.th", "co.id", "ac.id", "com.ph", "com.pl", "org.pl", "com.pt", "com.es", "com.gr", "co.at", "or.at",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "azurewebsites.net",
    "cloudfront.net", "s3.amazonaws.com", "readthedocs.io",
]
ADDRESS = "address"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[tuple[str, str]]) -> list[Rule]:
    """Rules from (verdict, "host/path")."""
    return [Rule(v, r[: r.index("/")], r[r.index("/") :]) for v, r in lines]


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = r"(?s)://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, after, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, after, 2), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user name, port and last dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[")


def suffix_of(name: Column, suffixes: list[str]) -> Column:
    """The longest known suffix of a bare host, else its last label."""
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    return F.when(is_address(name), ADDRESS).when(three.isin(suffixes), three).when(two.isin(suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffix: Column) -> Column:
    """The suffix and one label before it; a bare suffix is its own domain, and so is an address."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    domain = F.when(labels == 2, F.substring_index(name, ".", -2)).when(labels == 3, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -4))
    return F.when(is_address(name), name).otherwise(domain)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null.  The rules are part
    of the plan, so their number is the caller's and small."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(rates: DataFrame, k: str, n: str, prior: str) -> float:
    """A prior's strength by moments: with s its pages, the groups' squared deviations have the
    expectation p(1-p)/n * (n + s)/(1 + s); one row of sums comes to the driver."""
    p, m = F.col(prior), F.col(n)
    row = rates.filter(m > 0).agg(
        F.sum(m * F.pow(F.col(k) / m - p, 2)).alias("seen"),
        F.sum(p * (1 - p)).alias("chance"),
        F.sum(p * (1 - p) * m).alias("whole"),
    ).first()
    if not row.whole:
        return WEAKEST
    # seen = sum p(1-p)(n + s)/(1 + s), solved for s
    beyond = row.seen - row.chance
    return STRONGEST if beyond <= 0 else min(STRONGEST, max(WEAKEST, (row.whole - row.seen) / beyond))


def reputations(counted: DataFrame, deviations: float = DEVIATIONS, suffixes: list[str] | None = None) -> DataFrame:
    """(host, rate, upper) of every host of ``counted``, a stored table of a row a host (host, k good pages,
    n pages with an outcome, 0 where there are none)."""
    name = bare(F.col("host"))
    hosts = counted.withColumn("suffix", suffix_of(name, suffixes or SUFFIXES)).withColumn("domain", domain_of(name, F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("k").alias("dk"), F.sum("n").alias("dn"))
    above = domains.groupBy("suffix").agg(F.sum("dk").alias("sk"), F.sum("dn").alias("sn"))
    whole = above.agg(F.sum("sk").alias("k"), F.sum("sn").alias("n")).first()
    rate = ((whole.k or 0) + 1) / ((whole.n or 0) + 2)
    s0 = _strength(above.withColumn("p", F.lit(rate)), "sk", "sn", "p")
    above = above.select("suffix", ((F.col("sk") + s0 * rate) / (F.col("sn") + s0)).alias("sp"))
    domains = domains.join(above, "suffix")
    s1 = _strength(domains, "dk", "dn", "sp")
    domains = domains.select("suffix", "domain", ((F.col("dk") + s1 * F.col("sp")) / (F.col("dn") + s1)).alias("dp"))
    hosts = hosts.join(domains, ["suffix", "domain"])
    s2 = _strength(hosts, "k", "n", "dp")
    return hosts.select("host", *posterior(F.col("k"), F.col("n"), F.col("dp"), s2, deviations))


def posterior(k: Column, n: Column, prior: Column, strength: float, deviations: float) -> tuple[Column, Column]:
    """Mean and upper bound of the beta posterior of a rate, columns rate and upper."""
    a, b = k + strength * prior, n - k + strength * (1 - prior)
    mean = a / (a + b)
    return mean.alias("rate"), F.least(F.lit(1.0), mean + deviations * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))).alias("upper")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], least: float = LEAST, deviations: float = DEVIATIONS, suffixes: list[str] | None = None) -> DataFrame:
    """Every page of ``pages`` (page_id, url) with host, path, rule, verdict, rate and upper.
    ``outcomes`` has (page_id, good) with good 0, 1 or null."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select("page_id", F.col("good").cast("double").alias("good")).filter("good IS NOT NULL")
    counts = pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("k"), F.count("good").alias("n"))
    with scratch():
        counted = Stored(counts, "hosts").df
        hosts = Stored(reputations(counted, deviations, suffixes), "reputations").keep().df
    found = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("upper") < least, "block").otherwise("allow")
    return pages.join(hosts, "host").withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), F.round("rate", 6).alias("rate"), F.round("upper", 6).alias("upper")
    )


def allowed(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """The rows of ``pages`` that pass, with all their columns."""
    host, path = host_and_path(F.col("url"))
    judged = judge(pages, outcomes, rules, **options).filter("verdict = 'allow'").select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    return pages.join(judged, (host == F.col("_host")) & (path == F.col("_path")), "left_semi")
