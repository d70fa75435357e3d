"""URL rules and empirical-Bayes host reputation, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second-level labels under which a country suffix registers names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LEVELS = ("suffix", "domain", "host")
TINY = 1e-6


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three below a suffix such as ``co.uk``."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    second = "|".join(SECOND_LEVEL)
    return F.regexp_replace(bare, rf"^.*?((?:[^.]+\.(?:{second})\.[^.]{{2}})|(?:[^.]+\.[^.]+))$", "$1")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: int | None = None) -> Column:
    """The longest fitting rule as text, or with ``field=0`` its verdict; null where none fits.

    ``rules`` is a short list of (verdict, host, path) given by the caller. Among rules of the same
    length the first in alphabetical order wins.
    """
    chosen = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.lit(verdict if field == 0 else rule_host + rule_path)).otherwise(chosen)
    return chosen


def _spread(groups: DataFrame, k: str, n: str, parent: str) -> DataFrame:
    """One row: the strength of the prior that groups of one level share, by moments.

    With q = parent * (1 - parent) and correlation r, the mean of n * (k / n - parent)**2 is
    q * (1 + (n - 1) * r); the sums over all groups give r, and the strength is 1 / r - 1.
    """
    q = F.col(parent) * (1 - F.col(parent))
    off = F.col(k) / F.col(n) - F.col(parent)
    sums = groups.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * off * off).alias("s"), F.sum(q).alias("q"), F.sum(q * (F.col(n) - 1)).alias("d"),
    )
    r = F.coalesce(F.when(F.col("d") > 0, (F.col("s") - F.col("q")) / F.col("d")), F.lit(TINY))
    r = F.least(F.greatest(r, F.lit(TINY)), F.lit(1 - TINY))
    return sums.select((1 / r - 1).alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior share of good pages for each host: host, good, labelled, mean, deviation.

    ``outcomes`` has host and outcome (1 good, 0 bad, null not labelled), one row per page. Suffixes
    are shrunk towards the share of all pages, registered domains towards their suffix, hosts towards
    their domain, each by a beta-binomial prior whose strength is estimated from the spread of that
    level. A host without labels gets the estimate of its domain. Counts combine before they are
    shuffled; only one-row tables are broadcast.
    """
    hosts = outcomes.groupBy("host").agg(
        F.sum(F.when(F.col("outcome") == 1, 1).otherwise(0)).alias("good"), F.count("outcome").alias("labelled"),
    )
    # written once: each level is read for its sums, for its spread and for its means
    hosts = cut(hosts.withColumn("domain", registered_domain(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("good").alias("dk"), F.sum("labelled").alias("dn"))
    domains = cut(domains.withColumn("suffix", F.regexp_replace("domain", r"^[^.]*\.", "")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("dk").alias("sk"), F.sum("dn").alias("sn"))
    # half a good and half a bad page keep the share off 0 and 1, also where nothing is labelled
    total = suffixes.agg(((F.coalesce(F.sum("sk"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("sn"), F.lit(0)) + 1.0)).alias("top"))
    suffixes = cut(suffixes.crossJoin(F.broadcast(total)), "suffixes")
    suffixes = suffixes.crossJoin(F.broadcast(_spread(suffixes, "sk", "sn", "top"))).select(
        "suffix", ((F.col("sk") + F.col("strength") * F.col("top")) / (F.col("sn") + F.col("strength"))).alias("s_mean"),
    )
    domains = cut(domains.join(suffixes, "suffix"), "domains")
    domains = domains.crossJoin(F.broadcast(_spread(domains, "dk", "dn", "s_mean"))).select(
        "domain", ((F.col("dk") + F.col("strength") * F.col("s_mean")) / (F.col("dn") + F.col("strength"))).alias("d_mean"),
    )
    hosts = cut(hosts.join(domains, "domain"), "hosts")
    hosts = hosts.crossJoin(F.broadcast(_spread(hosts, "good", "labelled", "d_mean")))
    a = F.col("good") + F.col("strength") * F.col("d_mean")
    n = F.col("labelled") + F.col("strength")
    return hosts.select("host", "good", "labelled", (a / n).alias("mean"), F.sqrt(a * (n - a) / (n * n * (n + 1))).alias("deviation"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    label_id: str = "page_id", outcome_col: str = "outcome", least: float = 0.5, z: float = 1.645,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mean, bound.

    A rule decides where one fits. Elsewhere a page is blocked if the upper posterior bound of its
    host's share of good pages, ``mean + z * deviation``, is below ``least``: a host goes only when
    its labels make it credibly bad, and an unknown host is judged by its domain and suffix.

    Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
    as the host with the empty name; a page labelled several times counts as bad if any label says
    so; a null label or a label without a page counts nowhere; repeated pages give repeated rows; an
    empty table gives no rows; further columns of either table are not looked at.
    """
    page = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    marks = labels.select(F.col(label_id).alias("id"), F.col(outcome_col).cast("int").alias("outcome"))
    marks = marks.filter("id is not null and outcome is not null").groupBy("id").agg(F.min("outcome").alias("outcome"))
    reputation = host_reputation(page.join(marks, "id", "left").select("host", "outcome"))
    judged = page.join(reputation, "host")
    bound = F.least(F.col("mean") + z * F.col("deviation"), F.lit(1.0))
    by_rule = rule_for(F.col("host"), F.col("path"), rules, 0)
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(by_rule, F.when(bound < least, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mean", bound.alias("bound"),
    )
