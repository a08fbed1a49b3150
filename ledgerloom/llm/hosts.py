"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages (good or not) are counted for hosts, their registered domains and their suffixes. The good
rate of each is shrunk through beta-binomial priors from the top down: a suffix towards the rate of all pages, a domain
towards its suffix, a host towards its domain. How hard each level shrinks is fitted to the counts themselves, by the
moments of the beta-binomial distribution around the parents' means. A page is let through if the lower bound of its
host's posterior good rate reaches `LEAST`; a host without outcomes has its domain's rate, and so on upwards. Given
rules on host and path come first, the longest that fits.

Counting is a partial aggregation, so a hot host costs no task more than its groups. Hot hosts, a thousand at most, are
sent to the pages; the rest of the host table, which grows with the data, is joined by host.

A null url, or one without `://`, has an empty host and path, and is judged like any host. Rows that repeat a page_id are
judged each; a repeated page counts once among outcomes of its host, its labels added up. Without any outcome all
pages are let through. Empty tables give empty results. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, table

Z = 1.645  # one-sided 95 % of the normal distribution
LEAST = 0.5
HOT = 1000  # a host of more than one page in so many is hot
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Second-level labels under which names are registered in many countries.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
LEVELS = ("suffix", "domain", "host")
WEAKEST, STRONGEST = 1e-4, 0.99  # bounds of the fitted correlation within a group


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lowered, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_levels(df: DataFrame) -> DataFrame:
    """`df` with domain and suffix of its host: a suffix has two labels in the form co.uk, else one."""
    labels = F.split("host", r"\.")
    two = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.lit(-2)).isin(*SECOND)
    held = df.withColumn("_labels", labels).withColumn("_n", F.when(F.size(labels) < 2, 1).otherwise(F.when(two, 2).otherwise(1)))
    last = lambda n: F.array_join(F.slice("_labels", F.greatest(F.size("_labels") - n + 1, F.lit(1)), n), ".")
    return held.withColumns({"suffix": last(F.col("_n")), "domain": last(F.col("_n") + 1)}).drop("_labels", "_n")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; both null where none does."""
    name = says = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        says = F.when(fits, verdict).otherwise(says)
    return name, says


def _correlation(counts: DataFrame) -> float:
    """Of outcomes within a group, around the mean its parent gives: 1 / (prior strength + 1)."""
    variance = F.col("mean") * (1 - F.col("mean"))
    found = counts.agg(F.sum(F.pow(F.col("good") - F.col("n") * F.col("mean"), F.lit(2)) - F.col("n") * variance),
                       F.sum(F.col("n") * (F.col("n") - 1) * variance)).first()
    rho = found[0] / found[1] if found[1] else WEAKEST
    return min(max(rho, WEAKEST), STRONGEST)


def reputations(outcomes: DataFrame) -> tuple[dict[str, DataFrame], dict[str, float], float | None]:
    """outcomes: host, n, good. By level the posterior means (level, mean; hosts also n), by level the strength of the
    prior, and the rate of all outcomes."""
    counted = stored(with_levels(outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))), "hosts")
    total = counted.agg(F.sum("n"), F.sum("good")).first()
    if not total[0]:
        return {}, {}, None
    rate, above, strengths, means = total[1] / total[0], None, {}, {}
    for level in LEVELS:
        keys = list(dict.fromkeys([level, *([above] if above else [])]))
        own = counted.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
        if above:
            parents = means[above].select(F.col(above), F.col("posterior").alias("mean"))
            own = own.join(parents, above)
        else:
            own = own.withColumn("mean", F.lit(rate))
        strength = 1 / _correlation(own) - 1
        strengths[level] = strength
        means[level] = own.withColumn("posterior", (F.col("good") + strength * F.col("mean")) / (F.col("n") + strength))
        above = level
    return means, strengths, rate


def bound(mean: Column, weight: Column, z: float = Z) -> Column:
    """Lower bound of a beta posterior of that mean and weight (its two parameters added), by its first two moments."""
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (weight + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's outcomes, rate and bound. outcomes: page_id, n, good."""
    host, path = url_parts(F.col("url"))
    rows = (pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
            .select("page_id", host.alias("host"), path.alias("path")))
    labelled = (outcomes.groupBy("page_id").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
                .join(rows.select("page_id", "host").distinct(), "page_id"))
    means, strengths, rate = reputations(labelled)
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    if rate is None:
        return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(says, F.lit("allow")).alias("verdict"),
                           F.lit(0).cast("long").alias("n_outcomes"), F.lit(None).cast("double").alias("rate"),
                           F.lit(None).cast("double").alias("bound"))
    sizes = stored(rows.groupBy("host").agg(F.count("*").alias("pages")), "host-sizes")
    hosts = with_levels(sizes)
    for level in LEVELS:
        hosts = hosts.join(means[level].select(level, F.col("posterior").alias(f"{level}_mean"),
                                               F.col("n").alias(f"{level}_n")), level, "left")
    n = F.coalesce(F.col("host_n"), F.lit(0.0))
    mean = F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(rate))
    hosts = stored(hosts.select("host", "pages", n.cast("long").alias("n_outcomes"), mean.alias("rate"),
                                bound(mean, n + strengths["host"]).alias("bound")), "host-bounds")
    # hosts of a thousandth of all pages are a thousand at most: they go to the pages, all other pages go to their hosts
    every = sizes.agg(F.sum("pages")).first()[0]
    hot = F.broadcast(hosts.filter(F.col("pages") * HOT >= every))
    met = rows.join(hot, "host").unionByName(rows.join(hot.select("host"), "host", "left_anti").join(hosts, "host"))
    judged = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return met.select("page_id", "host", "path", name.alias("rule"),
                                           F.coalesce(says, judged).alias("verdict"), "n_outcomes", "rate", "bound")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; its labels are those of the same number, good if of quality and not toxic."""
    labels = table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")
    outcomes = (labels.filter("quality IS NOT NULL AND toxic IS NOT NULL")
                .select(F.col("doc_id").alias("page_id"), F.lit(1).cast("long").alias("n"), good.alias("good")))
    found = judge(table(spark, sf_dir, "pages"), outcomes)
    return found.withColumns({"rate": F.round("rate", 4), "bound": F.round("bound", 4)})


def _oracle() -> str:
    second = ", ".join(f"'{x}'" for x in SECOND)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

    def level(name: str, above: str | None) -> str:
        keys = f"c.{name}" + (f", c.{above}" if above else "")
        mean = f"p.posterior" if above else "(SELECT sum(good) / sum(n) FROM counted)"
        join = f" JOIN {above}_means p ON p.{above} = c.{above}" if above else ""
        group = keys + (", p.posterior" if above else "")
        return f"""
{name}_counts AS (
    SELECT {keys}, CAST(sum(c.n) AS DOUBLE) AS n, CAST(sum(c.good) AS DOUBLE) AS good, {mean} AS mean
    FROM counted c{join} GROUP BY {group}),
{name}_strength AS (
    SELECT 1 / least(greatest(CASE WHEN d <> 0 THEN s / d ELSE {WEAKEST} END, {WEAKEST}), {STRONGEST}) - 1 AS k
    FROM (SELECT sum(pow(good - n * mean, 2) - n * mean * (1 - mean)) AS s, sum(n * (n - 1) * mean * (1 - mean)) AS d
          FROM {name}_counts)),
{name}_means AS (
    SELECT *, (good + k * mean) / (n + k) AS posterior FROM {name}_counts, {name}_strength)"""

    return f"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hosts AS (
    SELECT host, array_to_string(labels[-(k):], '.') AS suffix, array_to_string(labels[-(k + 1):], '.') AS domain
    FROM (SELECT host, labels, CASE WHEN len(labels) > 2 AND length(labels[-1]) = 2 AND labels[-2] IN ({second}) THEN 2 ELSE 1 END AS k
          FROM (SELECT host, string_split(host, '.') AS labels FROM (SELECT DISTINCT host FROM named)))),
outcomes AS (
    SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS good
    FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
counted AS (
    SELECT host, domain, suffix, sum(n) AS n, sum(good) AS good
    FROM outcomes JOIN (SELECT DISTINCT page_id, host FROM named) USING (page_id) JOIN hosts USING (host) GROUP BY ALL),
{level("suffix", None)},{level("domain", "suffix")},{level("host", "domain")},
rated AS (
    SELECT h.host, CAST(coalesce(m.n, 0) AS BIGINT) AS n_outcomes,
           coalesce(m.posterior, d.posterior, s.posterior, (SELECT sum(good) / sum(n) FROM counted)) AS rate
    FROM hosts h LEFT JOIN host_means m ON m.host = h.host LEFT JOIN domain_means d ON d.domain = h.domain
    LEFT JOIN suffix_means s ON s.suffix = h.suffix),
bounded AS (
    SELECT host, n_outcomes, rate, greatest(0.0, rate - {Z} * sqrt(rate * (1 - rate) / (n_outcomes + k + 1))) AS bound
    FROM rated, host_strength),
rules(rule_host, rule_path, says) AS (VALUES {rules}),
fitted AS (
    SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(says, length(rule_host || rule_path)) AS says
    FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY ALL)
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.says, CASE WHEN b.bound >= {LEAST} THEN 'allow' ELSE 'block' END) AS verdict,
       b.n_outcomes, round(b.rate, 4) AS rate, round(b.bound, 4) AS bound
FROM named n JOIN bounded b USING (host) LEFT JOIN fitted f ON f.page_id = n.page_id AND f.host = n.host AND f.path = n.path"""


QUERIES = {"op5_host_reputation": op5_host_reputation}
ORACLE = {"op5_host_reputation": _oracle()}
