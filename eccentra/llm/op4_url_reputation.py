"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted per host, registered domain
and suffix. A level's good share is shrunk towards the level above it:
suffixes towards the share of all labelled pages, domains towards their
suffix's posterior mean, hosts towards their domain's. The strength of each
beta prior is fitted by moments: the spread of the shares at a level beyond what
binomial noise explains. A host is allowed if the lower bound of its
posterior, mean - z * deviation, reaches ``least``; a host without labelled
pages is judged by its domain's posterior, then its suffix's, then the overall one.

Rules come first: the longest (host, path) rule that fits decides. Tables of
counts have a row per host and are summed before the shuffle; they are joined
to the pages as Spark sees fit. The labels are rows (page_id, good).

Null or malformed urls (no ``://``) have an empty host and path: no rule fits,
the overall posterior judges. A page labelled twice counts once, with its
worst label. Null ids and labels count nothing. Without any label the overall
mean is ``start`` and every page not ruled is judged by it. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eccentra.llm.common import keep, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Suffixes of two labels under which names are registered; an argument of the operator.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.in", "co.za", "com.mx", "com.cn")
Z, LEAST, START = 1.0, 0.8, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        out = F.when(((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest)), F.lit(text)).otherwise(out)
    return out


def levels(host: Column, two_label=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host; a port or user name is left aside."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    long = two.isin(*two_label)
    return F.when(long, two).otherwise(F.substring_index(name, ".", -1)), F.when(long, three).otherwise(two)


def shrink(counts: DataFrame, above: DataFrame | float, up: str = "") -> DataFrame:
    """Posterior (a, b) of every row of ``counts`` (key, up, n, good) under a prior around the mean of ``above`` (key, a, b), or around one mean.

    Method of moments over the rows with two pages at least: v = the mean of
    ((share - prior mean)^2 - m(1-m)/n), strength = m(1-m) / v - 1, held between 1 and 1000.
    """
    if isinstance(above, float):
        j = counts.withColumn("m", F.lit(above))
    else:
        j = counts.join(above.select(F.col("key").alias(up), (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), up)
    noise = F.col("m") * (1 - F.col("m"))
    share = F.col("good") / F.col("n")
    fit = j.filter("n >= 2").agg(F.avg((share - F.col("m")) * (share - F.col("m")) - noise / F.col("n")).alias("v"), F.avg(noise).alias("q")).first()
    v, q = fit["v"], fit["q"]
    strength = 1000.0 if v is None or v <= 0 else min(max(q / v - 1, 1.0), 1000.0)
    return j.select("key", (F.col("m") * strength + F.col("good")).alias("a"), ((1 - F.col("m")) * strength + F.col("n") - F.col("good")).alias("b"))


def reputation(labelled: DataFrame, two_label=TWO_LABEL_SUFFIXES, start: float = START):
    """Posteriors (key, a, b) per host, domain and suffix, and the overall (a, b), from rows (host, good)."""
    suffix, domain = levels(F.col("host"), two_label)
    # one small table; all further sums are over its rows
    hosts = keep(labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good")).select(
        F.col("host").alias("key"), domain.alias("domain"), suffix.alias("suffix"), "n", "good"), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"] or 0, total["good"] or 0
    a, b = good + 2 * start, n - good + 2 * (1 - start)
    suffixes = hosts.groupBy(F.col("suffix").alias("key")).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = hosts.groupBy(F.col("domain").alias("key"), "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_suffix = shrink(suffixes, float(a / (a + b)))
    by_domain = shrink(domains, by_suffix, "suffix")
    by_host = shrink(hosts, by_domain, "domain")
    return by_host, by_domain, by_suffix, (float(a), float(b))


def bound(a: Column, b: Column, z: float) -> Column:
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, least: float = LEAST, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for pages (page_id, url) under outcomes (page_id, good)."""
    h, p = host_and_path(F.col("url"))
    own = pages.select("page_id", h.alias("host"), p.alias("path"))
    marks = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").cast("long").alias("good"))
    seen = own.select("page_id", "host").distinct().join(marks, "page_id").select("host", "good")
    by_host, by_domain, by_suffix, (a, b) = reputation(seen, two_label)
    suffix, domain = levels(F.col("host"), two_label)

    def bounds(t: DataFrame, key: str) -> DataFrame:
        return t.select(F.col("key").alias(key), bound(F.col("a"), F.col("b"), z).alias(f"{key}_bound"))

    # hosts are judged once each, whatever their number of pages
    names = own.select("host").distinct().withColumn("suffix", suffix).withColumn("domain", domain)
    names = (names.join(bounds(by_host, "host"), "host", "left").join(bounds(by_domain, "domain"), "domain", "left")
             .join(bounds(by_suffix, "suffix"), "suffix", "left")
             .select("host", F.coalesce("host_bound", "domain_bound", "suffix_bound", bound(F.lit(a), F.lit(b), z)).alias("bound")))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    ruled = F.lit(None).cast("string")
    for text, verdict in rules:
        ruled = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(ruled)
    return own.join(names, "host").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("bound") >= least, "allow").otherwise("block")).alias("verdict"), "bound")


def query(spark, sf_dir: str) -> DataFrame:
    """Labelled outcomes: ``labels.quality`` of the row with the page's number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).drop("bound")


ORACLE = f"""
WITH own AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM own),
page AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') AS name FROM page),
parts AS (SELECT *, str_split(name, '.') AS p FROM named),
level AS (SELECT page_id, host, path,
  CASE WHEN array_to_string(p[-2:], '.') IN ({", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
  CASE WHEN array_to_string(p[-2:], '.') IN ({", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM parts),
marks AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
seen AS (SELECT host, suffix, domain, good FROM (SELECT DISTINCT page_id, host, suffix, domain FROM level) JOIN marks USING (page_id)),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM seen GROUP BY ALL),
t AS (SELECT coalesce(sum(good), 0) + {2 * START} AS a, coalesce(sum(n) - sum(good), 0) + {2 * (1 - START)} AS b FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(t.a / (t.a + t.b)) AS m FROM h, t GROUP BY 1),
sk AS (SELECT CASE WHEN v IS NULL OR v <= 0 THEN 1000.0 ELSE least(greatest(q / v - 1, 1.0), 1000.0) END AS k FROM (SELECT avg((good / n - m) ** 2 - m * (1 - m) / n) AS v, avg(m * (1 - m)) AS q FROM s WHERE n >= 2)),
sp AS (SELECT suffix, m * k + good AS a, (1 - m) * k + n - good AS b FROM s, sk),
d AS (SELECT h.domain, any_value(sp.a / (sp.a + sp.b)) AS m, sum(n) AS n, sum(good) AS good FROM h JOIN sp USING (suffix) GROUP BY 1),
dk AS (SELECT CASE WHEN v IS NULL OR v <= 0 THEN 1000.0 ELSE least(greatest(q / v - 1, 1.0), 1000.0) END AS k FROM (SELECT avg((good / n - m) ** 2 - m * (1 - m) / n) AS v, avg(m * (1 - m)) AS q FROM d WHERE n >= 2)),
dp AS (SELECT domain, m * k + good AS a, (1 - m) * k + n - good AS b FROM d, dk),
hm AS (SELECT host, n, good, a / (a + b) AS m FROM h JOIN dp USING (domain)),
hk AS (SELECT CASE WHEN v IS NULL OR v <= 0 THEN 1000.0 ELSE least(greatest(q / v - 1, 1.0), 1000.0) END AS k FROM (SELECT avg((good / n - m) ** 2 - m * (1 - m) / n) AS v, avg(m * (1 - m)) AS q FROM hm WHERE n >= 2)),
hp AS (SELECT host, m * k + good AS a, (1 - m) * k + n - good AS b FROM hm, hk),
post AS (SELECT level.page_id, level.host, path, coalesce(hp.a, dp.a, sp.a, t.a) AS a, coalesce(hp.b, dp.b, sp.b, t.b) AS b
  FROM level LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix), t),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM post)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) >= {LEAST} THEN 'allow' ELSE 'block' END AS verdict FROM ruled
"""
