"""Empirical-Bayes host reputation with DataFrame functions alone.

Labelled page outcomes are counted for each host; a page's label is that of the number that its path ends with. A
beta-binomial model at each level (suffix, registered domain, host) takes the posterior mean of the level above as its
prior mean; how strong a prior is comes from how much the rates of that level differ beyond chance (analysis of variance
of binary outcomes). A host is blocked where the lower bound of its posterior for a bad page is above TIMES the share
of bad pages among all labelled ones: the limit is calibrated on the labels. Rules for hosts and paths come first. Hosts
whose rates differ by chance alone are shrunk together, and none of them is blocked.

Pages are grouped by host once, and hosts go to a table that the three levels are worked out from; a host with a third
of all pages is one row there, after counting in every task.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and takes the verdict of
the prior of empty suffixes. Pages with the same id are judged row by row. A label whose id fits no page, a null id or
a null label counts nowhere; of repeated labels of an id the worst counts. With no labelled page at all every posterior
is that of one bad and one good page, and no host is blocked. Other columns of the tables may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_out

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host is blocked where its chance of a bad page is above TIMES the overall share with Z standard deviations to spare.
TIMES, Z = 1.25, 1.645
#: Suffixes of two labels under which names are registered.
SECOND_LEVEL = (
    "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk",
    "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)
#: The weakest and the strongest correlation of outcomes within a group, and what is assumed where it can't be worked out.
LEAST_RHO, MOST_RHO, SOME_RHO = 0.001, 0.5, 0.1


def host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, host, path, labelled_id, domain, suffix of every row of pages."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    cut = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    cut = cut.select("page_id", "rest", F.regexp_extract("rest", "^[^/?#]*", 0).alias("raw"))
    path = F.regexp_extract(F.substring("rest", F.length("raw") + 1, F.length("rest")), "^[^?#]*", 0)
    page = cut.select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), path.alias("path"))
    number = F.nullif(F.regexp_extract("path", "^/[^/]*/([0-9]+)", 1), F.lit(""))
    two = F.substring_index("host", ".", -2)
    long_suffix = two.isin(*SECOND_LEVEL)
    return page.select(
        "page_id", "host", "path", number.try_cast("bigint").alias("labelled_id"),
        F.when(long_suffix, F.substring_index("host", ".", -3)).otherwise(two).alias("domain"),
        F.when(long_suffix, two).otherwise(F.substring_index("host", ".", -1)).alias("suffix"),
    )


def _ruled(rules) -> tuple[Column, Column]:
    """(verdict, name) of the longest rule that fits, or null."""
    verdict = name = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
    none = F.lit(None).cast("string")
    return (none, none) if verdict is None else (verdict, name)


def _strength(groups: DataFrame) -> float:
    """How many outcomes the prior of groups (n, b) counts for; from four sums."""
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    k, total, bad, squares, between = groups.where("n > 0").agg(F.count("*"), F.sum(n), F.sum(b), F.sum(n * n), F.sum(b * b / n)).first()
    rho = SOME_RHO
    if k > 1 and total > k:
        # the sum of n (p - mean)^2 is sum b^2/n - B^2/N, so that one pass over the groups is enough
        among, within, size = (between - bad * bad / total) / (k - 1), (bad - between) / (total - k), (total - squares / total) / (k - 1)
        spread = among + (size - 1) * within
        rho = (among - within) / spread if spread > 0 else 0.0
    return 1.0 / max(LEAST_RHO, min(MOST_RHO, rho)) - 1.0


def host_reputation(page: DataFrame, labels: DataFrame, times: float = TIMES, z: float = Z) -> DataFrame:
    """host, n and b (labelled and bad pages), mean, bound, bad (above the limit) of every host of host_and_path's rows."""
    worst = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    outcome = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(worst.alias("outcome"))
    seen = page.join(outcome, page.labelled_id == outcome.doc_id, "left")
    hosts = seen.groupBy("host", "domain", "suffix").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("b"))
    hosts = write_out(hosts, "hosts")
    domains = write_out(hosts.groupBy("domain").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("b").alias("b")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    all_n, all_b = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    overall = (all_b + 1.0) / (all_n + 2.0)
    shrunk = lambda prior, strength: (F.col("b") + strength * prior) / (F.col("n") + strength)
    of_suffix = suffixes.select("suffix", shrunk(F.lit(overall), _strength(suffixes)).alias("prior"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", shrunk(F.col("prior"), _strength(domains)).alias("prior"))
    strength = _strength(hosts)
    judged = hosts.join(of_domain, "domain").select("host", "n", "b", shrunk(F.col("prior"), strength).alias("mean"))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    judged = judged.withColumn("bound", bound)
    return write_out(judged.withColumn("bad", (F.col("n") >= 0) & F.lit(all_n > 0) & (F.col("bound") > times * overall)), "reputation")


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, times: float = TIMES, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled, host_bad for every row of pages."""
    page = host_and_path(pages.select("page_id", "url"))
    hosts = host_reputation(page, labels.select("doc_id", "quality", "toxic"), times, z)
    verdict, rule = _ruled(rules)
    judged = page.join(hosts, "host")
    by_method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"),
        F.col("n").cast("bigint").alias("host_labelled"), F.col("b").cast("bigint").alias("host_bad"),
    )


def sql() -> str:
    """The same in DuckDB's SQL over pages and labels, written on its own: no part of it is shared with the code above.

    Rules are rows here and the longest of those that fit is taken; rates of groups are compared with their mean.
    """
    levels = []
    for level, above, source in (("suffix", None, "domain_group"), ("domain", "suffix", "host_group"), ("host", "domain", "counted")):
        keep = f", any_value({above}) as {above}" if above else ""
        more = ", any_value(suffix) as suffix" if level == "host" else ""
        levels.append(f"{level}_group as (select {level}{keep}{more}, sum(n) as n, sum(b) as b from {source} group by {level})")
    spread = []
    for level in ("suffix", "domain", "host"):
        spread.append(f"""{level}_prior as (
  select case when k > 1 and total > k then greatest(0.001, least(0.5, case when a + (s - 1) * w > 0 then (a - w) / (a + (s - 1) * w) else 0 end)) else 0.1 end as rho
  from (select k, total, dev / (k - 1) as a, inner_dev / (total - k) as w, (total - squares / total) / (k - 1) as s from (
    select count(*)::double as k, sum(n)::double as total, sum(n::double * n) as squares, sum(n * pow(b / n - rate, 2)) as dev, sum(b * (1 - b / n)) as inner_dev
    from {level}_group, (select sum(b)::double / sum(n) as rate from {level}_group) where n > 0)))""")
    return f"""
with rules(kind, rule_host, rule_path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
numbered as (select row_number() over () as line, page_id, url from pages),
split as (
  select line, page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') as raw, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from numbered),
page as (
  select line, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path,
         try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') as bigint) as doc from split),
parts as (select distinct host, string_split(host, '.') as p from page),
named as (
  select host, p[-2] || '.' || p[-1] in ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) as deep, p from parts),
places as (
  select host, array_to_string(list_slice(p, -(case when deep then 3 else 2 end), -1), '.') as domain, case when deep then p[-2] || '.' || p[-1] else p[-1] end as suffix from named),
worst as (
  select doc_id, max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) as bad from labels where doc_id is not null and coalesce(quality, toxic) is not null group by doc_id),
counted as (
  select host, any_value(domain) as domain, any_value(suffix) as suffix, count(bad)::bigint as n, coalesce(sum(bad), 0)::bigint as b
  from page join places using (host) left join worst on doc = doc_id group by host),
{levels[2]}, {levels[1]}, {levels[0]}, {", ".join(spread)},
overall as (select (sum(b) + 1.0) / (sum(n) + 2.0) as rate, sum(n) > 0 as any_labelled from suffix_group),
suffix_post as (select suffix, (b + (1 / rho - 1) * rate) / (n + 1 / rho - 1) as m from suffix_group, suffix_prior, overall),
domain_post as (select domain, (b + (1 / rho - 1) * m) / (n + 1 / rho - 1) as m from domain_group join suffix_post using (suffix), domain_prior),
host_post as (
  select h.host, h.n, h.b, (h.b + (1 / rho - 1) * m) / (h.n + 1 / rho - 1) as m, h.n + 1 / rho as weight from host_group h join domain_post using (domain), host_prior),
judged as (
  select host, n, b, case when any_labelled and m - 1.645 * sqrt(m * (1 - m) / weight) > 1.25 * rate then 'block' else 'allow' end as by_method from host_post, overall),
fitting as (
  select line, kind, rule_host || rule_path as rule,
         row_number() over (partition by line order by length(rule_host || rule_path) desc, rule_host, rule_path) as place
  from page join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, page.host, path, rule, coalesce(kind, by_method) as verdict, n::bigint as host_labelled, b::bigint as host_bad
from page join judged using (host) left join fitting on fitting.line = page.line and place = 1
"""
