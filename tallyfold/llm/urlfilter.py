"""URL filters with redirect equivalence: block decisions reach all aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import ascii_lower, join_counted, staged
from tallyfold.llm.components import connected_components
from tallyfold.operators.ranking import BROADCAST_ROWS

#: Parts over which a key is spread where the rules are too many to broadcast.
SALTS = 32
#: Query parameters that never change the page: fixed values.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|sid"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without it or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://" or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for URLs that lead to one page: no scheme, port 80 or 443, leading "www." or "m.", fragment, tracking
    parameter, index or ".html" ending, closing slash.  Null stays null; without "://" the url is its own spelling."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"(?s)^(?:www|m)\.(.+\..+)$", "$1")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail)).otherwise(url)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules ("allow" or "block", "host/path start") as the table (kind, rule) that :func:`rules_of` takes."""
    return spark.createDataFrame(rules, "kind string, rule string")


def rules_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, times, rule, own) of every distinct pair of ``host`` and ``path`` in ``urls``: the longest fitting rule and
    its kind, null without one; ``times`` counts the rows.

    A rule fits its host and all subdomains where the path starts with the rule's ("/" where it has none).  Of fitting rules of one length the last
    by kind and text wins.  Rules with a null or an unknown kind, or a null text, fit nothing; repeated rules count once.

    There may be any number of rules.  A host's suffixes, no longer than the longest host of a rule, find the rule hosts;
    the lengths of path that rules of this host ask for cut the path's starts; host and start then find the rule.  Hosts
    and pairs are distinct before they are joined.  Where the rules are few they are broadcast; where they are many, a
    suffix that a large part of all hosts has is spread over the tasks by a salt.
    """
    host = F.substring_index("rule", "/", 1)
    start = F.concat(F.lit("/"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 2)"))
    known = rules.where("kind in ('allow', 'block') and rule is not null").distinct()
    known = staged(known.select("kind", "rule", host.alias("rule_host"), start.alias("start"), F.length("rule").alias("_len")), "rules")
    count, longest = known.agg(F.count("*"), F.max(F.length("rule_host"))).first()
    places = known.groupBy("rule_host").agg(F.collect_set(F.length("start")).alias("lengths"))
    pairs = staged(urls.groupBy("host", "path").agg(F.count("*").alias("times")), "pairs")
    # suffixes at label ends, the whole host among them; a host longer than all rules' is cut first
    longest = longest or 0
    tail = F.right("host", F.lit(longest + 1))
    labels = F.split(tail, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # a cut host's first piece is no whole label
    ends = F.when(F.length("host") > longest + 1, F.slice(ends, 2, F.size(ends))).otherwise(ends)
    hosts = pairs.select("host").distinct().withColumn("rule_host", F.explode(F.array_distinct(ends)))
    found = _meet(hosts, places, ["rule_host"], count).select("host", "rule_host", "lengths")
    found = staged(found.groupBy("host").agg(F.collect_list(F.struct("rule_host", "lengths")).alias("places")), "hosts")
    asked = _meet(pairs, found, ["host"], found.count()).withColumn("_p", F.explode("places"))
    asked = asked.select("host", "path", "_p.rule_host", F.explode("_p.lengths").alias("_at")).where(F.length("path") >= F.col("_at"))
    asked = asked.withColumn("start", F.expr("left(path, _at)"))
    best = _meet(asked, known, ["rule_host", "start"], count).groupBy("host", "path").agg(F.max(F.struct("_len", "kind", "rule")).alias("_best"))
    return pairs.join(best, ["host", "path"], "left").select("host", "path", "times", "_best.rule", F.col("_best.kind").alias("own"))


def _meet(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Inner join; ``rows`` bounds the rows of ``right``, which is broadcast if they are few and else repeated per salt."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    return salted.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [*on, "_salt"]).drop("_salt")


def page_links(html: Column, url: Column) -> Column:
    """Absolute targets of a page's canonical links and immediate redirects (refresh), as written in its html."""
    low = F.lower(html)
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    links = F.filter(tags("link"), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"))
    targets = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    metas = F.filter(tags("meta"), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    jumps = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']?[0-9.]*\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)", 1))
    none = F.array().cast("array<string>")
    found = F.concat(F.when(F.contains(low, F.lit("canonical")), targets).otherwise(none), F.when(F.contains(low, F.lit("refresh")), jumps).otherwise(none))
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.transform(found, lambda t: F.when(t.rlike("^//"), F.concat(F.lit("http:"), t)).when(t.rlike("^/"), F.concat(origin, t)).otherwise(t))
    return F.filter(whole, lambda t: F.instr(t, "://") > 0)


def judge_urls(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_class) for every row of ``pages``; ``rules`` is a table (kind, rule) of any size.

    URLs are aliases if they have one canonical spelling, if a page of one names the other as its canonical link or
    redirects to it, or if ``redirects`` (src, dst) says so; classes are the connected components of these links.  A
    url's own rule decides.  Without one, an allow rule that fits any alias allows it (explicit allow goes first), else
    a block rule that fits any alias blocks it, else it is allowed.  ``alias_class`` is the smallest canonical spelling
    of the class.

    Null urls have empty host and path, no rule, no alias, and are allowed.  Null html has no links.  Repeated rows give
    repeated rows; an empty table gives an empty result, and without rules every url is allowed.  Decisions are summed
    per spelling before they are joined, and urls and spellings that many rows share are broadcast (see
    :func:`~tallyfold.llm.common.join_counted`), so a page that a third of all urls lead to costs one row per task.
    """
    url = F.col(url_col)
    links = page_links(F.col(html_col), url) if html_col else F.array().cast("array<string>")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("spelling"), links.alias("targets"))
    rows = staged(rows, "urls")
    edges = rows.select(F.col("spelling").alias("src"), F.explode("targets").alias("to")).select("src", canonical(F.col("to")).alias("dst"))
    targets = rows.select(F.explode("targets").alias("to"))
    if redirects is not None:
        pairs = redirects.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        edges = edges.union(pairs.select(canonical(F.col("a")), canonical(F.col("b"))))
        targets = targets.union(pairs.select("a")).union(pairs.select("b"))
    classes = connected_components(edges)
    # urls that some row carries or some link names, once each, with what the rules say of them
    named = targets.select(F.lit(False).alias("_row"), host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path"), canonical(F.col("to")).alias("spelling"))
    urls = rows.select(F.lit(True).alias("_row"), "host", "path", "spelling").union(named)
    urls = urls.groupBy("host", "path", "spelling").agg(F.sum(F.col("_row").cast("bigint")).alias("times"))
    urls = staged(urls, "urls")
    said = staged(rules_of(urls, rules).select("host", "path", "rule", "own"), "said")
    urls = staged(urls.join(said, ["host", "path"]), "said")
    allow, block = F.max(F.col("own") == "allow"), F.max(F.col("own") == "block")
    per = urls.where("spelling is not null").groupBy("spelling").agg(allow.alias("allowed"), block.alias("blocked"))
    per = per.join(classes, per["spelling"] == classes["node"], "left").select("spelling", F.coalesce("component", "spelling").alias("alias_class"), "allowed", "blocked")
    per = staged(per, "spellings")
    total = per.groupBy("alias_class").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"), F.count("*").alias("_members"))
    decided = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    total = staged(total.select("alias_class", decided.alias("by_class"), "_members"), "classes")
    per = join_counted(per, total, ["alias_class"], "_members").select("spelling", "alias_class", "by_class")
    verdict = F.coalesce("own", "by_class", F.lit("allow")).alias("verdict")
    judged = urls.where("times > 0").join(per, "spelling", "left")
    # a null spelling is a null url; the key of the last join must not be null
    judged = judged.select("host", "path", F.coalesce("spelling", F.lit("")).alias("_key"), F.col("spelling").isNull().alias("_none"), "times", "rule", verdict, "alias_class")
    judged = staged(judged, "judged")
    keyed = rows.select("page_id", "host", "path", F.coalesce("spelling", F.lit("")).alias("_key"), F.col("spelling").isNull().alias("_none"))
    return join_counted(keyed, judged, ["host", "path", "_key", "_none"], "times").select("page_id", "host", "path", "rule", "verdict", "alias_class")
