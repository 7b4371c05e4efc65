"""URL filter: listed rules first, link-graph trust for everything else.

A rule names a host and a path prefix and holds for the host, its subdomains and the paths
below. URLs that no rule fits are judged by their host. Two scores spread over the host graph,
whose edges are absolute links between pages of different hosts: trust starts at hosts with
allowed pages and follows links, distrust starts at hosts with blocked pages and follows links
backwards, to the hosts that link there. Both are personalised PageRanks whose seeds weigh the
share of the host's pages that the rules allow or block. Scores are given in units of a seed: a
seed holds its weight and, from any host, the damped share arrives over each link, which is
the PageRank divided by its restart probability.

Distrust is dealt out among a host's linkers, so what each gets shrinks as a blocked host becomes
popular. Beside it goes the exposure, which starts at the same seeds and goes the same way, but
weighs a link by its share of the linker's links: it is the damped chance to get to blocked
pages by following a host's links, before any allowed ones and however many others link there.
A host is blocked when its distrust or its exposure reaches the threshold and exceeds its trust.

A null url, or one without ``://``, has an empty host and path and is allowed. Null html has no
links. Each input row gives one result row; an empty table gives an empty result; further
columns are ignored.
"""

import string
from dataclasses import dataclass

from pyspark.sql import functions as F

from cashtide import session
from cashtide.sources.tables import table

DAMPING = 0.85
THRESHOLD = 0.4
ITERATIONS = 50
#: The spreading ends when the scores change by less than this share of all seed weight.
SETTLED = 1e-4
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def lower_ascii(text):
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url):
    """Host and path of a URL, both empty without ``://``."""
    begin = F.locate("://", url)
    rest = F.substr(url, begin + 3)
    known = F.coalesce(begin > 0, F.lit(False))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def fitting_rule(host, path, rules):
    """The longest rule that fits, as a struct, else null. Of equal length the longer host wins."""
    choice = []
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host)), reverse=True):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        choice.append(
            F.when(
                inside & F.startswith(path, F.lit(rule.path)),
                F.struct(
                    F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict")
                ),
            )
        )
    return F.coalesce(*choice)


def host_links(pages):
    """Links between different hosts with their number; pages hold ``host`` and ``html``."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))))
    return (
        pages.select("host", target.alias("to"))
        .select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst"))
        .filter("src <> dst AND src <> '' AND dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def seeds(judged):
    """Per host and score the share of its pages that a rule allows or, for both others, blocks."""
    return (
        judged.filter("host <> ''")
        .groupBy("host")
        .agg(
            F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("int")).alias("trust"),
            F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("int")).alias("distrust"),
        )
        .withColumn("exposure", F.col("distrust"))
        .unpivot("host", ["trust", "distrust", "exposure"], "score", "weight")
        .filter("weight > 0")
    )


def steps(links, start):
    """Edges of all scores with the share each carries: forward for trust, else backward.

    Exposure weighs a link among the links of its page's host, the others among those of the
    host that passes the score on. A host takes on exposure by its pages that no rule allows.
    """
    forward = links.select(
        F.lit("trust").alias("score"), F.col("src").alias("a"), F.col("dst").alias("b"), "links"
    )
    backward = links.select(F.lit("distrust").alias("score"), "dst", "src", "links")
    both = forward.union(backward)
    total = both.groupBy("score", "a").agg(F.sum("links").alias("total"))
    shares = both.join(total, ["score", "a"]).select(
        "score", "a", "b", (F.col("links") / F.col("total")).alias("share")
    )
    allowed = start.filter("score = 'trust'").select(F.col("host").alias("a"), "weight")
    open_share = F.col("share") * (1 - F.coalesce("weight", F.lit(0.0)))
    turned = shares.filter("score = 'trust'").join(allowed, "a", "left")
    return shares.union(turned.select(F.lit("exposure"), "b", "a", open_share))


def spread(links, start, damping=DAMPING, iterations=ITERATIONS, settled=SETTLED):
    """The scores spread over the links: rows (host, score, weight)."""
    start = session.cut(start, "host-seeds")
    edges = session.cut(steps(links, start), "host-steps")
    total = start.agg(F.sum("weight")).first()[0]
    held = start
    if not total or edges.isEmpty():
        return held
    for _ in range(iterations):
        moved = held.join(edges.withColumnRenamed("a", "host"), ["score", "host"]).select(
            F.col("b").alias("host"),
            "score",
            (F.col("weight") * F.col("share") * damping).alias("weight"),
        )
        after = session.cut(
            moved.unionByName(start).groupBy("host", "score").agg(F.sum("weight").alias("weight")),
            "host-scores",
        )
        change = (
            after.unionByName(held.withColumn("weight", -F.col("weight")))
            .groupBy("host", "score")
            .agg(F.abs(F.sum("weight")).alias("gap"))
            .agg(F.sum("gap"))
            .first()[0]
        )
        held = after
        if change <= settled * total:
            break
    return held


def host_verdicts(scores, threshold=THRESHOLD):
    by_host = scores.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("score") == s, F.col("weight"))), F.lit(0.0)).alias(s)
        for s in ("trust", "distrust", "exposure")
    ])
    worst = F.greatest("distrust", "exposure")
    bad = (worst >= threshold) & (worst > F.col("trust"))
    return by_host.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages, rules=RULES, damping=DAMPING, threshold=THRESHOLD):
    """Per page: host, path, the rule that fits, and the verdict with its host's scores."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn(
        "found", fitting_rule(F.col("host"), F.col("path"), rules)
    )
    judged = judged.select("page_id", "host", "path", "found.rule", "found.verdict", "html")
    plain = judged.drop("html")
    scores = spread(host_links(judged), seeds(plain), damping)
    hosts = session.cut(host_verdicts(scores, threshold), "host-verdicts")
    return (
        plain.join(hosts, "host", "left")
        .withColumn("verdict", F.coalesce("verdict", "host_verdict", F.lit("allow")))
        .select(
            "page_id", "host", "path", "rule", "verdict",
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        )
    )


def op2_url_trust(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
