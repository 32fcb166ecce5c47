"""Url filter: rules first, then trust and distrust spread over the host graph.

Trust is personalised PageRank from hosts the rules allow, along links; distrust
is the same from hosts the rules block, against the links: who links to a bad
host is suspect. Hosts of one registrable domain are tied to it by weak edges. Hosts are
aggregated before any join, so a host with a third of all pages is one row per
neighbour. Built-in expressions only.

The walk ends as soon as no verdict can change any more: what a side's scores can still
gain or lose is bounded by how much they moved last, and once every judged host's distrust
differs from its weighed trust by more than that, later rounds are of no use. The scores
beside the verdicts are those of the last round.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed, for no link can accuse it; pages repeat as they are given;
an empty table gives an empty result; other columns are not read. A host that
nothing reaches scores 0 on both sides and is allowed. Ties are allowed too:
a host is blocked only when distrust exceeds ``ratio`` times trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm.common import discard, lower_ascii, stored

# Action, host, path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MOST_RULES = 10_000
DAMPING = 0.85
# Where verdicts hang on a tie, the walk ends when no side's scores can change by more than
# this in sum.
TOLERANCE = 1e-6
# Rounds between two looks at the scores.
STRIDE = 4
EDGES_A_TASK = 200_000
# An edge between a host and its domain, next to one link.
DOMAIN_WEIGHT = 0.5
# Names below which other parties register domains of their own. Under a
# country's two letters the second label is such a name if it is one of SECOND_LEVELS.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SHARED_DOMAINS = (
    "appspot.com",
    "blogspot.com",
    "cloudfront.net",
    "github.io",
    "gitlab.io",
    "herokuapp.com",
    "netlify.app",
    "neocities.org",
    "pages.dev",
    "tumblr.com",
    "vercel.app",
    "wixsite.com",
    "wordpress.com",
)
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'<>]+)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, rule, action); null if none does.

    The rules are literals of the plan, so their number is checked.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit into the plan")
    fits = [
        F.when(
            ((host == name) | host.endswith("." + name)) & path.startswith(prefix),
            F.struct(
                F.lit(len(name + prefix)).alias("size"),
                F.lit(name + prefix).alias("rule"),
                F.lit(action).alias("action"),
            ),
        )
        for action, name, prefix in rules
    ]
    none = F.lit(None).cast("struct<size:int,rule:string,action:string>")
    return F.array_max(F.array(*fits)) if fits else none


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows ``src, dst, n``: links between different hosts, counted before the shuffle.

    Only absolute and protocol-relative links leave a host.
    """
    target = F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)))
    links = (
        pages.where(F.col(html).isNotNull())
        .select(url_host(F.col(url)).alias("src"), target.alias("to"))
        .select(
            "src",
            url_host(
                F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(
                    F.col("to")
                )
            ).alias("dst"),
        )
    )
    real = (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))
    counted = links.where(real).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("n", F.col("n").cast("double"))


def registrable_labels(host: Column) -> Column:
    """How many labels at the end of a host form its registrable domain: two, or three below
    a name of ``SECOND_LEVELS`` or ``SHARED_DOMAINS``. Addresses (digits and dots, or with a
    colon) have no domain: all their labels."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    top, second = F.get(labels, size - 1), F.get(labels, size - 2)
    last_two = F.concat_ws(".", second, top)
    below_registry = (F.length(top) == 2) & second.isin(*SECOND_LEVELS)
    return (
        F.when(host.rlike(r"^[0-9.]+$|:"), size)
        .when(below_registry | last_two.isin(*SHARED_DOMAINS), 3)
        .otherwise(2)
    )


def domain_links(hosts: DataFrame, weight: float = DOMAIN_WEIGHT) -> DataFrame:
    """Rows ``src, dst, n``: every host and its parent domains point at each other.

    A chain of one label per step, down to the registrable domain, both ways: who runs a
    domain answers for what is below it, but no registry or hoster ties its customers.
    """
    labels = F.split("host", r"\.")
    size = F.size(labels)
    least = registrable_labels(F.col("host"))
    chain = F.transform(
        F.sequence(F.lit(1), F.greatest(size - least + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, size - i + 1), "."),
    )
    steps = hosts.where((F.col("host") != "") & (size > least)).select(chain.alias("chain"))
    pairs = steps.select(
        F.explode(
            F.arrays_zip(
                F.slice("chain", F.lit(1), F.size("chain") - 1).alias("low"),
                F.slice("chain", F.lit(2), F.size("chain") - 1).alias("high"),
            )
        ).alias("p")
    ).select("p.low", "p.high")
    both = pairs.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(
        pairs.select(F.col("high").alias("src"), F.col("low").alias("dst"))
    )
    return both.distinct().withColumn("n", F.lit(float(weight)))


def personalised_rank(
    links: DataFrame,
    seeds: DataFrame,
    rounds: int | None = None,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    judged: DataFrame | None = None,
    ratio: float = 1.0,
) -> DataFrame:
    """Rows ``side, host, score``: mass from ``seeds`` (side, host, seed) along ``links``
    (side, src, dst, n). Sides are separate walks that share their jobs; each starts with
    mass 1. Mass at a host without links out leaves the graph.

    Each round joins one row per host to the links and adds up by target, partly before
    the shuffle; skewed sources are split at run time. The scores are stored every
    ``STRIDE`` rounds, in as many files as the edges need, and the table before goes. The
    walk goes on until no host is new and no side can change by more than ``tolerance`` in
    sum, or, given the ``judged`` hosts (host), until none of their verdicts can change; or for
    ``rounds`` if given.
    """
    total = links.groupBy("side", "src").agg(F.sum("n").alias("total"))
    shares = stored(
        links.join(total, ["side", "src"]).select(
            "side",
            F.col("src").alias("host"),
            "dst",
            (F.col("n") / F.col("total") * damping).alias("share"),
        ),
        "link-shares",
    )
    tasks = max(1, shares.count() // EDGES_A_TASK)
    mass = seeds.groupBy("side").agg(F.sum("seed").alias("mass"))
    start = stored(
        seeds.join(mass, "side")
        .select("side", "host", (F.col("seed") / F.col("mass")).alias("score"))
        .coalesce(tasks),
        "rank-seeds",
    )
    restart = (F.col("score") * (1.0 - damping)).alias("score")
    rank, k = start, 0
    while rounds is None or k < rounds:
        step = STRIDE if rounds is None else min(STRIDE, rounds - k)
        after = rank
        for _ in range(step):
            arrived = shares.join(after, ["side", "host"]).select(
                "side", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score")
            )
            after = (
                start.select("side", "host", restart)
                .unionByName(arrived)
                .groupBy("side", "host")
                .agg(F.sum("score").alias("score"))
            )
        after = stored(after.coalesce(tasks), "rank")
        k += step
        done = rounds is None and _settled(rank, after, damping**step, tolerance, judged, ratio)
        if rank is not start:
            discard(rank)
        rank = after
        if done:
            break
    discard(shares)
    return rank


def _settled(
    before: DataFrame,
    after: DataFrame,
    shrinks: float,
    tolerance: float,
    judged: DataFrame | None,
    ratio: float,
) -> bool:
    """Whether the walk may end. If ``shrinks`` is what is left of a difference after the
    rounds between, a side is at most ``change * shrinks / (1 - shrinks)`` from its end."""
    both = before.select("side", "host", F.lit(-1).alias("way"), "score").unionByName(
        after.select("side", "host", F.lit(1).alias("way"), "score")
    )
    changes = both.groupBy("side", "host").agg(
        F.abs(F.sum(F.col("score") * F.col("way"))).alias("change"), F.min("way").alias("oldest")
    )
    sides = {
        r["side"]: r
        for r in changes.groupBy("side")
        .agg(F.sum("change").alias("change"), F.count_if(F.col("oldest") > 0).alias("fresh"))
        .collect()
    }
    if any(r["fresh"] for r in sides.values()):
        return False
    left = {side: r["change"] * shrinks / (1.0 - shrinks) for side, r in sides.items()}
    if all(v <= tolerance for v in left.values()):
        return True
    if judged is None:
        return False
    of = {
        side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("score"))), F.lit(0.0))
        for side in ("trust", "distrust")
    }
    doubt = left.get("distrust", 0.0) + ratio * left.get("trust", 0.0)
    margins = (
        after.join(judged, "host", "left_semi")
        .groupBy("host")
        .agg(F.abs(of["distrust"] - of["trust"] * ratio).alias("margin"))
    )
    return margins.where(F.col("margin") <= doubt).isEmpty()


def host_scores(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    rounds: int | None = None,
    ratio: float = 1.0,
) -> DataFrame:
    """Rows ``host, trust, distrust`` for every host the spread reaches, near enough to the
    end of the walk that no verdict by ``ratio`` can change."""
    judged = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    action = rule_of(F.col("host"), F.col("path"), rules)["action"]
    hosts = stored(
        judged.select("host", action.alias("action"))
        .groupBy("host")
        .agg(
            F.count_if(F.col("action") == "allow").alias("allowed"),
            F.count_if(F.col("action") == "block").alias("blocked"),
            F.count(F.lit(1)).alias("pages"),
        ),
        "hosts",
    )
    links = stored(
        host_links(pages)
        .unionByName(domain_links(hosts.select("host")))
        .groupBy("src", "dst")
        .agg(F.sum("n").alias("n")),
        "host-links",
    )
    there = links.select(F.lit("trust").alias("side"), "src", "dst", "n")
    back = links.select(
        F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"
    )

    def seeds(side: str, column: str) -> DataFrame:
        # Share of the host's pages, so that a large host does not drown the others.
        return hosts.where(F.col(column) > 0).select(
            F.lit(side).alias("side"), "host", (F.col(column) / F.col("pages")).alias("seed")
        )

    scores = personalised_rank(
        there.unionByName(back),
        seeds("trust", "allowed").unionByName(seeds("distrust", "blocked")),
        rounds,
        # Pages that a rule judges need no verdict of their host.
        judged=hosts.where(F.col("allowed") + F.col("blocked") < F.col("pages")).select("host"),
        ratio=ratio,
    )
    discard(links)

    def of(side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("score"))), F.lit(0.0))

    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    ratio: float = 1.0,
    rounds: int | None = None,
) -> DataFrame:
    """Rows ``page_id, host, path, rule, verdict, trust, distrust``, one per page."""
    pages = pages.select("page_id", "url", "html")
    scores = host_scores(pages, rules, rounds, ratio)
    judged = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    spread = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), spread).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
