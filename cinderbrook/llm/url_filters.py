"""URL filters: path rules, and for urls that no rule fits the trust and distrust of their hosts.

Pages that an allow rule fits seed trust at their hosts, pages that a block rule fits seed distrust. Trust follows links between
hosts and distrust runs against them: both are personalised PageRank, summed up as the walk's steps from the seeds, one table per
step in Spark. The walk ends when next to nothing is on its way and no step reaches a host that none reached before. A host is
blocked if distrust is more than a given part of what reached it; what nothing reached is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Chance that the walk goes on.
DAMPING = 0.85
#: The walk goes on while more than this part of the seeds is on its way.
TOLERANCE = 1e-4
#: Part of distrust in what reached a host beyond which it is blocked.
THRESHOLD = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule (verdict, rule) that fits the host or one of its parents and begins the path; else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tried first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


def host_scores(scratch: Scratch, seeds: DataFrame, links: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and links (src, dst, n) between different hosts."""
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    edges = scratch.keep(forward.unionByName(backward), "links")
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    edges = scratch.keep(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out") * damping).alias("share")), "edges")
    seeded = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("x")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("x")))).alias("s"))
    seeded = seeded.select("s.kind", "host", F.col("s.x").cast("double").alias("x")).where("x > 0")
    walk = scratch.keep(seeded.withColumn("total", F.col("x")), "walk-0")  # x: on its way from here; total: all that came by so far
    start, step = walk.agg(F.sum("x")).first()[0] or 0.0, 0
    while True:
        step += 1
        moved = walk.where("x is not null").join(edges.withColumnRenamed("src", "host"), ["kind", "host"])
        moved = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("x") * F.col("share")).alias("step"))
        after = walk.join(moved, ["kind", "host"], "full").select("kind", "host", F.col("step").alias("x"), (F.coalesce("total", F.lit(0.0)) + F.coalesce("step", F.lit(0.0))).alias("total"), F.col("total").isNull().alias("new"))
        walk = scratch.keep(after, f"walk-{step}").drop("new")
        scratch.drop(f"walk-{step - 1}")
        state = scratch.spark.read.parquet(f"{scratch.root}/walk-{step}").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.count(F.when(F.col("new"), 1))).first()
        if state[0] <= tolerance * start and not state[1]:
            break
    scratch.drop("links")
    by_kind = {kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("total"))), F.lit(0.0)) * (1 - damping) for kind in ("trust", "distrust")}
    return walk.groupBy("host").agg(*(total.alias(kind) for kind, total in by_kind.items()))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust (of the host).

    A null url, or one without ://, has empty host and path; its page neither seeds nor links. Null or empty html has no links;
    links within a host don't count. Repeated rows stay (and seed again); an empty table gives an empty result; other columns
    aren't read. The walk has no bound on its steps: with damping below 1 it ends after some log(tolerance) / log(damping) of them,
    or as many as lead from a seed to the farthest host.
    """
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError("damping must be below 1 and tolerance positive, or the walk doesn't end")
    scratch = Scratch(df.sparkSession, "urls")
    url = F.col(url_col).cast("string")
    pages = df.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    pages = scratch.keep(pages.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)), "pages")
    verdicts = [F.sum(F.when(F.col("found.verdict") == v, 1).otherwise(0)).alias(kind) for v, kind in (("allow", "trust"), ("block", "distrust"))]
    seeds = pages.where("found is not null and host <> ''").groupBy("host").agg(*verdicts)
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    links = df.select(url_host(url).alias("src"), F.explode(targets).alias("dst")).where("src <> '' and dst <> src")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    scores = scratch.keep(host_scores(scratch, seeds, links, damping, tolerance), "scores")
    judged = pages.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    share = F.round(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), 9)
    verdict = F.coalesce(F.col("found.verdict"), F.when(share > threshold, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
