"""Robots exclusion rules as a table, and admission of URLs by it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = "origin string, group_id int, agent string, allow boolean, path string, crawl_delay double, sitemap string"


def parse_robots(body: str) -> tuple[list[dict], list[str]]:
    """Groups (agents, rules, delay) and sitemap addresses."""
    groups: list[dict] = []
    maps: list[str] = []
    closed = True
    for line in body.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap" and value and value not in maps:
            maps.append(value)
        elif name == "user-agent":
            if closed:
                groups.append({"agents": [], "rules": [], "delay": None})
                closed = False
            groups[-1]["agents"].append(value.lower())
        elif name in ("allow", "disallow") and groups:
            groups[-1]["rules"].append((name == "allow", value))
            closed = True
        elif name == "crawl-delay" and groups:
            try:
                delay = float(value)
                groups[-1]["delay"] = delay if 0 <= delay < float("inf") else groups[-1]["delay"]
            except ValueError:
                pass
    return groups, maps


def rules(robots: DataFrame) -> DataFrame:
    """(origin, body) to one row per agent and rule; groups without rules have one with a null path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                groups, maps = parse_robots(r.body or "")
                for i, g in enumerate(groups):
                    out += [(r.origin, i, a, allow, path, g["delay"], None) for a in g["agents"] for allow, path in (g["rules"] or [(None, None)])]
                out += [(r.origin, -1, None, None, None, None, m) for m in maps]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RULES.split(", ")])

    return robots.select("origin", "body").mapInPandas(rows, RULES)


def rule_regex(path: Column) -> Column:
    """A rule's path as a regular expression: ``*`` is any run, a final ``$`` the end."""
    literal = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), "$").otherwise(""))


def matching(table: DataFrame, user_agent: str) -> DataFrame:
    """The rules of the groups whose agent matches best: the longest name within the user agent, else ``*``."""
    ua = F.lit(user_agent.lower())
    fits = table.filter("agent IS NOT NULL").withColumn("fit", F.when(F.col("agent") == "*", 0).when(F.contains(ua, F.col("agent")), F.length("agent")))
    best = fits.filter("fit IS NOT NULL").groupBy("origin").agg(F.max("fit").alias("fit"))
    return fits.join(best, ["origin", "fit"])


def allows(urls: DataFrame, table: DataFrame, user_agent: str) -> DataFrame:
    """``urls`` (origin, path, ...) with ``allowed``: the longest matching rule decides, allowing wins ties."""
    own = matching(table, user_agent).filter("path <> ''").select("origin", "allow", F.col("path").alias("rule")).distinct()
    hits = urls.select("origin", "path").distinct().join(own, "origin").filter(F.rlike("path", rule_regex(F.col("rule"))))
    verdict = hits.groupBy("origin", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("verdict"))
    return urls.join(verdict, ["origin", "path"], "left").withColumn("allowed", F.coalesce("verdict", F.lit(True))).drop("verdict")


def crawl_delay(table: DataFrame, user_agent: str) -> DataFrame:
    return matching(table, user_agent).groupBy("origin").agg(F.max("crawl_delay").alias("crawl_delay"))


def policy(status: Column) -> Column:
    """What a robots.txt response means."""
    return F.when(status.between(200, 299), "parse").when(status.isin(401, 403), "disallow").when((status >= 500) | (status == 429), "abort").otherwise("allow")


#: Fixed value: how long an origin's answer holds.
VALID_SECONDS = 3600


def policies_at(fetches: DataFrame, answers: DataFrame, seconds: int = VALID_SECONDS) -> DataFrame:
    """``fetches`` (origin, at, ...) with ``answered_at`` and ``policy`` of the last answer (origin, at, status) that still holds.

    An answer holds for ``seconds``; without one the policy is ``ask``.  Answers at one time
    count as one, the one with the largest status.  Time is cut into spans of that length: an answer
    can hold in its own span and the next one only, so a fetch meets the answers of two spans and
    not those of all time, and an origin with a third of all fetches is as many groups as there are spans.
    """
    span = lambda at: F.floor(F.unix_micros(at) / (seconds * 1_000_000))
    columns = fetches.columns
    told = answers.filter("origin IS NOT NULL AND at IS NOT NULL").groupBy("origin", "at").agg(F.max("status").alias("status"))
    told = told.select("origin", F.explode(F.array(span(F.col("at")), span(F.col("at")) + 1)).alias("__span"), "at", F.lit(0).alias("__turn"), "status", F.lit(None).cast(fetches.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("__row"))
    asked = fetches.select("origin", span(F.col("at")).alias("__span"), "at", F.lit(1).alias("__turn"), F.lit(None).cast("int").alias("status"), F.struct(*columns).alias("__row"))
    # The last answer before each fetch: one ordered pass over a span.
    last = Window.partitionBy("origin", "__span").orderBy("at", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    answer = F.when(F.col("__turn") == 0, F.struct("at", "status"))
    both = told.unionByName(asked).withColumn("__last", F.last(answer, ignorenulls=True).over(last)).filter("__turn = 1")
    holds = F.unix_micros("at") - F.unix_micros("__last.at") < seconds * 1_000_000
    return both.select("__row.*", F.when(holds, F.col("__last.at")).alias("answered_at"), F.when(holds, policy(F.col("__last.status"))).otherwise("ask").alias("policy"))
