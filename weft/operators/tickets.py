"""Tickets: what kind they are, the terms they name, and bundles within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIDEO_LINK = r"(?i)\.(gif|mkv|avi|webm|mov|mp4)(#|\?|$)"
VIDEO_MENTION = r"(?i)\b(screencast|screen[ -]?recording|video (of|recording|attached))\b"
#: Words of servers and operations, and of interaction.
_BACKEND = [
    "502", "503", "504", "api gateway", "background job", "connection pool", r"ci/cd", "cpu usage", "cron", "database",
    r"deploy(ed|ing|ments?|s)?", "docker", r"env(ironment)? variable", "gateway timeout", r"index(ing)? (the )?table",
    r"infra(structure)?", "job queue", "k8s", "kafka", "kubernetes", "latency", "load balancer", "memory leak", "microservice",
    "migration", "mongo", "mysql", "nginx", "pipeline", "postgres", "rabbitmq", r"rate[- ]?limit(ed|ing)?", "redis", "sql",
    "terraform", "throughput", "webhook", "worker",
]
_ACTS = "|".join(sorted(("work", "save", "open", "load", "close", "submit", "navigate", "trigger", "fire", "respond", "do anything")))
_TRIES = "|".join(("hit", "submit", "tap", "press", "click"))
_BEHAVIOUR = [
    "not working", "nothing happens", "unresponsive", r"no (effect|reaction|response)", r"isn'?t working", rf"does( not|n'?t) ({_ACTS})",
    r"won'?t (close|load|open|save|submit|work)", rf"(after|when) (i |we |you )?({_TRIES})", r"clicking .* (does|has) ",
]
BACKEND = r"(?i)\b(" + "|".join(_BACKEND) + r")\b"
BEHAVIOUR = r"(?i)\b(" + "|".join(_BEHAVIOUR) + ")"  # words may go on: "after clicking"


def classify(text: Column, screenshots: Column, links: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    video = F.coalesce(F.exists(links, lambda x: F.regexp_like(x, F.lit(VIDEO_LINK))), F.lit(False)) | F.regexp_like(text, F.lit(VIDEO_MENTION))
    return F.when(video, "unsupported").when(F.coalesce(screenshots, F.lit(0)) > 0, "visual").when(F.regexp_like(text, F.lit(BACKEND)), "out-of-domain").when(F.regexp_like(text, F.lit(BEHAVIOUR)), "behavioral").otherwise("textual")


DECLINES = {"out-of-domain": ("out-of-scope", "Servers, operations or performance, not the interface: a person or another tool should look at it."), "unsupported": ("unsupported-input", "Videos can't be matched; a still picture of the state can.")}


def decline(entry_point: Column) -> Column:
    """(reason, message) of tickets that can't be matched, else null."""
    out = F.lit(None).cast("struct<reason: string, message: string>")
    for kind, (reason, message) in DECLINES.items():
        out = F.when(entry_point == kind, F.struct(F.lit(reason).alias("reason"), F.lit(message).alias("message"))).otherwise(out)
    return out


def resolve(tickets: DataFrame) -> DataFrame:
    """tickets (text, screenshots, links, ...) with entry_point, and either decline or the terms to match."""
    own = tickets.withColumn("entry_point", classify(F.col("text"), F.col("screenshots"), F.col("links"))).withColumn("decline", decline(F.col("entry_point")))
    return own.withColumn("terms", F.when(F.col("decline").isNull(), terms(F.coalesce("text", F.lit("")))))


#: \b and \s as JavaScript reads them: words are ASCII, spaces are not only ASCII.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def terms(text: Column) -> Column:
    """Quoted phrases; else runs of up to four capitalised words; else the whole text."""
    quoted = F.filter(F.regexp_extract_all(text, F.lit("[\"'`]([^\"'`]{2,})[\"'`]"), F.lit(1)), lambda t: F.length(F.trim(t)) > 1)
    named = F.filter(F.regexp_extract_all(text, F.lit(rf"{_EDGE}([A-Z][a-z]+(?:{_SPACE}+[A-Z][a-z0-9]+){{0,3}}){_EDGE}"), F.lit(1)), lambda t: F.length(t) > 2)
    return F.when(F.size(quoted) > 0, quoted).when(F.size(named) > 0, named).otherwise(F.array(text))


def tokens_of(json: Column) -> Column:
    return F.ceil(F.length(json) / 4)


def within_budget(sections: DataFrame, budget: int, group: str, priority: str, size: str) -> DataFrame:
    """With running size in order of priority, and whether the section still fits."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(priority).rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", running).withColumn("fits", F.col("used") <= budget)


TRIM_ORDER = ("history", "tests", "journeys", "blastRadius", "lineage")


def trim(bundle: dict, budget: int) -> dict:
    """The bundle with whole sections emptied, least important first, each with a warning, until it fits; one match always stays."""
    import json

    used = lambda b: -(-len(json.dumps({k: v for k, v in b.items() if k != "budget"}, separators=(",", ":"), ensure_ascii=False)) // 4)
    out = {**bundle, "warnings": list(bundle.get("warnings", []))}
    for name in TRIM_ORDER:
        if used(out) <= budget:
            break
        if out.get(name):
            out[name] = []
            out["warnings"].append(f"{name} trimmed to fit the token budget")
    if used(out) > budget and len(out.get("match", [])) > 1:
        out["match"] = out["match"][:1]
        out["warnings"].append("lower matches trimmed to fit the token budget")
    out["budget"] = {"limit": budget, "used": used(out)}
    return out
