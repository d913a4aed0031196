"""Source trees, locale files, interface descriptions and history, as tables."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import locale_of, pull_request


def source_tree(spark: SparkSession, root: str, include: tuple[str, ...] = ("tsx", "jsx", "ts")) -> DataFrame:
    """(file, text, sha256) of the sources below a folder, without dependencies and declarations."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(include) + "}").text(root)
    path = F.col("_metadata.file_path")
    file = F.regexp_replace(path, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    rows = whole.select(file.alias("file"), F.col("value").alias("text"))
    return rows.where(~F.col("file").rlike(r"(^|/)node_modules/|\.d\.ts$")).withColumn("sha256", F.sha2("text", 256))


def locale_table(files: DataFrame, default: str = "en") -> DataFrame:
    """(key, locale, text) of JSON locale files (file, text): nested keys joined by dots, strings only, later files win."""

    def flatten(batches):
        import pandas as pd

        def walk(value, prefix=""):
            for k, v in value.items():
                if isinstance(v, dict):
                    yield from walk(v, f"{prefix}{k}.")
                elif isinstance(v, str):
                    yield prefix + k, v

        for batch in batches:
            rows = []
            for file, locale, text in zip(batch["file"], batch["locale"], batch["text"]):
                try:
                    value = json.loads(text)
                except ValueError:
                    continue
                if isinstance(value, dict):
                    rows += [(file, locale, k, v) for k, v in walk(value)]
            yield pd.DataFrame(rows, columns=["file", "locale", "key", "text"])

    flat = files.select("file", F.coalesce(locale_of(F.col("file")), F.lit(default)).alias("locale"), "text").mapInPandas(flatten, "file string, locale string, key string, text string")
    return flat.groupBy("key", "locale").agg(F.max_by("text", "file").alias("text"))


def interface(spark: SparkSession, text: str) -> DataFrame:
    """(method, endpoint, name, fields) of an OpenAPI document; anything else is an empty table."""
    schema = "method string, endpoint string, name string, fields array<struct<name: string, type: string>>"
    try:
        document = json.loads(text)
        paths = document["paths"]
    except (ValueError, KeyError, TypeError):
        return spark.createDataFrame([], schema)

    def named(spec: dict) -> tuple[str | None, dict]:
        if "$ref" in spec:
            name = spec["$ref"].rsplit("/", 1)[-1]
            return name, document.get("components", {}).get("schemas", {}).get(name, {})
        return spec.get("title"), spec

    rows = []
    for path, methods in paths.items():
        for method, call in methods.items():
            if method.upper() not in ("DELETE", "GET", "PATCH", "POST", "PUT"):
                continue
            for code in ("200", "201"):
                body = call.get("responses", {}).get(code, {}).get("content", {}).get("application/json", {}).get("schema")
                if body is None:
                    continue
                name, spec = named(body)
                if spec.get("type") == "array":
                    inner, spec = named(spec.get("items", {}))
                    name = f"{inner}[]" if inner else name
                kinds = [(k, v.get("type") or v.get("$ref", "unknown").rsplit("/", 1)[-1]) for k, v in list(spec.get("properties", {}).items())[:40]]
                rows.append((method.upper(), "/".join(f":{p[1:-1]}" if p.startswith("{") and p.endswith("}") else p for p in path.split("/")), name, kinds))
                break
    return spark.createDataFrame(rows, schema)


def with_responses(sources: DataFrame, described: DataFrame) -> DataFrame:
    """Data sources (method, endpoint, response) with the described response where they have none; GET stands in for a missing method or description."""
    by = described.groupBy("method", "endpoint").agg(F.first("name").alias("named"))
    own = sources.withColumn("asked", F.coalesce("method", F.lit("GET")))
    exact = own.join(F.broadcast(by.withColumnRenamed("method", "asked")), ["asked", "endpoint"], "left")
    get = by.where("method = 'GET'").select("endpoint", F.col("named").alias("by_get"))
    return exact.join(F.broadcast(get), "endpoint", "left").withColumn("response", F.coalesce("response", "named", "by_get")).select(*sources.columns)


def history(spark: SparkSession, repository: str, files: list[str], limit: int = 5) -> DataFrame:
    """(sha, subject, pull_request, time) of the latest commits to files; empty where there is no repository."""
    rows = []
    for file in files:
        try:
            said = subprocess.run(["git", "-C", repository, "log", "--follow", f"-n{limit}", "--format=%H%x09%ct%x09%s", "--", file], capture_output=True, text=True, timeout=60)
        except (OSError, subprocess.TimeoutExpired):
            continue
        rows += [tuple(x.split("\t", 2)) for x in said.stdout.splitlines() if x.count("\t") >= 2] if said.returncode == 0 else []
    table = spark.createDataFrame(rows, "sha string, time string, subject string").dropDuplicates(["sha"])
    return table.select("sha", "subject", pull_request(F.col("subject")).alias("pull_request"), F.col("time").cast("long").alias("time")).orderBy(F.desc("time"), "sha").limit(limit)


def provenance(repository: str) -> tuple[str | None, bool]:
    """(commit, whether there are changes), (None, False) outside a repository."""
    try:
        head = subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=60)
        state = subprocess.run(["git", "-C", repository, "status", "--porcelain"], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None, False
    return (head.stdout.strip(), bool(state.stdout.strip())) if head.returncode == 0 else (None, False)
