"""Two versions side by side: renames, manifests, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, signature) of definitions (identity, signature) that went under one identity and came under another.

    Only where exactly one went and exactly one came with the signature; a null signature pairs nothing.
    """
    def once(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        only = rows.where("signature is not null").join(other.select("identity"), "identity", "left_anti")
        return only.groupBy("signature").agg(F.count("*").alias("n"), F.min("identity").alias(name)).where("n = 1").drop("n")

    return once(old, new, "old_id").join(once(new, old, "new_id"), "signature").select("old_id", "new_id", "signature")


def body_signature(texts, props, renders, structure):
    """JSON of what a component's body shows; null where it shows nothing."""
    return F.when((F.size(texts) > 0) | (F.size(renders) > 0) | (structure > 0), F.to_json(F.struct(structure.alias("structure"), F.array_sort(texts).alias("texts"), F.array_sort(props).alias("props"), F.array_sort(renders).alias("renders"))))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("file", F.sha2("text", 256).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) of what was added, removed or changed."""
    both = old.select("file", F.col("sha256").alias("a")).join(new.select("file", F.col("sha256").alias("b")), "file", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("file", change.alias("change")).where("change is not null")
