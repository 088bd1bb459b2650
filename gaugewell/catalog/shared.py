"""Inputs that several query groups derive from the given tables."""

from pyspark.sql import functions as F

from gaugewell.session import cut_lineage


def embedding_columns(load, dims=8, label=False):
    """vec_id, e0…e{dims-1} as doubles (and the label)."""
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)]
    return load("embeddings").select("vec_id", *cols, *(["label"] if label else []))


def embedding_sql(dims=8, label=False):
    return "select vec_id, " + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(dims)) + (", label" if label else "") + " from embeddings"


def distance_sql(dims, a="a", b="b"):
    return "sqrt(" + " + ".join(f"pow({a}.e{i}-{b}.e{i},2)" for i in range(dims)) + ")"


def document_features(load):
    """Length figures of the labelled documents with their quality label.

    The models read these few numbers many times, the texts are read once.
    """
    text = F.col("text")
    # whole runs are taken out, which leaves the same as taking out single characters
    rows = load("documents").join(load("labels"), "doc_id").select(
        "doc_id",
        "n_chars",
        F.size(F.split(text, r"\s+")).cast("long").alias("n_words"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        (F.length(F.regexp_replace(text, "[^0-9]+", "")) / F.length(text)).alias("digit_share"),
        (F.length(F.regexp_replace(text, "[^A-Z]+", "")) / F.length(text)).alias("upper_share"),
        "quality",
        "toxic",
    )
    return cut_lineage(rows)
