"""Similarity of text pairs, embeddings by text, and the prompts that ask for labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import constants as K
from quellwerk.functions import text as X


def tfidf_cosine(pairs: DataFrame, keys: list[str], left: str, right: str, stop_words: list[str] = K.STOP_WORDS) -> DataFrame:
    """(keys, tfidf_cosine). Each pair is counted within its row, so nothing is shuffled."""
    return pairs.select(*keys, X.tfidf_cosine(F.col(left), F.col(right), stop_words).alias("tfidf_cosine"))


def text_hash(text: Column) -> Column:
    """The key of a text's embedding, of what a model would read of it."""
    return X.record_id(X.clip_tokens(text))


def embedding_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(hash, text) of the distinct texts that are not blank, clipped to a model's length."""
    texts = rows.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("text")).filter(F.col("text").isNotNull())
    clipped = texts.filter(X.strip(F.col("text")) != "").select(X.clip_tokens(F.col("text")).alias("text"))
    return clipped.groupBy(X.record_id(F.col("text")).alias("hash")).agg(F.min("text").alias("text"))


def budgeted(texts: list[str], budget: int, chars_a_token: int = 3) -> Iterator[list[str]]:
    """Batches of texts whose tokens stay within budget; one text beyond it goes alone."""
    held: list[str] = []
    used = 0
    for text in texts:
        cost = max(1, len(text) // chars_a_token)
        if held and used + cost > budget:
            yield held
            held, used = [], 0
        held.append(text)
        used += cost
    if held:
        yield held


def embed(texts: DataFrame, client: Callable[[list[str]], list[list[float]]], budget: int = 150_000) -> DataFrame:
    """(hash, embedding) by calls of the client, each of at most budget tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[list[float]] = []
            for part in budgeted(batch["text"].tolist(), budget):
                found.extend(client(part))
            yield pd.DataFrame({"hash": batch["hash"], "embedding": found})

    return texts.mapInPandas(run, "hash string, embedding array<double>")


def with_embedding_cosines(rows: DataFrame, embeddings: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with a cosine per entry name -> (text column, text column), looked up by text hash
    and 0 where an embedding is missing."""
    for i, (name, (left, right)) in enumerate(pairs.items()):
        for side, column in ((f"_l{i}", left), (f"_r{i}", right)):
            table = embeddings.select(F.col("hash").alias(f"{side}h"), F.col("embedding").alias(side))
            rows = rows.withColumn(f"{side}k", text_hash(F.coalesce(column, F.lit(""))))
            rows = rows.join(table, F.col(f"{side}k") == F.col(f"{side}h"), "left").drop(f"{side}k", f"{side}h")
        rows = rows.withColumn(name, F.round(X.cosine(F.col(f"_l{i}"), F.col(f"_r{i}")), 4)).drop(f"_l{i}", f"_r{i}")
    return rows


LABEL_TEMPLATE = """Question: {question}

Answer (start): {answer}

Sources cited:
{citations}

For every source give a JSON object with idx, semantic_role, relevance_score (0-5), content_quality (0-5) and
influence_type; reply with a JSON array of these objects and nothing else."""


def label_prompts(rows: DataFrame, keys: list[str], question: str, answer: str, index: str, title: str, url: str, text: str, template: str = LABEL_TEMPLATE) -> DataFrame:
    """(keys, prompt): one prompt per record, its citations in order with the first 800
    characters of each, and the first 1500 of the answer."""
    line = F.concat(F.lit("["), F.col(index).cast("string"), F.lit("] "), F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit("N/A")), F.lit(" | "), F.coalesce(url, F.lit("")), F.lit("\nContent: "), X.clip(F.coalesce(text, F.lit("")), 800))
    listed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), line.alias("t"))))
    found = rows.groupBy(*keys).agg(F.first(question).alias("_q"), F.first(answer).alias("_a"), listed.alias("_c"))
    filled = F.lit(template)
    for mark, value in (("{citations}", F.array_join(F.transform("_c", lambda c: c["t"]), "\n\n")), ("{answer}", X.clip(F.coalesce("_a", F.lit("")), 1500)), ("{question}", F.coalesce("_q", F.lit("")))):
        before, after = F.substring_index(filled, mark, 1), F.substring_index(filled, mark, -1)
        filled = F.concat(before, value, after)
    return found.select(*keys, filled.alias("prompt"))
