"""Model calls behind injected clients: the engine ships deterministic fakes and no service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_per


class FakeModel:
    """Answers by fixed rules: a prompt that holds a key gets its answer, others the default."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = "{}"):
        self.answers, self.default = answers or {}, default

    def complete(self, prompt: str) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), self.default)


def complete(prompts: DataFrame, make_client: Callable, retries: int = 1, key: str = "prompt_id", prompt: str = "prompt") -> DataFrame:
    """``key, response, status, attempts, error`` of each prompt. A failure is a row, never an exception; an empty answer is a failure.

    ``make_client`` is called once for each partition and returns an object with ``complete(prompt)``.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for k, p in batch[[key, prompt]].itertuples(index=False):
                text, error, n = None, None, 0
                while not text and n <= retries:
                    n += 1
                    try:
                        text, error = client.complete(p), None
                    except Exception as e:  # a client's failure becomes the row's status
                        error = f"{type(e).__name__}: {e}"
                rows.append((k, text or None, "ok" if text else "failed", n, error or (None if text else "empty output")))
            yield pd.DataFrame(rows, columns=[key, "response", "status", "attempts", "error"])

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, response string, status string, attempts int, error string")


def complete_cached(prompts: DataFrame, cache: DataFrame, make_client: Callable, retries: int = 1, key: str = "prompt_id", prompt: str = "prompt") -> DataFrame:
    """Answers from a cache keyed by the prompt's SHA-256; only prompts without one are asked."""
    keyed = prompts.withColumn("prompt_sha", F.sha2(prompt, 256))
    known = keyed.join(cache.select("prompt_sha", "response"), "prompt_sha").select(key, "response", F.lit("cached").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return known.unionByName(complete(keyed.join(cache.select("prompt_sha"), "prompt_sha", "left_anti"), make_client, retries, key, prompt))


def embed(texts: DataFrame, make_client: Callable, batch_size: int = 32, key: str = "id", text: str = "text") -> DataFrame:
    """``key, embedding`` by an injected client with ``embed_documents(list)``, in batches."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            vectors = [v for i in range(0, len(b), batch_size) for v in client.embed_documents(b[text].iloc[i : i + batch_size].tolist())]
            yield pd.DataFrame({key: b[key].tolist(), "embedding": vectors})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def rerank(hits: DataFrame, make_client: Callable | None = None, k: int = 10, by: tuple[str, ...] = ("query_id",), score: str = "score", key: str = "item_id") -> DataFrame:
    """The k best hits of each query by a client's scores, or by their own without a client.

    ``make_client`` returns an object with ``score(query, texts)``; ``hits`` has query and statement. Where a client fails, or gives
    fewer scores than texts, a hit keeps its own score.
    """
    if make_client is None:
        return top_per(hits.withColumn("rerank_score", F.col(score).cast("double")), list(by), [F.col("rerank_score").desc_nulls_last(), F.col(key).asc()], k)
    kind = hits.schema[key].dataType.simpleString()
    keys = ", ".join(f"{b} {hits.schema[b].dataType.simpleString()}" for b in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[score].astype(float).tolist()
        try:
            given = list(make_client().score(pdf["query"].iloc[0], pdf["statement"].fillna("").tolist()))
        except Exception:  # a client's failure leaves the hits in their own order
            given = []
        scores = [given[i] if i < len(given) and given[i] is not None else own[i] for i in range(len(own))]
        return pdf[[*by, key]].assign(rerank_score=[float(s) for s in scores])

    # the best of each query only go to the client: as many as a first search returns
    near = top_per(hits, list(by), [F.col(score).desc_nulls_last(), F.col(key).asc()], 10 * k, "__near").drop("__near")
    scored = near.select(*by, key, "query", "statement", score).groupBy(*by).applyInPandas(run, f"{keys}, {key} {kind}, rerank_score double")
    return top_per(near.join(scored, [*by, key]), list(by), [F.col("rerank_score").desc(), F.col(key).asc()], k)
