"""Scorers for reranking: chosen by name, run in batches, allowed to fail."""

from __future__ import annotations

import importlib
import logging
import math
import re
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval

MOST, CUT = 24, 1500  # texts a query that are scored, characters of each
NO_MATCH = -5.0  # of the best rerank score, on the scale of logits


class Scorer(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class TokenOverlap:
    """The share of a query's words that a text has, from -``scale`` to ``scale``. ``poison``: a word in a query at which it fails."""

    def __init__(self, scale: float = 4.0, poison: str | None = None) -> None:
        self.scale, self.poison = scale, poison

    def scores(self, query: str, texts: list[str]) -> list[float]:
        words = set(re.findall(r"[a-z0-9]+", query.lower()))
        if self.poison in words:
            raise RuntimeError(f"cannot score {self.poison}")
        return [self.scale * (2 * len(words & set(re.findall(r"[a-z0-9]+", t.lower()))) / max(1, len(words)) - 1) for t in texts]


def load(spec: str, **settings) -> Scorer:
    """An instance of ``module:Class``."""
    module, colon, name = spec.partition(":")
    if not (module and colon and name):
        raise ValueError(f"a scorer is named module:Class, not {spec!r}")
    return getattr(importlib.import_module(module), name)(**settings)


def _within(seconds: float, scorer: Scorer, query: str, texts: list[str]) -> list[float] | None:
    """The scores, or None where the scorer fails, takes too long or returns something else than a number for each text."""
    pool = ThreadPoolExecutor(1)
    try:
        got = [float(x) for x in pool.submit(scorer.scores, query, texts).result(timeout=seconds)]
        if len(got) != len(texts) or not all(map(math.isfinite, got)):
            raise ValueError("not one finite score a text")
        return got
    except Exception as e:
        logging.getLogger(__name__).warning("no rerank, the order stays: %r", e)
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def reranked(rows: DataFrame, spec: str, settings: dict | None = None, most: int = MOST, cut: int = CUT, seconds: float = 20.0) -> DataFrame:
    """rows with rerank, final, place and mode; rows: (query_id, query, rank, context, text, base, recency, importance, hybrid, ...).

    The first ``most`` of each query (rank from 1) are scored in one call as context and text, cut. Where that works they are ordered by
    rerank + recency + half the centred importance, the others stay behind them in their order, and mode is hybrid-rerank or
    dense-rerank. Where the scorer can't be loaded, fails or takes longer than ``seconds``, rerank is null for the whole query,
    base scaled by recency and importance decides, and mode is hybrid-rrf or dense-fallback. Ties keep the rank.
    """
    clash = {c.lower() for c in rows.columns} & {"rerank", "final", "place", "mode"}
    if clash:
        raise ValueError(f"the table already has columns {sorted(clash)}")
    settings = settings or {}

    def scored(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("rank")
        try:
            scorer = load(spec, **settings)
        except Exception as e:
            logging.getLogger(__name__).warning("no scorer, the order stays: %r", e)
            scores = None
        else:
            scores = _within(seconds, scorer, batch["query"].iloc[0] or "", batch["seen"].tolist())
        return pd.DataFrame({"query_id": batch["query_id"], "rank": batch["rank"], "rerank": pd.array(scores if scores is not None else [None] * len(batch), "Float64")})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("query_id", "rank")}
    seen = F.substring(F.concat_ws("\n", F.nullif("context", F.lit("")), F.coalesce("text", F.lit(""))), 1, cut)
    asked = rows.where(F.col("rank") <= most).select("query_id", "query", "rank", seen.alias("seen"))
    got = asked.groupBy("query_id").applyInPandas(scored, f"query_id {kinds['query_id']}, rank {kinds['rank']}, rerank double")  # ``most`` rows a query
    rows = rows.join(got, ["query_id", "rank"], "left")
    own = Window.partitionBy("query_id")
    worked = F.count("rerank").over(own) > 0
    final = F.when(worked, retrieval.reranked(F.col("rerank"), F.col("recency"), F.col("importance"))).otherwise(retrieval.degraded(F.col("base"), F.col("recency"), F.col("importance")))
    rows = rows.withColumn("_worked", worked).withColumn("final", F.round(final, 9))
    place = F.row_number().over(own.orderBy(F.when(F.col("_worked") & F.col("rerank").isNull(), 1).otherwise(0), F.desc_nulls_last("final"), "rank"))
    mode = F.when(F.col("_worked"), F.when(F.col("hybrid"), "hybrid-rerank").otherwise("dense-rerank")).otherwise(F.when(F.col("hybrid"), "hybrid-rrf").otherwise("dense-fallback"))
    return rows.withColumn("place", place).withColumn("mode", mode).drop("_worked")


def no_strong_match(rows: DataFrame, rerank_least: float = NO_MATCH, dense_least: float = 0.65) -> DataFrame:
    """(query_id, no_strong_match, why) of reranked rows (query_id, rerank, dense): the best rerank score decides where there is one, else the best cosine."""
    best = rows.groupBy("query_id").agg(F.max("rerank").alias("r"), F.coalesce(F.max("dense"), F.lit(0.0)).alias("d"))
    weak = F.when(F.col("r").isNotNull(), F.col("r") < rerank_least).otherwise(F.col("d") < dense_least)
    why = F.when(F.col("r").isNotNull(), F.format_string(f"top rerank score %.2f < {rerank_least}", F.col("r"))).otherwise(F.format_string(f"best cosine %.3f < {dense_least}", F.col("d")))
    return best.select("query_id", weak.alias("no_strong_match"), F.when(weak, why).alias("why"))
