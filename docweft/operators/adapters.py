"""Hooks for outside models: a client is called on Arrow batches, with retries, a budget of calls, and fallbacks.

A client is a picklable callable (list of prompts) -> list of answers. The stub gives the same answer for the same prompt.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import rules as R

Client = Callable[[list[str]], list[str]]


def stub_client(prompts: list[str]) -> list[str]:
    """A yes for prompts whose digest is even, with a confidence from the digest."""
    out = []
    for p in prompts:
        h = int(hashlib.sha256(p.encode()).hexdigest()[:8], 16)
        out.append(json.dumps({"label": int(h % 2 == 0), "confidence": round(0.5 + (h % 1000) / 2000, 3)}))
    return out


def ask(df: DataFrame, key: str, prompt: str, client: Client = stub_client, batch: int = 120, tries: int = 3, wait: float = 1.0, most_calls: int | None = None) -> DataFrame:
    """(key, answer, error): answers of the client. A failed batch is tried again after 1, 2, 4 .. waits, then asked one by one.

    most_calls bounds the calls of a partition; rows beyond it get an error, none is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = 0

        def call(prompts: list[str]) -> list[str]:
            nonlocal calls
            for k in range(tries):
                if most_calls is not None and calls >= most_calls:
                    raise RuntimeError("out of calls")
                calls += 1
                try:
                    out = client(prompts)
                    if len(out) != len(prompts):
                        raise ValueError("as many answers as prompts are needed")
                    return out
                except Exception:
                    if k + 1 == tries:
                        raise
                    time.sleep(wait * 2**k)
            raise RuntimeError("no tries")

        def one(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(a, None) for a in call(prompts)]
            except Exception as e:
                if len(prompts) == 1:
                    return [(None, str(e))]
                return [one([p])[0] for p in prompts]

        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                got = one(["" if p is None else p for p in part["prompt"]])
                yield pd.DataFrame({"key": part["key"].to_numpy(), "answer": [a for a, _ in got], "error": [e for _, e in got]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"))
    return rows.mapInPandas(run, "key string, answer string, error string").withColumnRenamed("key", key)


def payload(answer: Column, schema: str) -> Column:
    """The JSON object of an answer, code fences taken off; null if it can't be parsed."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.from_json(bare, schema)


def refine(classified: DataFrame, key: str, prompt: str, label: str, confidence: str, floor: float = 0.8, client: Client = stub_client) -> DataFrame:
    """classified with labels of low confidence asked anew; what can't be parsed keeps the first label. source tells which."""
    low = classified.filter(F.col(confidence) < floor)
    asked = ask(low, key, prompt, client).select(F.col(key).alias("__k"), payload(F.col("answer"), "label int")["label"].alias("__label"))
    out = classified.join(asked, F.col(key).cast("string") == F.col("__k"), "left")
    return out.withColumns({label: F.coalesce("__label", label), "source": F.when(F.col("__label").isNotNull(), "model").otherwise("classifier")}).drop("__k", "__label")


def uncovered_sentences(sentences: DataFrame, covered: DataFrame, doc: str, number: str) -> DataFrame:
    """Sentences with an action verb that no event has as evidence."""
    from docweft.functions import rules as R

    return sentences.filter(R.has_action_verb(F.col("text"))).join(covered.select(doc, number).distinct(), [doc, number], "left_anti")
