"""Rewriting of texts by a language model that the user provides; nothing here talks to a network of its own accord."""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import settled
from .corpus import salted
from .sanitize import Policy, get_policy
from .scan import free

#: Forms of request: path, and where the answer's text stands.
BACKENDS = {"local": ("/api/chat", ("message", "content")), "openai": ("/v1/chat/completions", ("choices", 0, "message", "content"))}


def prompt(policy: Policy) -> str:
    """What a model is told to do with a text under this policy."""
    return (
        f"Rewrite the user's text so that it suits {policy.description or policy.name}. Keep its meaning and facts. "
        "Put abusive, profane or harassing wording into calm, professional words. Replace personal data and secrets by [redacted]. "
        "Answer with the rewritten text alone."
    )


def request(text: str, policy: Policy, backend: str, model: str) -> tuple[str, dict]:
    """(path, body) of the request for one text; ValueError for a backend that is not known."""
    if backend not in BACKENDS:
        raise ValueError(f"no backend {backend!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend][0], {"model": model, "stream": False, "messages": [{"role": "system", "content": prompt(policy)}, {"role": "user", "content": text}]}


def answer(reply: dict, backend: str) -> str:
    """The text of a reply, stripped; empty where the reply has none."""
    for step in BACKENDS[backend][1]:
        try:
            reply = reply[step]
        except (KeyError, IndexError, TypeError):
            return ""
    return (reply or "").strip()


def poster(base_url: str, timeout: float = 120.0, headers: dict | None = None) -> Callable[[str, dict], dict]:
    """A sender that posts a body as JSON to base_url + path."""

    def post(path: str, body: dict) -> dict:
        ask = urllib.request.Request(base_url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(ask, timeout=timeout) as reply:
            return json.loads(reply.read())

    return post


@dataclass(frozen=True)
class Calls:
    """How a task asks: so many texts at a time, each again after a failure, with a pause that doubles."""

    at_once: int = 8
    tries: int = 4
    pause: float = 0.5
    longest_pause: float = 30.0


def _asked(send: Callable[[str, dict], dict], text: str, policy: Policy, backend: str, model: str, calls: Calls) -> tuple[str | None, str | None]:
    """(answer, None) or, when all tries have failed, (None, what the last one met)."""
    error = None
    for n in range(max(1, calls.tries)):
        if n:
            # pauses differ, so that tasks that failed together do not come back together
            time.sleep(min(calls.longest_pause, calls.pause * 2 ** (n - 1)) * (0.5 + random.random() / 2))
        try:
            return answer(send(*request(text, policy, backend, model)), backend), None
        except Exception as e:  # noqa: BLE001 - whatever a sender raises is the text's own error
            error = f"{type(e).__name__}: {e}"
    return None, error


def rewrite(
    df: DataFrame, send: Callable[[str, dict], dict], text: str = "text", provider: str = "generic", backend: str = "local", model: str = "llama3.1", calls: Calls = Calls(), prefix: str = ""
) -> DataFrame:
    """df with columns rewritten (what send(path, body) answers for the text) and rewrite_error, each name behind the prefix.

    Each different text is asked for once, on the executors, `calls.at_once` at a time in a task; answers are written before
    they are joined to the rows, so nothing that reads the result asks again (a task that is lost before does). A text whose tries
    have all failed has a null answer and the last failure in rewrite_error; no other text suffers. Null texts are not
    asked for and have null in both. Rows keep all their columns; repeated rows stay. The text of many rows is no single task's.
    A stream's batches ask for each of their Arrow batches apart, with the same bounds.
    """
    policy = get_policy(provider)
    request("", policy, backend, model)
    names = (f"{prefix}rewritten", f"{prefix}rewrite_error")
    free(df, names)

    def told(texts: list[str]) -> dict[str, tuple[str | None, str | None]]:
        own = list(dict.fromkeys(t for t in texts if t is not None))
        with ThreadPoolExecutor(max(1, calls.at_once)) as pool:
            return dict(zip(own, pool.map(lambda t: _asked(send, t, policy, backend, model, calls), own), strict=True))

    if df.isStreaming:

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = told(list(b[text]))
                yield b.assign(**{n: [own[t][i] if t is not None else None for t in b[text]] for i, n in enumerate(names)})

        return df.mapInPandas(work, T.StructType([*df.schema.fields, *[T.StructField(n, T.StringType()) for n in names]]))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = told(list(b["text"]))
            yield pd.DataFrame({"key": b["key"], "answer": [own[t][0] for t in b["text"]], "error": [own[t][1] for t in b["text"]]})

    keyed = df.select(*[F.col(f"`{c}`") for c in df.columns], F.sha2(F.col(f"`{text}`"), 256).alias("_glyphward_key"))
    known = keyed.filter(F.col("_glyphward_key").isNotNull()).groupBy("_glyphward_key").agg(F.first(F.col(f"`{text}`")).alias("text"), F.count(F.lit(1)).alias("n"))
    asked = known.select(F.col("_glyphward_key").alias("key"), "text", "n")
    counts = settled(asked.select("key", "n", "text"))
    answers = settled(counts.select("key", "text").mapInPandas(ask, "key string, answer string, error string"))
    met = salted(keyed, "_glyphward_key", answers, "key", counts.select("key", "n"))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.col("answer").alias(names[0]), F.col("error").alias(names[1]))
