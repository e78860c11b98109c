"""Model completions: a native mock, and live services behind ``mapInPandas``."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.schema import COMPLETION


def mocked(prompt: Column, config: Config) -> Column:
    """The reply of the offline mock as ``COMPLETION``."""
    # Fixed value: the sentence.
    text = F.concat(F.lit(f"[MOCK RESPONSE] Model {config.model} received "), F.length(prompt).cast("string"), F.lit(" characters."))
    return F.struct(F.lit(True).alias("ok"), text.alias("text"), F.lit(config.model).alias("model"), F.lit('{"mock": true}').alias("raw"))


@dataclass(frozen=True)
class Live:
    """A service: a content API if its URL is Google's, else chat completions. Off unless one is passed."""

    url: str
    key: str
    timeout: float = 60.0
    system: str = "You are a helpful assistant."  # fixed value
    #: Requests that a task has under way at once.
    at_once: int = 8
    #: (url, headers, payload, timeout) -> parsed reply; for tests and other transports.
    send: Callable[[str, dict, dict, float], dict] | None = None

    def ask(self, prompt: str, config: Config) -> dict:
        """One completion; an exception is a reply that is not ok."""
        headers, send = {"Content-Type": "application/json"}, self.send or _post
        try:
            if "generativelanguage.googleapis.com" in self.url:
                data = send(f"{self.url}?key={self.key}", headers, {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": config.temperature, "maxOutputTokens": config.max_tokens}}, self.timeout)
                parts = next(iter(data.get("candidates") or []), {}).get("content", {}).get("parts") or [{}]
                text = parts[0].get("text", "")
            else:
                messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
                data = send(self.url, headers | {"Authorization": f"Bearer {self.key}"}, {"model": config.model, "messages": messages, "max_tokens": config.max_tokens, "temperature": config.temperature}, self.timeout)
                choice = next(iter(data.get("choices") or []), {})
                text = choice.get("message", {}).get("content") or choice.get("text") or ""
            return {"ok": True, "text": text.strip(), "model": config.model, "raw": json.dumps(data)}
        except Exception as e:  # noqa: BLE001  whatever the service or the network does is a reply
            return {"ok": False, "text": f"[ERROR] {e}", "model": config.model, "raw": "{}"}


def _post(url: str, headers: dict, payload: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def completed(docs: DataFrame, prompt: Column, config: Config, live: Live | None = None, out_col: str = "completion") -> DataFrame:
    """``docs`` with the reply to ``prompt``; a null prompt is not sent and has a null reply.

    Store the result before using it twice: a live reply is made anew with each evaluation.
    """
    if live is None:
        return docs.withColumn(out_col, F.when(prompt.isNotNull(), mocked(prompt, config)))
    with_prompt = docs.withColumn("_prompt", prompt)
    schema = docs.schema
    names = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(live.at_once) as pool:
            for frame in frames:
                out = frame[names].copy()
                out[out_col] = [*pool.map(lambda p: live.ask(p, config) if isinstance(p, str) else None, frame["_prompt"])]
                yield out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return with_prompt.mapInPandas(run, f"{ddl}, `{out_col}` {COMPLETION}")
