"""Model providers over HTTP: routes, request limits, adapters of two public protocols, and the registry of names.

A limit for all workers is kept by the lanes of plans.calls. A provider's own gate, made in each task, lets a lane's share of the
requests a minute through, for those who ask a provider by itself.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from ipaddress import ip_address
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumlake.operators.analysis import LocalProvider, ModelError, Provider, loaded

# Where the built-in providers are, their protocols' version, ports of schemes, and the largest answer.
BASES = {"openai": "https://api.openai.com/v1", "deepseek": "https://api.deepseek.com", "anthropic": "https://api.anthropic.com"}
ANTHROPIC_VERSION = "2023-06-01"
PORTS = {"http": 80, "https": 443}
MOST_BYTES = 8 << 20
WINDOW_SECONDS = 60.0

ROUTE = "struct<scheme:string,host:string,port:int,path:string>"


def route(url: str) -> tuple[str, str, int | None, str]:
    """What of a URL leads to a server: scheme, host, port (the scheme's own if none is given) and path without slashes at
    its end. Credentials, query and fragment don't count; addresses are written in their shortest form. A URL that can't be
    read is a ValueError."""
    u = urlsplit(url)
    host = u.hostname or ""
    try:
        host = ip_address(host).compressed
    except ValueError:
        pass
    return u.scheme.lower(), host.lower(), PORTS.get(u.scheme.lower()) if u.port is None else u.port, u.path.rstrip("/")


def routes(url: Column) -> Column:
    """route of a column, as a struct; null for nulls and for what can't be read."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for x in s:
                try:
                    out.append((None,) * 4 if x is None else route(x))
                except ValueError:
                    out.append((None,) * 4)
            yield pd.DataFrame(out, columns=["scheme", "host", "port", "path"]).astype({"port": "Int32"})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, ROUTE)(url)
    return F.when(found["scheme"].isNotNull(), found)


class Gate:
    """Lets `most` calls through in any 60 seconds; a call that is exactly that old has left the window. Callers wait."""

    def __init__(self, most: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if most < 1:
            raise ValueError("requests_per_minute must be positive")
        self.most, self.clock, self.sleep = most, clock, sleep
        self.at: deque[float] = deque()
        self.lock = threading.Lock()

    def wait(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                while self.at and self.at[0] + WINDOW_SECONDS <= now:
                    self.at.popleft()
                if len(self.at) < self.most:
                    self.at.append(now)
                    return
                rest = self.at[0] + WINDOW_SECONDS - now
            self.sleep(rest)


def failure(status: int) -> ModelError | None:
    """The error that an HTTP status stands for; None for success."""
    if 200 <= status < 300:
        return None
    if status in (401, 403):
        return ModelError("MODEL_AUTH_FAILED")
    if status == 429:
        return ModelError("RATE_LIMITED")
    return ModelError("MODEL_UNAVAILABLE", retryable=500 <= status < 600)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """Keys are never sent on to another address."""

    def redirect_request(self, *_):
        return None


class Transport:
    """JSON over HTTP behind a gate; answers over `most_bytes` are refused, not cut."""

    def __init__(self, gate: Gate, timeout_seconds: float = 60, most_bytes: int = MOST_BYTES):
        if timeout_seconds <= 0 or most_bytes <= 0:
            raise ValueError("timeout_seconds and most_bytes must be positive")
        self.gate, self.timeout, self.most = gate, timeout_seconds, most_bytes
        self.opener = urllib.request.build_opener(_NoRedirect)

    def request(self, url: str, headers: dict[str, str], body: Any = None) -> bytes:
        self.gate.wait()
        data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
        try:
            with self.opener.open(urllib.request.Request(url, data, headers), timeout=self.timeout) as r:
                error, got = failure(r.status), r.read(self.most + 1)
        except urllib.error.HTTPError as e:
            error, got = failure(e.code), b""
        except (OSError, ValueError):
            error, got = ModelError("MODEL_UNAVAILABLE"), b""
        if error is not None:
            raise error
        if len(got) > self.most:
            raise ModelError("MODEL_OUTPUT_INVALID")
        return got


def _count(x: Any) -> int:
    if type(x) is not int or x < 0:
        raise ModelError("MODEL_OUTPUT_INVALID")
    return x


class HttpProvider:
    """What the two protocols share: usage is counted before an answer is looked at; whatever isn't of the protocol's form is
    MODEL_OUTPUT_INVALID."""

    def __init__(self, transport: Transport, base: str, model: str, key: str | None = None, most_output: int = 4096):
        u = urlsplit(base)
        if u.scheme not in PORTS or not u.hostname or u.query or u.fragment:
            raise ValueError("a provider's base must be a plain http or https URL")
        self.transport, self.base, self.model, self.key, self.most_output = transport, base.rstrip("/"), model, key, most_output
        self.usage = {"input_tokens": 0, "output_tokens": 0, "request_count": 0}

    def generate(self, system: str, user: str) -> Any:
        try:
            body = loaded(self.transport.request(self.url(), self.headers(), self.payload(system, user)))
            spent, text = self.spent(body["usage"]), lambda: self.text(body)
            for k, n in zip(self.usage, (*spent, 1), strict=True):
                self.usage[k] += n
            return loaded(text())
        except (KeyError, IndexError, TypeError, AttributeError, ValueError):
            raise ModelError("MODEL_OUTPUT_INVALID") from None


class OpenAI(HttpProvider):
    """POST chat/completions, also of servers that speak the same."""

    def url(self) -> str:
        return f"{self.base}/chat/completions"

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})

    def payload(self, system: str, user: str) -> dict:
        said = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return {"model": self.model, "messages": said, "max_tokens": self.most_output, "response_format": {"type": "json_object"}}

    def spent(self, usage: dict) -> tuple[int, int]:
        a, b = _count(usage["prompt_tokens"]), _count(usage["completion_tokens"])
        if _count(usage.get("total_tokens", a + b)) != a + b:
            raise ModelError("MODEL_OUTPUT_INVALID")
        return a, b

    def text(self, body: dict) -> str:
        choice = body["choices"][0]
        if choice["finish_reason"] != "stop":
            raise ModelError("MODEL_OUTPUT_INVALID")
        return choice["message"]["content"]


class Anthropic(HttpProvider):
    """POST v1/messages."""

    def url(self) -> str:
        return f"{self.base}/v1/messages"

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json", "anthropic-version": ANTHROPIC_VERSION} | ({"x-api-key": self.key} if self.key else {})

    def payload(self, system: str, user: str) -> dict:
        return {"model": self.model, "system": system, "messages": [{"role": "user", "content": user}], "max_tokens": self.most_output}

    def spent(self, usage: dict) -> tuple[int, int]:
        return _count(usage["input_tokens"]), _count(usage["output_tokens"])

    def text(self, body: dict) -> str:
        if body["stop_reason"] not in ("end_turn", "stop_sequence"):
            raise ModelError("MODEL_OUTPUT_INVALID")
        return "".join(part["text"] for part in body["content"] if part["type"] == "text")


PROTOCOLS = {"openai": OpenAI, "deepseek": OpenAI, "openai_compatible": OpenAI, "anthropic": Anthropic}
BUILT_IN = {"local", *PROTOCOLS}


class Registry:
    """Providers by name. custom: makers of others, which may not take a built-in one's name (ValueError)."""

    def __init__(self, custom: dict[str, Callable[[], Provider]] | None = None):
        self.custom = dict(custom or {})
        if clash := BUILT_IN & set(self.custom):
            raise ValueError(f"custom providers cannot replace built-in ones: {sorted(clash)}")

    def maker(self, model, key: str | None = None) -> Callable[[], Provider]:
        """Makes the provider of a configuration (config.Model) in a worker, with the worker's share of the requests. A name
        that nobody has is a ValueError."""
        if model.provider in self.custom:
            return self.custom[model.provider]
        if model.provider == "local":
            return LocalProvider
        kind = PROTOCOLS.get(model.provider)
        base = model.base_url or BASES.get(model.provider)
        if kind is None or base is None:
            raise ValueError("model.provider is unknown or needs a base_url")
        each = max(1, model.requests_per_minute // workers(model))
        timeout, name, most = model.timeout_seconds, model.model, model.default_max_output_tokens
        return lambda: kind(Transport(Gate(each), timeout), base, name, key, most)


def workers(model) -> int:
    """How many may ask at once: no more than there are requests a minute."""
    return max(1, min(model.max_concurrency, model.requests_per_minute))


def asking(model) -> int | None:
    """Partitions that a configuration's provider is asked from; None where no request leaves the cluster."""
    return workers(model) if model.provider in PROTOCOLS else None
