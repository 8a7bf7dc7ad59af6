"""Transports for ``judgment.judge`` over HTTP, by the standard library alone, and a probe of a model server."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from foliant.operators.judgment import MAX_TOKENS, Transport

#: Bounds of the context that is asked for, and the characters that a token is reckoned at (fixed values).
LEAST_CONTEXT, MOST_CONTEXT, TOKEN_CHARS = 8192, 40_960, 3


def _call(url: str, body: dict | None, timeout: float) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:
        return json.loads(answer.read())


def context_size(messages: list[dict], tokens: int) -> int:
    """A context that holds the messages and the answer, within bounds; a server's small default would cut the prompt unseen."""
    asked = sum(len(m.get("content", "")) for m in messages) // TOKEN_CHARS
    return min(MOST_CONTEXT, max(LEAST_CONTEXT, asked + tokens + 1024))


def native(base_url: str, model: str, think: bool = False, form: str | dict = "json", context: int | None = None, timeout: float = 180) -> Transport:
    """Calls the server's own chat address (/api/chat beside /v1), which heeds ``think`` and a schema as ``form``."""
    url = base_url.split("/v1")[0].rstrip("/") + "/api/chat"

    def call(messages: list[dict], tokens: int):
        size = context or context_size(messages, tokens)
        got = _call(url, {"model": model, "messages": messages, "stream": False, "think": think, "format": form, "options": {"temperature": 0, "num_predict": tokens, "num_ctx": size}}, timeout)
        asked, said = got.get("prompt_eval_count"), got.get("eval_count")
        usage = {"prompt_tokens": asked, "completion_tokens": said, "total_tokens": (asked or 0) + (said or 0)}
        return (got.get("message") or {}).get("content", ""), got.get("done_reason"), usage, got.get("model"), url

    return call


def compatible(base_url: str, model: str, think: bool = False, timeout: float = 180) -> Transport:
    """Calls /chat/completions of servers that follow that convention."""
    url = f"{base_url.rstrip('/')}/chat/completions"
    extra = {} if think else {"chat_template_kwargs": {"enable_thinking": False}}

    def call(messages: list[dict], tokens: int):
        got = _call(url, {"model": model, "messages": messages, "stream": False, "temperature": 0, "max_tokens": tokens, **extra}, timeout)
        choice = (got.get("choices") or [{}])[0]
        return (choice.get("message") or {}).get("content", ""), choice.get("finish_reason"), got.get("usage", {}), got.get("model"), url

    return call


def with_fallback(first: Transport, second: Transport, errors: tuple = (OSError, ValueError)) -> Transport:
    """The first transport until it fails once, then the second for good. Errors of HTTP and of unreadable bodies are among ``errors``."""
    use: list[Callable] = [first, second]

    def call(messages: list[dict], tokens: int = MAX_TOKENS):
        if len(use) == 2:
            try:
                return use[0](messages, tokens)
            except errors:
                use.pop(0)
        return use[0](messages, tokens)

    return call


def probe(base_url: str, model: str, timeout: float = 20) -> dict:
    """What a server offers and whether it answers: reachable, models_available, chat_ok, sample_reply, latency; errors as texts."""
    found: dict = {"base_url": base_url, "model_configured": model, "reachable": False}
    try:
        listed = _call(f"{base_url.rstrip('/')}/models", None, min(timeout, 5))
        found |= {"models_available": [x.get("id") for x in listed.get("data", [])], "reachable": True}
    except (OSError, ValueError) as e:
        return found | {"error": str(e)}
    began = time.time()
    try:
        content, _, usage, served, _ = compatible(base_url, model, think=True, timeout=timeout)([{"role": "user", "content": "Say pong."}], 16)
    except (OSError, ValueError) as e:
        return found | {"chat_ok": False, "chat_error": str(e)}
    return found | {"model_reported": served, "sample_reply": content.strip()[:80], "usage": usage, "latency_ms": round(1000 * (time.time() - began)), "chat_ok": True}
