"""Language and embedding models: what the engine needs of them, offline ones, and ones behind HTTP."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

from quaestor.errors import ModelConnectionError, ModelError, ModelNotFoundError, ModelResponseError, ModelTimeoutError


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def ask(self, question: str, context: str) -> str: ...

    def ask_stream(self, question: str, context: str) -> Iterator[str]: ...

    def plan(self, question: str, card: str) -> dict | None: ...

    def steps(self, question: str, card: str) -> dict | None: ...


class HashingEmbedder:
    """Words and their character triples hashed to signed slots, at unit length. The same on every machine."""

    def __init__(self, size: int = 256):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.size
        for word in re.findall(r"\w+", text.lower()):
            for piece, weight in [(word, 1.0), *((f"{word[i : i + 3]}#", 0.3) for i in range(len(word) - 2))]:
                h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
                out[h % self.size] += weight if h >> 63 else -weight
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class OfflineModel:
    """Answers with the context's lines that share most words with the question; plans nothing."""

    def ask(self, question: str, context: str) -> str:
        asked = set(re.findall(r"\w{3,}", question.lower()))
        lines = [x.strip() for x in context.splitlines() if x.strip()]
        best = sorted(range(len(lines)), key=lambda i: (-len(asked & set(re.findall(r"\w{3,}", lines[i].lower()))), i))[:5]
        held = [lines[i] for i in sorted(best) if asked & set(re.findall(r"\w{3,}", lines[i].lower()))]
        return "From the data:\n" + "\n".join(held) if held else "The data doesn't say."

    def ask_stream(self, question: str, context: str) -> Iterator[str]:
        for word in re.findall(r"\S+\s*", self.ask(question, context)):
            yield word

    def plan(self, question: str, card: str) -> dict | None:
        return None

    def steps(self, question: str, card: str) -> dict | None:
        return None


def finished(text: str) -> bool:
    """Whether an answer is whole. At least ten characters, with an end mark."""
    return len(text.strip()) >= 10 and text.strip().endswith((".", "?", "!"))


class Told:
    """A model whose answers are also told piece by piece as they come. ``tell`` may raise to end an answer."""

    def __init__(self, model: LanguageModel, tell: Callable[[str], None]):
        self._model, self._tell = model, tell

    def __getattr__(self, name: str):
        return getattr(self._model, name)

    def ask(self, question: str, context: str) -> str:
        pieces = []
        for piece in self._model.ask_stream(question, context):
            self._tell(piece)
            pieces.append(piece)
        return "".join(pieces)


def retried(call: Callable[[], dict], attempts: int = 3, first: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """call(), again after first * 2 ** n seconds and up to half a second more while the service is unreachable, busy or failing."""
    for n in range(attempts):
        try:
            return call()
        except ModelError as error:
            if n == attempts - 1 or not error.details.get("again"):
                raise
        sleep(first * 2**n + random.uniform(0, 0.5))
    raise AssertionError("unreachable")


def joined_reply(text: str) -> dict:
    """A reply's JSON object; of several, one to a line, the last with the ``response`` of all."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    parts = []
    for line in text.splitlines():
        try:
            found = json.loads(line)
        except ValueError:
            continue
        parts += [found] if isinstance(found, dict) else []
    if not parts:
        raise ModelResponseError("the reply is no JSON")
    return parts[-1] | {"response": "".join(str(p.get("response", "")) for p in parts)}


class HttpService:
    """JSON over HTTP. The base URL is an argument, or the environment variable QUAESTOR_MODEL_URL."""

    def __init__(self, url: str | None = None):
        self.url = (url or os.environ.get("QUAESTOR_MODEL_URL", "http://localhost:11434")).rstrip("/")

    def open(self, path: str, body: dict | None, timeout: float):
        data = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        try:
            return urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as error:
            if error.code == 404:
                raise ModelNotFoundError("no such model", body=body) from error
            raise ModelResponseError(f"status {error.code}", again=error.code == 429 or error.code >= 500) from error
        except TimeoutError as error:
            raise ModelTimeoutError(f"no answer in {timeout} s", again=True) from error
        except OSError as error:
            raise ModelConnectionError(f"{self.url} can't be reached", again=True) from error

    def call(self, path: str, body: dict | None, timeout: float) -> dict:
        def once() -> dict:
            with self.open(path, body, timeout) as reply:
                return joined_reply(reply.read().decode("utf-8", "replace"))

        return retried(once)

    def models(self) -> list[str]:
        return [m["name"] for m in self.call("/api/tags", None, 30).get("models", [])]

    def pull(self, name: str) -> Iterator[dict]:
        with self.open("/api/pull", {"name": name}, 3600) as reply:
            for line in reply:
                yield json.loads(line)


class HttpEmbedder:
    def __init__(self, model: str, service: HttpService | None = None):
        self.model, self.service = model, service or HttpService()

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = self.service.call("/api/embed", {"model": self.model, "input": texts}, 120).get("embeddings")
        if not found or len(found) != len(texts):
            raise ModelResponseError("no embedding for each text")
        return found


class HttpModel:
    """A model that generates text, asked for answers and for plans as JSON."""

    PLAN = 'Reply with one JSON object: {"operation": "list|filter|count|aggregate|summarize|distinct", "columns": [name or {"column", "operation"}], "filters": [{"column", "operator", "value"}], "groupby": [], "sort": [{"column", "order"}], "limit": number or null}'
    STEPS = 'Reply with one JSON object: {"steps": [{"operation": "filter|analyze|list", "type": "keyword_search|compound_search|keyword_search_exclude|column_filter", "keyword": "", "keywords": [], "logical_operator": "or|and", "column": "", "value": "", "target": ""}]}'

    def __init__(self, model: str, service: HttpService | None = None):
        self.model, self.service = model, service or HttpService()

    def _generate(self, prompt: str, timeout: float) -> str:
        reply = self.service.call("/api/generate", {"model": self.model, "prompt": prompt, "stream": False}, timeout)
        if "response" not in reply:
            raise ModelResponseError("the reply has no response")
        return reply["response"].strip()

    def ask(self, question: str, context: str) -> str:
        text = self._generate(f"Answer from this data only.\n\n{context}\n\nQuestion: {question}", 60)
        return text if finished(text) else OfflineModel().ask(question, context)

    def ask_stream(self, question: str, context: str) -> Iterator[str]:
        """The answer as it comes; what the data says follows an answer that breaks off."""
        told = ""
        for piece in self._streamed(question, context):
            told += piece
            yield piece
        if not finished(told):
            yield ("\n" if told else "") + OfflineModel().ask(question, context)

    def _streamed(self, question: str, context: str) -> Iterator[str]:
        body = {"model": self.model, "prompt": f"Answer from this data only.\n\n{context}\n\nQuestion: {question}", "stream": True}
        with self.service.open("/api/generate", body, 60) as reply:
            for line in reply:
                yield json.loads(line).get("response", "")

    def plan(self, question: str, card: str) -> dict | None:
        from quaestor.plans.plan import parse_json

        return parse_json(self._generate(f"{self.PLAN}\n\n{card}\n\nQuestion: {question}", 30))

    def steps(self, question: str, card: str) -> dict | None:
        from quaestor.plans.plan import parse_json

        return parse_json(self._generate(f"{self.STEPS}\n\n{card}\n\nQuestion: {question}", 30))


def grounding(answer: str, context: str) -> float:
    """How far an answer's words and numbers stand in the context. 0.4, and up to 0.4 for words and 0.2 for numbers; 0 for no answer, 0.3 for one that says it doesn't know, 0.2 for one under 15 characters."""
    text = answer.strip().lower()
    if not text:
        return 0.0
    if "doesn't say" in text:
        return 0.3
    if len(text) < 15:
        return 0.2
    held = context.lower()
    words, numbers = re.findall(r"[^\W\d_]{4,}", text), re.findall(r"\d+(?:\.\d+)?", text)
    if not words:
        return 0.4
    of_words = sum(w in held for w in words) / len(words)
    of_numbers = sum(n in held for n in numbers) / len(numbers) if numbers else 1.0
    return 0.4 + 0.4 * of_words + 0.2 * of_numbers


def structured_confidence(question: str, answer: str, rows: int) -> float:
    """0.9, less for no rows (0.7) and for a text under 20 characters (0.8), more (1.1) for questions of plain commands; at most 1."""
    score = 0.9 * (1.0 if rows else 0.7) * (0.8 if len(answer) < 20 else 1.0)
    return min(1.0, score * (1.1 if any(w in question.lower() for w in ("max", "min", "count", "show")) else 1.0))


def semantic_confidence(answer: str, columns: list[str]) -> float:
    """0.7, more for digits (0.1), columns named (0.05 each) and words of measures (0.1), half for an answer that has none; at most 1."""
    low = answer.lower()
    score = 0.7 + 0.1 * any(c.isdigit() for c in low) + 0.05 * sum(c.lower() in low for c in columns)
    if any(p in low for p in ("doesn't say", "i don't have", "cannot determine", "not enough information")):
        score *= 0.5
    return min(1.0, score + 0.1 * any(w in low for w in ("statistics", "average", "maximum", "minimum", "records")))
