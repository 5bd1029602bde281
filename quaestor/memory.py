"""Conversation memory: turns, follow-ups, what they refer to, and the filter they carry on."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from quaestor.functions.columns import STOP_WORDS
from quaestor.nl import vocabulary as V
from quaestor.nl.grammar import has
from quaestor.plans.plan import Filter

MAX_TURNS, MAX_MINUTES = 10, 30
SIMILAR = (0.3, 0.95)
CONFIDENCE = {"failed": 0.3, "found": 0.9, "long": 0.8, "other": 0.6}
_REFERENCE = re.compile(r"(?<!\w)(?:(?:in|of|for|among|from)\s+)?(?:these|those|them|that|this|it|they)(?:\s+(?:records|rows|results|ones|data))?(?!\w)", re.I)


def now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Turn:
    question: str
    answer: str
    timestamp: str
    question_type: str = "unknown"
    entities: list[str] = field(default_factory=list)
    result_count: int = 0
    confidence: float = 0.6
    metadata: dict[str, str] = field(default_factory=dict)
    filters: list[dict] = field(default_factory=list)

    def age(self, at: datetime) -> float:
        return (at - datetime.fromisoformat(self.timestamp)).total_seconds() / 60


def question_type(question: str) -> str:
    return next((t for t, words in V.TURN_TYPES.items() if has(question, words)), "unknown")


def entities(question: str) -> list[str]:
    """Quoted texts, capitalised words after the first, and names with underscores."""
    quoted = [a or b for a, b in re.findall(r"\"([^\"]+)\"|'([^']+)'", question)]
    bare = re.sub(r"\"[^\"]+\"|'[^']+'", " ", question)
    rest = bare.split(None, 1)[1] if len(bare.split(None, 1)) > 1 else ""
    named = re.findall(r"\b[A-Z][A-Za-z0-9]+\b", rest) + re.findall(r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b", bare)
    return list(dict.fromkeys(quoted + named))


def confidence_of(answer: str) -> float:
    low = answer.lower()
    if has(low, ("error", "could not", "not found", "no matches", "no rows match", "can't")):
        return CONFIDENCE["failed"]
    if has(low, ("found", "matches", "records", "rows")):
        return CONFIDENCE["found"]
    return CONFIDENCE["long"] if len(answer) > 100 else CONFIDENCE["other"]


def terms(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", text.lower()) if re.fullmatch(r"[a-z]{2,}", t) and t not in STOP_WORDS]


class Memory:
    """The last turns of a conversation, at most max_turns and max_minutes old; a driver-side list."""

    def __init__(self, max_turns: int = MAX_TURNS, max_minutes: float = MAX_MINUTES, clock: Callable[[], datetime] = now):
        self.max_turns, self.max_minutes, self.clock = max_turns, max_minutes, clock
        self.clear()

    def clear(self) -> None:
        self.turns: list[Turn] = []
        self.mentioned: Counter[str] = Counter()
        self.focus: str | None = None
        self.started = self.clock().isoformat()

    def add(self, question: str, answer: str, filters: tuple[Filter, ...] = (), count: int = 0, **metadata: object) -> Turn:
        found = entities(question)
        kept = [asdict(f) for f in filters]
        turn = Turn(question, answer, self.clock().isoformat(), question_type(question), found, count, confidence_of(answer), {k: str(v) for k, v in metadata.items()}, kept)
        self.mentioned.update(found)
        self.focus = found[-1] if found else self.focus
        self.turns.append(turn)
        self.evict()
        return turn

    def evict(self) -> None:
        at = self.clock()
        self.turns = [t for t in self.turns if t.age(at) <= self.max_minutes][-self.max_turns :]

    # --- follow-ups

    def follow_up(self, question: str) -> str | None:
        """pronoun, continuation or refinement, if there is something to follow."""
        self.evict()
        if not self.turns:
            return None
        if has(question, V.PRONOUNS):
            return "pronoun"
        if has(question, V.CONTINUATION[:-1]) or question.lower().startswith("and "):
            return "continuation"
        if has(question, V.REFINEMENT):
            return "refinement"
        if self.focus and len(self.focus) > 3 and has(question, (self.focus.lower(),)):
            return "continuation"
        return None

    def carried(self, question: str) -> tuple[Filter, ...]:
        """Filters of the latest turn that had any, if the question refers to rows."""
        if not self.turns or not _REFERENCE.search(question):
            return ()
        last = next((t for t in reversed(self.turns) if t.filters), None)
        return tuple(Filter(**f) for f in last.filters) if last else ()

    def resolved(self, question: str) -> str:
        """The question without its reference to earlier rows, which the carried filters stand for."""
        return re.sub(r"\s{2,}", " ", re.sub(r"(?<!\w)(?:in|of|for|among|from)\s+(?:these|those|them|that|this|it)(?:\s+(?:records|rows|results|ones|data))?(?!\w)", "", question, flags=re.I)).strip()

    # --- what is relevant

    def _vectors(self, texts: list[str]) -> list[dict[str, float]]:
        """TF-IDF over the stored turns; words that none has are skipped."""
        held = [set(terms(t.question)) for t in self.turns]
        df = Counter(x for s in held for x in s)
        out = []
        for text in texts:
            words = terms(text)
            out.append({w: n / len(words) * (math.log((1 + len(held)) / (1 + df[w])) + 1) for w, n in Counter(words).items() if df[w]})
        return out

    def similar(self, question: str, low: float = SIMILAR[0], high: float = SIMILAR[1]) -> list[tuple[float, Turn]]:
        if len(self.turns) < 2:
            return []
        asked, *stored = self._vectors([question, *[t.question for t in self.turns]])
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        out = []
        for turn, v in zip(self.turns, stored):
            size = norm(asked) * norm(v)
            score = sum(x * v.get(w, 0) for w, x in asked.items()) / size if size else 0.0
            if low < score < high:
                out.append((score, turn))
        return sorted(out, key=lambda x: -x[0])

    def relevance(self, turn: Turn, question: str) -> float:
        asked = set(entities(question))
        overlap = len(asked & set(turn.entities)) / len(asked) if asked else 0.0
        bonus = turn.question_type in ("filter", "lookup") and has(question, ("where", "show", "find", "get", "list"))
        return 0.3 * max(0.0, 1 - turn.age(self.clock()) / self.max_minutes) + 0.2 * turn.confidence + 0.3 * overlap + 0.2 * bonus

    def relevant(self, question: str, k: int = 3) -> list[Turn]:
        """Latest turns, turns about the same things, similar ones and the one followed up; the k most relevant."""
        asked = set(entities(question))
        chosen = self.turns[-2:] + [t for t in self.turns if asked & set(t.entities)] + [t for _, t in self.similar(question)]
        unique = list({id(t): t for t in chosen}.values())
        return sorted(unique, key=lambda t: -self.relevance(t, question))[:k]

    # --- summaries and files

    def summary(self) -> dict:
        return {
            "turns": len(self.turns), "types": dict(Counter(t.question_type for t in self.turns)), "entities": dict(self.mentioned.most_common(5)),
            "focus": self.focus, "started": self.started,
        }

    def text(self) -> str:
        return "\n\n".join(f"Q: {t.question}\nA: {t.answer}" for t in self.turns)

    def export(self, path: str) -> None:
        """Questions and answers as plain text."""
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.text() + "\n")

    def save(self, path: str) -> None:
        # The keys of history files.
        body = {"session_start": self.started, "current_focus": self.focus, "mentioned_entities": dict(self.mentioned), "conversation_history": [asdict(t) for t in self.turns]}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(body, f, ensure_ascii=False, indent=1)

    def load(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        self.started, self.focus = body["session_start"], body["current_focus"]
        self.mentioned = Counter(body["mentioned_entities"])
        self.turns = [Turn(**t) for t in body["conversation_history"]]
