"""Questions about a data set: a backend asks for tools until it has an answer, within a number of rounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from .guard import Tools

ROUNDS, TURNS = 6, 6


@dataclass(frozen=True)
class Call:
    tool: str
    args: dict


@dataclass(frozen=True)
class Reply:
    """An answer, or calls whose results the backend wants to see first."""

    text: str = ""
    calls: tuple[Call, ...] = ()


@dataclass(frozen=True)
class Event:
    kind: str  # call, result, answer or stopped
    data: dict


class Backend(Protocol):
    def reply(self, messages: list[dict]) -> Reply: ...


@dataclass
class Agent:
    """Keeps the last turns of the conversation: question and answer, not the tools' results."""

    backend: Backend
    tools: Tools
    turns: list[tuple[str, str]] = field(default_factory=list)

    def ask(self, question: str) -> Iterator[Event]:
        """Events as they happen; the last one is the answer, or says that the rounds are used up."""
        messages = [m for q, a in self.turns[-TURNS:] for m in ({"role": "user", "text": q}, {"role": "assistant", "text": a})]
        messages.append({"role": "user", "text": question})
        for _ in range(ROUNDS):
            reply = self.backend.reply(list(messages))
            if not reply.calls:
                self.turns.append((question, reply.text))
                yield Event("answer", {"text": reply.text})
                return
            for call in reply.calls:
                yield Event("call", {"tool": call.tool, "args": call.args})
                result = self.tools.dispatch(call.tool, call.args)
                messages.append({"role": "tool", "tool": call.tool, "result": result})
                yield Event("result", result)
        said = f"no answer within {ROUNDS} rounds"
        self.turns.append((question, said))
        yield Event("stopped", {"text": said})
