"""Answers that stand as long as the projects they were made from: bounded, least recently used ones go."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable
from typing import Any


class Kept:
    """At most ``most`` answers. ``revision`` names the state of a project, whoever has written to it."""

    def __init__(self, revision: Callable[[str], str], most: int):
        self.revision, self.most = revision, most
        self.answers: OrderedDict[Any, tuple[dict[str, str], Any]] = OrderedDict()

    def __len__(self) -> int:
        return len(self.answers)

    def clear(self) -> None:
        self.answers.clear()

    def get(self, key, project_key: str, make: Callable[[], Any], sources: Callable[[Any], Iterable[str]] = lambda _: ()):
        """The answer kept for ``key`` if its projects stand, else a new one; ``sources``: an answer's other projects."""
        if key in self.answers:
            stamps, answer = self.answers[key]
            if all(self.revision(p) == r for p, r in stamps.items()):
                self.answers.move_to_end(key)
                return answer
            del self.answers[key]
        stamp = self.revision(project_key)  # before reading: a write meanwhile makes the answer stale, not wrong for ever
        answer = make()
        self.answers[key] = {project_key: stamp} | {p: self.revision(p) for p in sources(answer)}, answer
        while len(self.answers) > self.most:
            self.answers.popitem(last=False)
        return answer
