"""A conversation with memories: recall for each message, the prompt around them, the history, and what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.facade import MemoryGraph
from quillgraph.operators import chat, fulltext
from quillgraph.operators.search import SearchFilter


class ChatSession:
    """Config: the least length of messages to store (None: none are), memories to recall, and the types to recall
    (none given: all). The history is the conversation alone; memories outlive it."""

    def __init__(self, graph: MemoryGraph, least: int | None = chat.STORE_FROM, recalled: int = chat.RECALL, types: tuple[str, ...] = (), metadata: dict | None = None):
        self.graph, self.least, self.recalled, self.types = graph, least, recalled, types
        self.metadata = {"source": "chat"} if metadata is None else metadata
        self.history: list[dict[str, str]] = []

    def recall(self, query: str, limit: int | None = None) -> DataFrame:
        """The best memories for the words of ``query``, with scores; none if it has no words."""
        limit, found = self.recalled if limit is None else limit, fulltext.plain(query)
        if not found:
            return self.graph.search(SearchFilter(limit=0))
        if not self.types:
            return self.graph.search(SearchFilter(query=found, limit=limit))
        return chat.of_types(self.graph.search(SearchFilter(query=found, limit=-1)), self.types, limit)

    def messages(self, message: str) -> list[dict[str, str]]:
        """What a model is to be sent: the system prompt with memories, the history, and the message."""
        found = self.recall(message).select(F.struct("score", "seq").alias("rank"), "type", "content")
        system = chat.system_prompt(found).first()["prompt"]
        return [{"role": "system", "content": system}, *self.history, {"role": "user", "content": message}]

    def say(self, message: str, model: Callable[[list[dict[str, str]]], str]) -> str:
        """The model's answer; both sides go to the history, and a long enough message to the memories."""
        answer = model(self.messages(message))
        self.append(message, answer)
        return answer

    def append(self, message: str, answer: str) -> None:
        """Add a turn of both sides; an empty side adds nothing."""
        self.history += [{"role": role, "content": text} for role, text in (("user", message), ("assistant", answer)) if text]
        if self.least is not None and message and len(message) >= self.least:
            self.remember(message, metadata=self.metadata)

    def clear(self) -> None:
        """Forget the conversation, not the memories."""
        self.history.clear()

    def remember(self, content: str, **options) -> str:
        return self.graph.store_text(content, **options)

    def forget(self, node_id: str) -> bool:
        """Whether the memory was removed; any failure is False."""
        try:
            return self.graph.forget(node_id)
        except Exception:  # noqa: BLE001  a failure is an answer here
            return False

    def summarize_all(self) -> str:
        return self.graph.summarize()

    def healthy(self) -> bool:
        """Whether the graph is open and can be read."""
        return self.graph.state is not None and self.graph.count() >= 0
