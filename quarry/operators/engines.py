"""Engines from injected functions: a provider's call behind a prompt, and a converter before another engine."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from quarry.functions.payload import payload_of
from quarry.operators.extraction import settled
from quarry.operators.routing import ROSTER, Engine

#: Keys of a provider's payload that belong to a result's metadata.
TOLD = ("usage", "cost", "route")


#: The wordings of the prompt for a text and for a document.
PROMPTS = {
    "source text": "Extract structured data from the source text. Return only JSON that conforms to this JSON Schema.\n\nSchema:\n{schema}\n\nSource text:\n{text}",
    "document": "Extract structured data from the document. Return only JSON that conforms to this JSON Schema.\n\nSchema:\n{schema}\n\nDocument:\n{text}",
}


def extraction_prompt(text: str, schema: Mapping[str, Any], source: str = "source text") -> str:
    """What a text model is asked: to answer with JSON of the schema alone; source is one of PROMPTS."""
    return PROMPTS[source].format(schema=json.dumps(schema, ensure_ascii=False), text=text)


def completion_prompt(text: str, schema: Mapping[str, Any]) -> str:
    """What a model that completes text is given. The wording is a fixed value."""
    return f"Extract the document into JSON matching this schema.\nSchema:\n{schema}\n\nDocument:\n{text}\n\nJSON:"


def message_prompt(text: str, schema: Mapping[str, Any]) -> list[dict[str, str]]:
    """The one message that a chat model with typed answers is sent. The wording is a fixed value."""
    return [{"role": "user", "content": f"Extract JSON conforming to this schema:\n{schema}\n\nDocument:\n{text}"}]


def questions(schema: Mapping[str, Any]) -> list[dict[str, str]]:
    """A question a property, with its name as alias."""
    return [{"Text": f"What is the {name}?", "Alias": name} for name in schema.get("properties", {})]


def dumped(value: Any) -> Any:
    """What an object's model_dump gives, if that is a dict; else the value."""
    plain = value.model_dump() if hasattr(value, "model_dump") else value
    return plain if isinstance(plain, dict) else value


def provider_engine(provider_call: Callable[..., Any] | None, provider: str = "default", model: str = "default", prompt_builder: Callable[..., str] | None = None, name: str = "provider_router", **options: Any) -> Engine:
    """An engine that asks provider_call(provider=, model=, schema=, text=, prompt=, **options), plain or awaitable.

    The answer, dict, list, JSON text or an object with model_dump, is the
    payload as it is; metadata gets provider and model, then the payload's own
    metadata, then usage, cost and route, later keys winning.
    """

    def run(text: str, schema: dict) -> dict:
        told = {"text": text, "schema": schema, "provider": provider, "model": model}
        prompt = prompt_builder(**told, **options) if prompt_builder else extraction_prompt(text, schema)
        answer = dumped(settled(provider_call(**told, prompt=prompt, **options)))
        if not isinstance(answer, dict):
            return {"data": payload_of(answer) if isinstance(answer, str) else answer, "metadata": {"provider": provider, "model": model}}
        own = answer["metadata"] if isinstance(answer.get("metadata"), dict) else {}
        return answer | {"metadata": {"provider": provider, "model": model} | own | {k: answer[k] for k in TOLD if k in answer}}

    extensions, capabilities = ROSTER["provider_router"]
    return Engine(name, extensions, run, provider_call is not None, dict(capabilities))


def composite_engine(convert: Callable[[str], Any] | None, inner: Engine, converter: str = "auto", name: str = "converted_llm") -> Engine:
    """An engine that turns a document into text by convert, plain or awaitable, and leaves the rest to inner; metadata says so."""

    def run(document: str, schema: dict) -> dict:
        content = str(settled(convert(document)))
        found = dumped(settled(inner.run(content, schema)))
        found = found if isinstance(found, dict) else {"data": found}
        own = found["metadata"] if isinstance(found.get("metadata"), dict) else {}
        return found | {"metadata": own | {"converter": converter, "content_length": len(content), "llm_engine": inner.name}}

    extensions, capabilities = ROSTER["converted_llm"]
    return Engine(name, extensions, run, lambda: convert is not None and inner.ready(), dict(capabilities))
