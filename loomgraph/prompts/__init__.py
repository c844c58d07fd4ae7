"""Prompt bundles: a template, the guidance that enters it, and one hash over all of it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from importlib import resources

from loomgraph.functions.ids import sha256_json
from loomgraph.operators.extract import RELATION_FAMILIES

PROMPTS = ("default",)
_FIELDS = {"version", "system", "template", "types", "families"}


@dataclass(frozen=True)
class Bundle:
    prompt_id: str
    system: str
    template: str
    types: dict
    families: dict
    content_hash: str

    def render(self, unit_id: str, text: str, spans: list[dict]) -> str:
        """The prompt of one unit; of its spans, only ids and texts enter it."""
        compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        shown = [{"span_id": s["span_id"], "text": s["text"]} for s in spans]
        return self.template.format(unit_id=unit_id, text=text, spans=compact(shown), types=compact(self.types), families=compact(self.families))


def load_bundle(prompt_id: str, content: dict) -> Bundle:
    """A bundle of its parsed file; anything missing, unknown, or a family outside of the contract is an error."""
    if set(content) != _FIELDS:
        raise ValueError(f"a prompt bundle has the fields {sorted(_FIELDS)}")
    if set(content["families"]) != set(RELATION_FAMILIES):
        raise ValueError("a prompt bundle explains exactly the families of the contract")
    return Bundle(prompt_id, content["system"], content["template"], content["types"], content["families"], sha256_json({"prompt_id": prompt_id, **content}))


def resolve_prompt(prompt_id: str = "default") -> Bundle:
    if prompt_id not in PROMPTS:
        raise ValueError(f"unknown prompt {prompt_id!r}")
    return load_bundle(prompt_id, json.loads(resources.files(__name__).joinpath(f"{prompt_id}.json").read_text("utf-8")))
