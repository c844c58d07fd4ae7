"""Settings of a graph build: defaults, overlays, strict checks."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from loomgraph.operators.extract import MAX_ENTITIES, MAX_RELATIONS
from loomgraph.operators.project import DEFAULT_LIMIT, MAX_LIMIT, check_type_names
from loomgraph.operators.resolve import CANDIDATE, DECISIONS, MERGE, PAIRWISE_LIMIT, TOP_K, check_thresholds

#: Fixed values, as ``normalized_key`` has them: request keys that no extension may set, and parts of names that credentials have.
RESERVED_KEYS = (
    "model", "messages", "tools", "toolchoice", "paralleltoolcalls", "stream", "responseformat", "functions", "functioncall", "authorization", "apikey", "token",
    "password", "secret", "headers", "baseurl", "endpoint",
)
CREDENTIAL_PARTS = ("authorization", "apikey", "token", "password", "secret", "credential")
#: The extensions of a request that there are, and the keys that each may have.
EXTENSIONS = {"chat_template_kwargs": ("thinking", "preserve_thinking")}


@dataclass
class Thresholds:
    candidate: float = CANDIDATE
    merge: float = MERGE


@dataclass
class Retrieval:
    pairwise_limit: int = PAIRWISE_LIMIT
    top_k: int = TOP_K


@dataclass
class Provider:
    """One profile of a model service. ``key_variable`` names the variable that holds its key; the key itself is no setting."""

    url: str = "http://localhost:8000/v1"
    model: str = "model"
    key_variable: str | None = None
    trust_env: bool = False
    timeout_seconds: float = 600.0
    max_output_tokens: int = 16384
    transport: str = "native_tool_call"
    reasoning_policy: str = "require_empty"
    strict: bool = False
    tool_choice: str | None = "required"
    parallel_tool_calls: bool | None = None
    stream: bool | None = False
    temperature: float | None = None
    top_p: float | None = None
    seed: int | None = None
    extensions: dict = field(default_factory=dict)


@dataclass
class Extraction:
    prompt_id: str = "default"
    contract_id: str = "span_semantic_temporal"
    max_concurrency: int = 4
    max_entities: int = MAX_ENTITIES
    max_relations: int = MAX_RELATIONS


@dataclass
class Embedding:
    url: str = "http://localhost:8001/v1"
    model: str = "embedding"
    key_variable: str | None = None
    trust_env: bool = False
    timeout_seconds: float = 120.0


@dataclass
class Runtime:
    """``profiles``: providers by name; ``profile``: the one that is used."""

    profile: str = "default"
    profiles: dict = field(default_factory=lambda: {"default": Provider()})

    @property
    def provider(self) -> Provider:
        return self.profiles[self.profile]


@dataclass
class Store:
    entity_label: str = "FACT_ENTITY"
    relation_type: str = "FACT_RELATION"
    database: str = "graphs"
    browser: str = ""
    uri: str = ""
    limit: int = DEFAULT_LIMIT


@dataclass
class Settings:
    thresholds: Thresholds = field(default_factory=Thresholds)
    retrieval: Retrieval = field(default_factory=Retrieval)
    extraction: Extraction = field(default_factory=Extraction)
    embedding: Embedding = field(default_factory=Embedding)
    runtime: Runtime = field(default_factory=Runtime)
    store: Store = field(default_factory=Store)
    decisions: dict = field(default_factory=lambda: dict(DECISIONS))

    def check(self) -> Settings:
        check_thresholds(self.thresholds.candidate, self.thresholds.merge)
        check_type_names(self.store.entity_label, self.store.relation_type)
        if not 1 <= self.store.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
        if unknown := set(self.decisions) - set(DECISIONS):
            raise ValueError(f"unknown decisions {sorted(unknown)}")
        if self.runtime.profile not in self.runtime.profiles:
            raise ValueError(f"profile {self.runtime.profile!r} is not registered")
        for name, p in self.runtime.profiles.items():
            if p.reasoning_policy not in ("require_empty", "allow_nonempty", "any"):
                raise ValueError(f"profile {name!r}: unknown reasoning policy")
            check_extensions(p.extensions, f"profile {name!r}")
        for n in (self.extraction.max_concurrency, self.extraction.max_entities, self.extraction.max_relations, self.retrieval.pairwise_limit, self.retrieval.top_k):
            if n < 1:
                raise ValueError("counts must be 1 or more")
        return self


def normalized_key(name: str) -> str:
    """Letters and digits of a name, case folded: the form in which names of settings are compared."""
    return "".join(c for c in name.casefold() if c.isalnum())


def check_extensions(extensions: dict, whose: str) -> None:
    """Only the EXTENSIONS and their keys; a reserved or credential-like name is told apart from one that is merely unknown."""
    if not isinstance(extensions, dict):
        raise ValueError(f"{whose}: extensions must be an object")
    named = [(k, EXTENSIONS) for k in extensions]
    for k in extensions.keys() & EXTENSIONS.keys():
        if not isinstance(extensions[k], dict):
            raise ValueError(f"{whose}: {k} must be an object")
        named += [(inner, EXTENSIONS[k]) for inner in extensions[k]]
    plain = {k: normalized_key(str(k)) for k, _ in named}
    if taken := sorted(k for k, n in plain.items() if n in RESERVED_KEYS or any(p in n for p in CREDENTIAL_PARTS)):
        raise ValueError(f"{whose}: extensions must not set {taken}")
    if unknown := sorted(k for k, known in named if k not in known):
        raise ValueError(f"{whose}: unknown extensions {unknown}")


def _put(target, path: str, value) -> None:
    head, _, rest = path.partition(".")
    known = {f.name for f in fields(target)} if is_dataclass(target) else None
    if known is not None and head not in known:
        raise ValueError(f"unknown setting {path!r}")
    if isinstance(target, dict) and isinstance(next(iter(target.values()), None), Provider):
        # A profile that is named for the first time begins with the defaults.
        at = target.setdefault(head, Provider())
        for k, v in ({rest: value} if rest else value).items():
            _put(at, k, v)
    elif rest:
        _put(getattr(target, head) if known is not None else target.setdefault(head, {}), rest, value)
    elif known is not None:
        current = getattr(target, head)
        if is_dataclass(current) or head == "profiles":
            for k, v in value.items():
                _put(current, k, v)
        else:
            setattr(target, head, value)
    else:
        target[head] = value


#: Environment variables that overlay settings: a JSON file with profiles, and the profile to use.
PROFILES_VARIABLE, PROFILE_VARIABLE = "LOOMGRAPH_PROFILES", "LOOMGRAPH_PROFILE"


def load_settings(*overlays: dict | str, overrides: dict | None = None, environment: dict | None = None) -> Settings:
    """Defaults, each overlay in order, the environment's profiles and choice, then dotted-path ``overrides``; unknown names are errors.

    An overlay is a dict, a JSON file, or a folder whose JSON files each hold one section,
    by their names. ``environment`` stands for os.environ.
    """
    out, environment = Settings(), os.environ if environment is None else environment
    given = [x for o in overlays for x in (sections(o) if isinstance(o, str) and os.path.isdir(o) else [o])]
    if environment.get(PROFILES_VARIABLE):
        with open(environment[PROFILES_VARIABLE], encoding="utf-8") as f:
            given.append({"runtime": {"profiles": json.load(f)}})
    if environment.get(PROFILE_VARIABLE):
        given.append({"runtime": {"profile": environment[PROFILE_VARIABLE]}})
    for o in given:
        if isinstance(o, str):
            with open(o, encoding="utf-8") as f:
                o = json.load(f)
        for k, v in o.items():
            _put(out, k, v)
    for k, v in (overrides or {}).items():
        _put(out, k, v)
    return out.check()


def sections(folder: str) -> list[dict]:
    """The sections of a folder of settings: ``thresholds.json`` holds ``thresholds``, and so on."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out.append({name.removesuffix(".json"): json.load(f)})
    return out


def resolved(settings: Settings) -> dict:
    return asdict(settings)
