"""Services by name: model names, settings merged over defaults, keys looked up, and tasks routed to what is available."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliogrid.functions.text import literal

#: Names that stand for others, and names to show.
ALIASES = {"deepseek-chat": "deepseek/deepseek-v4-flash", "deepseek/deepseek-chat": "deepseek/deepseek-v4-flash"}
SHOWN = {"deepseek/deepseek-v4-flash": "DeepSeek v4 Flash", "deepseek/deepseek-v4-pro": "DeepSeek v4 Pro", "openai/gpt-4o": "GPT-4o", "qwen/qwen-plus": "Qwen Plus", "glm-4": "GLM-4", "moonshot-v1-8k": "Moonshot v1 8K"}
PREFIXED = "deepseek"
#: Tasks that prefer the reasoning service, and the strategy of tasks without one.
REASONING, DEFAULT = ("qa", "summarization"), "local_first"


def model_name(x: str) -> str:
    """A model's full name, as SQL."""
    t = f"trim(coalesce({x}, ''))"
    known = " ".join(f"when lower({t}) = {literal(a)} then {literal(b)}" for a, b in ALIASES.items())
    return f"case {known} when {t} = '' or contains({t}, '/') then {t} when startswith(lower({t}), '{PREFIXED}') then concat('{PREFIXED}/', {t}) else {t} end"


def family(x: str) -> str:
    """The provider that a model's keys are shared by, as SQL."""
    n = model_name(x)
    return f"if(contains({n}, '/'), split_part({n}, '/', 1), split_part({n}, '-', 1))"


def shown_name(x: str) -> str:
    n = model_name(x)
    listed = " ".join(f"when {literal(a)} then {literal(b)}" for a, b in SHOWN.items())
    return f"case {n} {listed} when '' then 'Mock' else if(contains({n}, '/'), substring({n}, instr({n}, '/') + 1), {n}) end"


def key_names(x: str) -> str:
    """Names of the variables that may hold a model's key, as an array: by the name given, the full one and the family."""
    token = lambda v: f"trim(both '_' from regexp_replace(upper({v}), '[^A-Z0-9]+', '_'))"
    return f"transform(array_distinct(filter(array({token(f'trim(coalesce({x}, {literal("")}))')}, {token(model_name(x))}, {token(family(x))}), t -> t <> '')), t -> concat(t, '_API_KEY'))"


def merged(base: Mapping, changes: Mapping) -> dict:
    """Settings with changes in them: mappings go together key by key, other values replace."""
    out = dict(base)
    for key, value in changes.items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), Mapping) and isinstance(value, Mapping) else value
    return out


def _full(name: str) -> str:
    t = (name or "").strip()
    return ALIASES.get(t.lower(), f"{PREFIXED}/{t}" if t and "/" not in t and t.lower().startswith(PREFIXED) else t)


def _family(name: str) -> str:
    return re.split("/" if "/" in (full := _full(name)) else "-", full, maxsplit=1)[0]


def api_key(name: str, keys: Mapping[str, str], environment: Mapping[str, str] | None = None) -> str | None:
    """A provider's key: by name, full name or family, by another of its family, else from the environment."""
    full, kin = _full(name), _family(name)
    for k in ((name or "").strip(), full, kin):
        if k and k in keys:
            return keys[k]
    if kin:
        for k, v in keys.items():
            if _family(k) == kin:
                return v
    environment = os.environ if environment is None else environment
    tokens = (re.sub(r"[^A-Za-z0-9]+", "_", x).strip("_").upper() for x in ((name or "").strip(), full, kin))
    return next((environment[f"{t}_API_KEY"] for t in tokens if t and environment.get(f"{t}_API_KEY")), None)


def route(task: str, strategy: str, local: str, cloud: str, reasoning: str, fallback: str) -> str:
    """Which service takes a task, or null if none can; the last four are columns that tell whether a service is there."""
    up = lambda c: f"coalesce({c}, false)"
    thinks = f"{task} in ({', '.join(repr(t) for t in REASONING)})"
    clouds = f"when {thinks} and {up(reasoning)} then 'reasoning' when {up(cloud)} then 'cloud' when {up(reasoning)} then 'reasoning' when {up(fallback)} then 'fallback' end"
    return f"""case when {task} = 'embedding' then case when {up(local)} then 'local' when {up(cloud)} then 'cloud' end
      when {strategy} = 'local_only' then if({up(local)}, 'local', null)
      when {strategy} = 'cloud_only' then case {clouds}
      else case when {up(local)} then 'local' {clouds} end"""


def iso_now() -> Column:
    """The time as a job's record has it: UTC, to the microsecond, with its offset."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
