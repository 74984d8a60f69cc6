"""Answers of a language model as a table: asked through a function that is handed in, checked, with safe failures."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

FAMILIES = ("vida", "propiedad", "robos_violentos", "incivilidades", "vif", "drogas", "armas", "sexuales")
CONFIDENT = 0.6
#: What an answer says that no model gave.
FAILED = "__FAILSAFE_NO_MERGE__"
#: Providers: the variable of the key, and whether they can be told to answer in JSON.
PROVIDERS = {"deepseek": ("DEEPSEEK_API_KEY", True), "openrouter": ("OPENROUTER_API_KEY", False), "minimax": ("MINIMAX_API_KEY", False)}


def provider(environment: Mapping[str, str] = os.environ, variable: str = "NEWS_LLM_PROVIDER", default: str = "openrouter") -> tuple[str, str, bool]:
    """(name, key, answers in JSON) of the provider that the environment names; an error for others or without the key."""
    name = environment.get(variable, default).lower()
    if name not in PROVIDERS:
        raise ValueError(f"{name} isn't one of {sorted(PROVIDERS)}")
    key, plain = PROVIDERS[name]
    if not environment.get(key):
        raise ValueError(f"{key} isn't set")
    return name, environment[key], plain


def leading_value(text: str) -> object:
    """The JSON value at the start of an answer, in a fence or not, whatever comes after it."""
    said = text.strip()
    if said.startswith("```"):
        said = said.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    return json.JSONDecoder().raw_decode(said)[0]


def _checked(answer: str | None) -> tuple | None:
    """(family, commune, region_hint, confidence) of a valid and confident answer."""
    if not answer:
        return None
    try:
        said = leading_value(answer)
        family = "".join(said["family"].split())
        confidence = float(said["confidence"])
        hint = said.get("region_hint")
        commune = said.get("commune_name")
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    if family not in FAMILIES or not CONFIDENT <= confidence <= 1 or not isinstance(commune, str | None):
        return None
    return family, commune, None if hint is None else str(hint), confidence


def classified(rows: DataFrame, key: str, title: str, description: str, ask: Callable[[str], str | None], most: int = 500) -> DataFrame:
    """(key, family, commune, region_hint, confidence) of the rows whose answer is valid and confident enough.

    An empty answer is asked for once more. Of the description the model is told ``most`` characters. ``ask`` fails by
    returning None; nothing that a title says can do more than make its own row's answer invalid.
    """
    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, t, d in zip(rows[key], rows[title], rows[description], strict=True):
                content = f"HEADLINE: {t}\nSUMMARY: {(d or '')[:most]}"
                told = _checked(ask(content) or ask(content))
                if told:
                    out.append((k, *told))
            yield pd.DataFrame(out, columns=[key, "family", "commune", "region_hint", "confidence"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, title, description).mapInPandas(answers, f"{key} {kind}, family string, commune string, region_hint string, confidence double")


def _verdict(answer: str | None) -> tuple:
    """(same_event, confidence, rationale, source)"""
    if answer is None:
        return False, "high", FAILED, "failsafe_api"
    try:
        said = leading_value(answer)
        same, confidence = said["same_event"], said["confidence"]
        if not isinstance(same, bool) or confidence not in ("high", "low") or not isinstance(said["facts"], dict):
            raise ValueError(answer)
        return same, confidence, str(said["rationale"]), "model"
    except (ValueError, KeyError, TypeError):
        return False, "high", FAILED, "failsafe_parse"


def adjudicated(pairs: DataFrame, keys: tuple[str, str], said: str, empty: str, ask: Callable[[str], str | None]) -> DataFrame:
    """(keys, same_event, confidence, rationale, source) of each pair.

    ``said`` is the envelope that the model is asked with. Pairs whose column ``empty`` is true have a title without words:
    they aren't asked about. What fails isn't a merge, and says where it failed.
    """
    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = [_verdict("") if e else _verdict(ask(s)) for s, e in zip(rows[said], rows[empty], strict=True)]
            frame = pd.DataFrame(told, columns=["same_event", "confidence", "rationale", "source"])
            yield pd.concat([rows[list(keys)].reset_index(drop=True), frame], axis=1)

    kinds = dict(pairs.dtypes)
    return pairs.select(*keys, said, empty).mapInPandas(answers, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", same_event boolean, confidence string, rationale string, source string")
