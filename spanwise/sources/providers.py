"""Where model answers come from: stored answers by prompt, or a callable at the edge."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.text import redact

_FIELD = re.compile(r"\{([A-Za-z_]\w*)\}")


def render(template: str, **fields: Column) -> Column:
    """A prompt with each {name} replaced by a column; null fields become ''. Unknown and missing names are an error."""
    names = set(_FIELD.findall(template))
    if names != set(fields):
        raise ValueError(f"the template names {sorted(names)}, given are {sorted(fields)}")
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def chosen_template(named: dict[str, str], choice: str, field: str) -> str:
    """A template by its key, or a text of its own that holds the field."""
    if choice in named:
        return named[choice]
    if "{" + field + "}" in choice:
        return choice
    raise ValueError(f"no template {choice!r}, and no text with {{{field}}}")


def replayed(prompts: DataFrame, stored: DataFrame, key: str = "prompt") -> DataFrame:
    """Prompts with their stored answer, null where there is none; of several the first in order counts."""
    first = stored.groupBy(F.sha2(key, 256).alias("_k")).agg(F.min_by("answer", "at").alias("answer"))
    return prompts.withColumn("_k", F.sha2(key, 256)).join(first, "_k", "left").drop("_k")


def answered(prompts: DataFrame, provider: Callable[[str], str], key: str = "prompt", retries: int = 1, waits: Sequence[float] = ()) -> DataFrame:
    """Prompts with (answer, status) from a callable, called once a row in the tasks; an error leaves the row unanswered.

    The callable must be picklable. Errors are kept in the status with secrets redacted. waits: seconds before each retry, such as (1, 4, 16);
    the last one holds for all later ones.
    """
    names = prompts.columns

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, status = [], []
            for p in pdf[key]:
                answer, why = None, "ok"
                for k in range(retries + 1):
                    try:
                        answer, why = provider(p), "ok" if k == 0 else "ok_after_retry"
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a provider raises belongs to its row
                        why = f"api_error: {e}"
                        if waits and k < retries:
                            time.sleep(waits[min(k, len(waits) - 1)])
                answers.append(answer)
                status.append(why)
            yield pdf.assign(answer=answers, status=status)

    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", answer string, status string"
    return prompts.mapInPandas(call, schema).withColumn("status", redact(F.col("status"))).select(*names, "answer", "status")


class Registry:
    """Providers by name. A factory takes a model's settings and gives a callable from prompt to answer."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[[Mapping], Callable[[str], str]]] = {}

    def register(self, name: str, factory: Callable[[Mapping], Callable[[str], str]]) -> None:
        self._factories[name.lower()] = factory

    def select(self, settings: Mapping, environ: Mapping[str, str] = os.environ) -> Callable[[str], str]:
        """The callable of ``settings["provider"]``; an unknown provider, or one whose key isn't in the environment, is an error."""
        name = str(settings.get("provider", "")).lower()
        if name not in self._factories:
            raise ValueError(f"unsupported provider {name!r}, known are {sorted(self._factories)}")
        variable = (settings.get("env") or {}).get("api_key_var")
        if variable and not environ.get(variable):
            raise ValueError(f"{variable} isn't set")
        return self._factories[name](settings)
