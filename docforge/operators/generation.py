"""Answers from prompts: generators are functions registered by their users; an offline one is here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: From a prompt to its answer; raises an error where there is none.
Generator = Callable[[str], str | None]
GENERATORS: dict[str, Generator] = {}


def register_generator(name: str, generator: Generator) -> None:
    """Clients of language models are not part of this repository; each is registered by its user."""
    GENERATORS[name] = generator


def last_line(prompt: str) -> str | None:
    """The offline generator: the prompt's last line that is not blank."""
    return next((line.strip() for line in reversed(prompt.split("\n")) if line.strip()), None)


register_generator("offline", last_line)


def generated(prompts: DataFrame, generator: str | Generator, key: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """(key, prompt, answer, execution_error): the prompt stays beside its answer, and an error is a row too. A null prompt has no answer."""
    answer = GENERATORS[generator] if isinstance(generator, str) else generator

    def one(text: object) -> tuple[str | None, str | None]:
        if not isinstance(text, str):
            return None, None
        try:
            return answer(text), None
        except Exception as e:  # noqa: BLE001  one failed call is a row with its error
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [one(text) for text in pdf[prompt]]
            yield pdf.assign(answer=[a for a, _ in told], execution_error=[e for _, e in told])

    rows = prompts.select(key, prompt)
    kind = dict(rows.dtypes)[key]
    return rows.mapInPandas(run, f"`{key}` {kind}, `{prompt}` string, answer string, execution_error string")
