"""Calls of injected services: retries, feedback on invalid answers, a breaker.

The service itself (a model, a page fetcher) is the caller's function; these
helpers wrap it for use inside a task, so that each task keeps its own count
of failures and a service that is down stops the job instead of burning
through its input.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

STOP_AFTER = 5


class ServiceDown(RuntimeError):
    pass


def call(
    request: str, service: Callable[[str], str], check: Callable[[str], str | None] = lambda _: None,
    attempts: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep,
) -> str:
    """The service's answer.  An error is tried again, with doubling waits; an
    answer that ``check`` finds fault with is asked for once more, with the
    fault appended to the request."""
    told = False
    for attempt in range(attempts):
        try:
            answer = service(request)
        except Exception:
            if attempt + 1 == attempts:
                raise
            sleep(wait * 2**attempt)
            continue
        fault = check(answer)
        if fault is None:
            return answer
        if told:
            raise ValueError(fault)
        told, request = True, f"{request}\n\nThe last answer was not valid: {fault}"
    raise ValueError("no valid answer")


def answers(
    requests: DataFrame, service: Callable[[str], str | tuple[str, int]], check: Callable[[str], str | None] = lambda _: None,
    stop_after: int = STOP_AFTER, observation: Observation | None = None, **options,
) -> DataFrame:
    """(key, answer, error, calls, tokens) for ``requests`` (key, request): a
    failed row keeps its error and can be asked again; ``stop_after`` failures
    in a row abort.

    A service that counts tokens returns (answer, tokens); all calls of a row
    count, refused answers included.  ``observation`` gets the job's calls,
    tokens and failures when it has run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures = 0
        for batch in batches:
            rows = []
            for key, request in zip(batch["key"], batch["request"]):
                used = [0, 0]

                def counted(text: str) -> str:
                    used[0] += 1
                    got = service(text)
                    answer, tokens = got if isinstance(got, tuple) else (got, 0)
                    used[1] += tokens
                    return answer

                try:
                    rows.append((key, call(request, counted, check, **options), None, *used))
                    failures = 0
                except Exception as error:  # noqa: BLE001 - whatever the service raises is the row's error
                    rows.append((key, None, str(error), *used))
                    failures += 1
                    if failures >= stop_after:
                        raise ServiceDown(f"{failures} failures in a row, the last: {error}") from error
            yield pd.DataFrame(rows, columns=["key", "answer", "error", "calls", "tokens"])

    kind = requests.schema["key"].dataType.simpleString()
    out = requests.select("key", "request").mapInPandas(run, f"key {kind}, answer string, error string, calls long, tokens long")
    if observation is not None:
        out = out.observe(observation, F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.count("error").alias("failures"))
    return out


def usage_rows(answered: DataFrame, provider: str, model: str, prompt_version: str) -> DataFrame:
    """One row of the usage ledger for each row that was answered."""
    return answered.filter("error IS NULL").select(
        "key", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.col("tokens").alias("usage_tokens")
    )


def usage_rollup(ledger: DataFrame, *by: str) -> DataFrame:
    """Rows and tokens of the ledger by provider, model and prompt version, or
    by the columns named."""
    return ledger.groupBy(*(by or ("provider", "model", "prompt_version"))).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("usage_tokens"), F.lit(0)).alias("usage_tokens")
    )
