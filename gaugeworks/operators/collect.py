"""Collection: the plan of calls, replay of a budget, a mock provider, pilots."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gaugeworks.functions import hashing, text

#: Statuses that are worth another try, and the pause between tries.
RETRYABLE = frozenset({408, 409, 425, 429, 500, 502, 503, 504, 529})
BACKOFF_BASE, BACKOFF_CAP = 1.5, 60.0
BLIND = ["blind_tags", "blind_notags"]
INSTRUCTION = "Reply with only the letter of your choice, in the form: Answer: X"


class RetryableError(Exception):
    """A failure that isn't stored: the call is planned again."""


class TerminalError(Exception):
    """A failure that is stored."""

    def __init__(self, message: str, reason: str, status: int = 0):
        super().__init__(message)
        self.reason, self.status = reason, status


class StatusError(Exception):
    """A reply with an HTTP status that isn't a success."""

    def __init__(self, status: int, body: str = "", retry_after: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.body, self.retry_after = status, body, retry_after


class ConfigError(Exception):
    """A failure that ends the run."""


def backoff(attempt: int, retry_after: str | None = None, chance: float = 0.5) -> float:
    """Seconds to wait before the next try."""
    try:
        return min(float(retry_after), BACKOFF_CAP) if retry_after else min(BACKOFF_BASE**attempt, BACKOFF_CAP) * (0.5 + chance)
    except ValueError:
        return min(BACKOFF_BASE**attempt, BACKOFF_CAP) * (0.5 + chance)


@dataclass(frozen=True)
class Prompt:
    """A template of system and user text, never changed under its name and version."""

    name: str
    version: str
    system: str
    user: str

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    @property
    def hash(self) -> str:
        return hashlib.sha256("\0".join((self.name, self.version, self.system, self.user)).encode()).hexdigest()

    def render(self, question: Column, options: Column) -> Column:
        """The user text with the question and its options put in."""
        return F.replace(F.replace(F.lit(self.user), F.lit("{question}"), question), F.lit("{options_block}"), options)


USER = "{question}\n\n{options_block}\n\nAnswer:"
PROMPTS = {p.key: p for p in (Prompt("mcq", "v1", "Answer the multiple-choice question. " + INSTRUCTION, USER), Prompt("mcq_blind", "v1", "No image is provided. Answer the multiple-choice question. " + INSTRUCTION, USER))}


def prompt_for(condition: str) -> Prompt:
    return PROMPTS["mcq_blind@v1" if condition in BLIND else "mcq@v1"]


def prompts(questions: DataFrame, condition: str, prompt: Prompt | None = None) -> DataFrame:
    """questions with prompt_key, prompt_system and prompt_user for a condition."""
    own = prompt or prompt_for(condition)
    user = own.render(text.stem_for(F.lit(condition), F.col("stem")), text.options_block(F.col("letters"), F.col("option_texts")))
    return questions.withColumns({"condition": F.lit(condition), "prompt_key": F.lit(own.key), "prompt_system": F.lit(own.system), "prompt_user": user, "prompt_hash": F.lit(own.hash)})


def plan(rendered: DataFrame, cache: DataFrame, model: str, decode: str, seed: int = 0, manifest_hash: Column | None = None, served_by: str = "", quantization: str = "unknown", corruption: str = "", severity: int = 0) -> DataFrame:
    """Calls that the cache has no record of. ``decode`` is the canonical JSON of the settings, as text. All that may change a reply is in
    the key: who serves the model and how it is quantized, the images as they are sent, and the corruption even where no image's hash is given."""
    images = manifest_hash if manifest_hash is not None else F.lit("")
    own = {n: F.col(n) for n in ("question_id", "condition", "prompt_key", "prompt_hash", "prompt_user")}
    key = hashing.cache_key(model=F.lit(model), served_by=F.lit(served_by), quantization=F.lit(quantization), decode=F.lit(decode), seed=F.lit(seed), images=images, corruption=F.lit(corruption), corruption_severity=F.lit(severity), **own)
    return rendered.withColumn("cache_key", key).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def within_budget(calls: DataFrame, max_usd: float, order: str = "seq", cost: str = "usd") -> DataFrame:
    """Calls that run before the spend so far reaches the ceiling: the call that reaches it is the last. The log of one run, which is
    sequential by nature; a run's calls are few beside the rows that are analysed."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(cost, F.lit(0.0))).over(w), F.lit(0.0))
    return calls.withColumn("spent_before", spent).where(F.col("spent_before") < max_usd)


def call(planned: DataFrame, complete: Callable[[dict], dict], schema: str) -> DataFrame:
    """Applies a provider to planned calls, one record each, in one partition so that pacing and a ceiling stay exact.

    Retryable failures give no record, terminal ones a record with status terminal_error; a ConfigError ends the job.
    """

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out.append({**row, "status": "success", **complete(row)})
                except RetryableError:
                    continue
                except TerminalError as e:
                    out.append({**row, "status": "terminal_error", "error_reason": e.reason, "error_message": str(e)[:2000]})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return planned.coalesce(1).mapInArrow(run, schema)


#: Cumulative shares of reply shapes.
SHAPES = [0.18, 0.34, 0.50, 0.66, 0.80, 0.90]


def messy(choice: Column, option: Column, u: Column) -> Column:
    """A reply that means ``choice``, in one of seven shapes by u in [0, 1)."""
    forms = [F.concat(F.lit("Answer: "), choice), choice, F.concat(F.lit("("), choice, F.lit(")")), F.concat(F.lit("The final answer is "), choice, F.lit(".")), F.concat(F.lit("Considering the scene.\n\n"), choice), F.concat(F.lit("<think>maybe A or B</think>\nAnswer: "), choice)]
    out = F.when(u < SHAPES[0], forms[0])
    for edge, form in zip(SHAPES[1:], forms[1:], strict=True):
        out = out.when(u < edge, form)
    return out.otherwise(F.concat(F.lit("I think it will "), option))


def mock_reply(seed: int, fail_rate: float = 0.0, refuse: bool = False) -> Callable[[dict], dict]:
    """A provider that picks an option at random, by the question's id and the seed. A share of calls fails as a busy server does; one that refuses never answers."""

    def complete(row: dict) -> dict:
        r = random.Random(f"{seed}|{row['question_id']}|{row.get('condition')}")
        if r.random() < fail_rate:
            raise RetryableError("mock failure")
        letter = r.choice(row["letters"])
        said = "I cannot help with this." if refuse else r.choice(["Answer: {}", "{}", "({})", "The answer is {}."]).format(letter)
        return {"response_text": said, "served_model": "mock"}

    return complete


def retrying(complete: Callable[[dict], dict], tries: int = 5, pause: Callable[[float], None] = time.sleep, seed: int = 0) -> Callable[[dict], dict]:
    """``complete`` tried again, after ``backoff``, while its failures are worth it; other statuses are terminal, by their reason."""

    def run(row: dict) -> dict:
        chance = random.Random(f"{seed}|{row.get('cache_key')}")
        for attempt in range(1, tries + 1):
            try:
                return {**complete(row), "attempts": attempt}
            except StatusError as e:
                if e.status not in RETRYABLE:
                    raise TerminalError(e.body, f"http_{e.status}", e.status) from e
                if attempt == tries:
                    raise RetryableError(f"status {e.status} after {tries} tries") from e
                pause(backoff(attempt, e.retry_after, chance.random()))
        raise AssertionError

    return run


def counters(records: DataFrame, planned: int, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """One row of what a run did: planned, called, success, terminal_errors, retryable (planned and not stored), tokens and measured_usd."""
    ok = F.col("status") == "success"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast("long")
    found = records.agg(F.count(F.lit(1)).alias("stored"), F.count_if(ok).alias("success"), F.count_if(F.col("status") == "terminal_error").alias("terminal_errors"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"))
    usd = (F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1e6
    return found.select(F.lit(planned).cast("long").alias("planned"), "stored", "success", "terminal_errors", (F.lit(planned) - F.col("stored")).cast("long").alias("retryable"), "prompt_tokens", "completion_tokens", F.round(usd, 8).alias("measured_usd"))


def pacing(calls: DataFrame, start: str, per_minute: float, *keys: str) -> DataFrame:
    """(keys, n_calls, n_too_soon, least_gap): calls that began sooner after the one before than a rate allows, in seconds, from a run's log."""
    gap = F.col(start) - F.lag(start).over(Window.partitionBy(*keys).orderBy(start))
    rows = calls.withColumn("gap", gap)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("gap") < 60.0 / per_minute).alias("n_too_soon"), F.min("gap").alias("least_gap"))


def sampled(questions: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """The first ``n`` questions in the order of a seeded hash of their ids, the same on any cluster; 0 or None: all."""
    if not n:
        return questions
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id")).cast("binary"))
    return questions.orderBy(order, "question_id").limit(n)


def limited(questions: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` questions by id, as for a pilot; 0 or None: all."""
    return questions.orderBy("question_id").limit(n) if n else questions


def served_by(provider: str, base_url: str = "") -> str:
    """Who answers: the provider's name, or the host of its address."""
    return provider if not base_url else re.sub(r"^[a-z]+://", "", base_url).split("/")[0]


def stamp(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX")


def checked_run(n_questions: int | None = None, per_minute: float | None = None, max_usd: float | None = None, price_in: float | None = None, price_out: float | None = None, **decode: object) -> None:
    """Raises where the settings of a run can't be meant."""
    if max_usd is not None and (price_in is None or price_out is None):
        raise ConfigError("a ceiling needs both prices")
    if any(x is not None and x < 0 for x in (n_questions, per_minute, max_usd, price_in, price_out)):
        raise ConfigError("limits and prices can't be negative")
    if (t := decode.get("temperature")) is not None and not 0 <= t <= 2:
        raise ConfigError(f"temperature {t}")
    if (t := decode.get("max_tokens")) is not None and t < 1:
        raise ConfigError(f"max_tokens {t}")


def clean_tree(folder: str) -> str:
    """The commit of ``folder``, if nothing in it has changed since; a run of changed code couldn't be told apart from one of the commit."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    if git("status", "--porcelain"):
        raise ConfigError("the working tree has changes that aren't committed")
    return git("rev-parse", "HEAD")


def receipt(path: str, record: dict, now: float | None = None) -> None:
    """Adds a line about a run to its log, with the time, and has it on disk before it returns."""
    at = time.time() if now is None else now
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"ts": at, "ts_iso": datetime.fromtimestamp(at, UTC).isoformat(timespec="seconds"), **record}, sort_keys=True, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def run(planned: DataFrame, complete: Callable[[dict], dict], cache_path: str, schema: str, per_minute: float | None = None, max_usd: float | None = None, cost: Callable[[dict], float] | None = None, preflight: Callable[[DataFrame], DataFrame] | None = None, log: str | None = None) -> dict:
    """A run: checks what is planned, calls the provider for it one call after another, adds the records to the cache, and tells what it did.

    ``preflight`` gives the planned calls that can't be made; any raises before the first call. Calls stop when ``cost`` of those made has
    reached ``max_usd``, so one call may go over. Calls are sequential, as pacing and the ceiling ask for, and planned ones few.
    """
    if preflight is not None and (bad := preflight(planned).limit(5).collect()):
        raise ConfigError(f"{len(bad)} or more planned calls lack an image: {[r[0] for r in bad]}")
    n = planned.count()

    def paced() -> Callable[[dict], dict]:
        state = {"spent": 0.0, "last": None}

        def one(row: dict) -> dict:
            if max_usd is not None and state["spent"] >= max_usd:
                raise RetryableError("the ceiling is reached")
            if per_minute and state["last"] is not None:
                time.sleep(max(0.0, state["last"] + 60.0 / per_minute - time.monotonic()))
            state["last"] = time.monotonic()
            out = complete(row)
            state["spent"] += cost(out) if cost else 0.0
            return out

        return one

    made = call(planned, paced(), schema).persist()
    try:
        made.write.mode("append").option("ignoreNullFields", "false").json(cache_path)
        by_status = {r["status"]: r["count"] for r in made.groupBy("status").count().collect()}
    finally:
        made.unpersist()
    told = {"planned": n, "success": by_status.get("success", 0), "terminal_errors": by_status.get("terminal_error", 0)}
    told["retryable"] = n - told["success"] - told["terminal_errors"]
    if log:
        receipt(log, told)
    return told


def pilot(records: DataFrame) -> DataFrame:
    """One row about a pilot's records: calls, successes, share with reasoning tokens, tokens, latency."""
    ok = F.col("status") == "success"
    return records.agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(ok).alias("n_success"),
        (F.count_if(ok & F.coalesce("reasoning_tokens_reported", F.lit(False))) / F.nullif(F.count_if(ok), F.lit(0))).alias("reasoning_reported_frac"),
        (F.count_if(ok & ~F.coalesce("valid", F.lit(False))) / F.nullif(F.count_if(ok), F.lit(0))).alias("invalid_rate"),
        F.avg(F.when(ok, F.col("prompt_tokens"))).alias("mean_prompt_tokens"),
        F.avg(F.when(ok, F.col("completion_tokens"))).alias("mean_completion_tokens"),
        F.percentile(F.when(ok, F.col("latency_ms")), F.lit(0.5)).alias("median_latency_ms"),
        F.percentile(F.when(ok, F.col("latency_ms")), F.lit(0.95)).alias("p95_latency_ms"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.nullif("served_model", F.lit(""))))), ",").alias("served_models"),
    )


def determinism(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often two runs gave the same text, over questions that both answered. The last success of a question counts, by ``seq`` where the rows have it."""

    def ok(d: DataFrame, n: str) -> DataFrame:
        good = d.where("status = 'success'")
        if "seq" not in d.columns:
            return good.select("question_id", F.col("response_text").alias(n))
        last = good.groupBy("question_id").agg(F.max_by(F.struct("response_text"), "seq").alias("r"))
        return last.select("question_id", F.col("r.response_text").alias(n))

    both = ok(a, "x").join(ok(b, "y"), "question_id")
    return both.agg(F.count(F.lit(1)).alias("n_compared"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("n_identical"), (F.count_if(F.col("x").eqNullSafe(F.col("y"))) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("identical_frac"))


def differing(a: DataFrame, b: DataFrame, n: int = 5, chars: int = 80) -> DataFrame:
    """(question_id, a, b): the ends of replies that differ, of the first ``n`` questions that do."""
    ok = lambda d, name: d.where("status = 'success'").select("question_id", F.right("response_text", F.lit(chars)).alias(name), F.col("response_text").alias(f"{name}_whole"))
    both = ok(a, "a").join(ok(b, "b"), "question_id").where(~F.col("a_whole").eqNullSafe(F.col("b_whole")))
    return both.select("question_id", "a", "b").orderBy("question_id").limit(n)


def sizing(usd_per_call: float, budget_usd: float, n_models: int, n_conditions: int, halfwidth: float) -> dict:
    """Questions that precision asks for, those that the budget pays for, and which binds. Precision is the widest binomial interval's."""
    wanted = math.ceil(0.25 * (1.96 / halfwidth) ** 2)
    cells = n_models * n_conditions
    out = {"cells": cells, "questions_for_target_precision": wanted}
    if not usd_per_call:
        return out | {"recommended_questions": wanted, "binding_constraint": "precision"}
    calls = int(budget_usd / usd_per_call)
    paid = calls // max(1, cells)
    return out | {"affordable_calls": calls, "questions_at_budget_one_seed": paid, "recommended_questions": min(wanted, paid), "binding_constraint": "budget" if paid < wanted else "precision"}
