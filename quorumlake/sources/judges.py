"""Judges: anything that turns cells into votes. None needs a network here; a remote one gets its
transport injected."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bootstrap import hash32
from ..operators.decision import ANSWER, answer_votes
from ..operators.single_call import reply_votes
from ..schema import CANNOT_ASSESS, MET, UNMET, cell_keys

VOTE = "item_idx long, criterion_idx int, judge_id string, verdict string, option_idx int, error string, reason string, confidence double"


class Judge(Protocol):
    def vote(self, cells: DataFrame) -> DataFrame:
        """Votes (VOTE) for cells that have item_idx, criterion_idx and whatever the judge reads."""


@dataclass(frozen=True)
class RuleJudge:
    """Verdicts from Columns over the cells: visible to the optimizer whole."""

    judge_id: str
    verdict: Column | None = None
    option_idx: Column | None = None

    def vote(self, cells: DataFrame) -> DataFrame:
        null = lambda t: F.lit(None).cast(t)
        return cells.select(
            *cell_keys(cells), F.lit(self.judge_id).alias("judge_id"), (null("string") if self.verdict is None else self.verdict).alias("verdict"),
            (null("int") if self.option_idx is None else self.option_idx).cast("int").alias("option_idx"), null("string").alias("error"), null("string").alias("reason"), null("double").alias("confidence"),
        )


@dataclass(frozen=True)
class RecordedJudge:
    """Votes recorded before; a cell that was not recorded fails as infrastructure."""

    judge_id: str
    votes: DataFrame

    def vote(self, cells: DataFrame) -> DataFrame:
        own = self.votes.where(F.col("judge_id") == self.judge_id).select("item_idx", "criterion_idx", "verdict", "option_idx", "error", "reason", "confidence", F.lit(True).alias("_there"))
        joined = cells.select(*cell_keys(cells)).join(own, ["item_idx", "criterion_idx"], "left")
        error = F.when(F.col("_there").isNull(), F.lit("infrastructure: not recorded")).otherwise(F.col("error"))
        return joined.select(*cell_keys(cells), F.lit(self.judge_id).alias("judge_id"), "verdict", "option_idx", error.alias("error"), "reason", "confidence")


@dataclass(frozen=True)
class NoisyJudge:
    """Another judge with some binary votes flipped or withheld, the same in every run."""

    base: Judge
    judge_id: str
    flip: float = 0.2
    abstain: float = 0.05
    seed: int = 0

    def vote(self, cells: DataFrame) -> DataFrame:
        u = hash32(F.concat_ws(":", F.lit(self.seed), F.lit(self.judge_id), "item_idx", "criterion_idx")) / float(1 << 32)
        flipped = F.when(F.col("verdict") == MET, UNMET).when(F.col("verdict") == UNMET, MET).otherwise(F.col("verdict"))
        noisy = F.when(u < self.abstain, CANNOT_ASSESS).when(u < self.abstain + self.flip, flipped).otherwise(F.col("verdict"))
        return self.base.vote(cells).withColumn("judge_id", F.lit(self.judge_id)).withColumn("verdict", F.when(F.col("verdict").isNotNull(), noisy))


class ConfigurationError(Exception):
    """A transport raises this where every call would fail; the job fails with it."""


#: Public client libraries' exceptions by the name of their class.
_INFRASTRUCTURE = ("APIConnectionError", "APITimeoutError", "InternalServerError", "RateLimitError", "ServiceUnavailableError", "Timeout")
_PARSE = ("JSONDecodeError", "ValidationError")
_CONFIGURATION = ("AuthenticationError", "BadRequestError", "NotFoundError", "PermissionDeniedError")


def error_category(e: BaseException) -> str:
    """infrastructure (time-outs, limits and broken connections), parse (bad values), configuration (every
    call would fail) or unknown; an exception is what it or a class above it is."""
    names = {c.__name__ for c in type(e).__mro__}
    if isinstance(e, (ConfigurationError, ImportError, PermissionError)) or names & set(_CONFIGURATION):
        return "configuration"
    if isinstance(e, (TimeoutError, ConnectionError, OSError)) or names & set(_INFRASTRUCTURE):
        return "infrastructure"
    return "parse" if isinstance(e, (ValueError, KeyError, TypeError)) or names & set(_PARSE) else "unknown"


def _as_given(answer) -> dict:
    return answer


@dataclass(frozen=True)
class RemoteJudge:
    """A judge behind ``transport(prompt) -> {"verdict" | "option_idx", "reason", "confidence"}``; ``parse`` may
    turn another form of answer into this one.

    Identical prompts are asked once, failures are retried with doubling pauses, and what fails at last
    is a failed vote. ``concurrency`` bounds the calls at once: ``threads`` of each of as many tasks as that allows; judges
    of one provider in a panel are given a share of its limit each. Calls are paid for, so their
    answers are stored before anything reads them: with ``cache_path``, in that table, where answers not
    older than ``cache_seconds`` are looked up first, by judge and prompt, and new ones are added; failures
    are asked again another time. ``cache`` is a further table (prompt_sha256 and the vote's columns).
    Without ``cache_path`` the answers are computed when they are read, each time.
    """

    judge_id: str
    transport: Callable[[str], dict]
    prompt: Column
    attempts: int = 3
    pause: float = 0.5
    concurrency: int = 8
    threads: int = 4
    cache: DataFrame | None = None
    cache_path: str | None = None
    cache_seconds: int | None = None
    parse: Callable[[object], dict] = _as_given

    def vote(self, cells: DataFrame) -> DataFrame:
        asked = cells.select(*cell_keys(cells), self.prompt.alias("prompt")).withColumn("prompt_sha256", F.sha2("prompt", 256))
        known = self._stored(cells.sparkSession)
        if self.cache is not None:
            kept = self.cache.select("prompt_sha256", "verdict", "option_idx", F.lit(None).cast("string").alias("error"), "reason", "confidence").dropDuplicates(["prompt_sha256"])
            known = kept if known is None else known.unionByName(kept).dropDuplicates(["prompt_sha256"])
        todo = asked if known is None else asked.join(known.select("prompt_sha256"), "prompt_sha256", "left_anti")
        answers = self._called(todo.select("prompt_sha256", "prompt").dropDuplicates(["prompt_sha256"]))
        if self.cache_path is not None:
            new = f"{self.cache_path}/call={uuid.uuid4().hex}"
            answers.withColumns({"judge_id": F.lit(self.judge_id), "at": F.current_timestamp()}).write.parquet(new)
            answers = cells.sparkSession.read.parquet(new).drop("judge_id", "at")
        if known is not None:
            answers = known.unionByName(answers)
        return asked.join(answers, "prompt_sha256").select(
            *cell_keys(cells), F.lit(self.judge_id).alias("judge_id"), "verdict", "option_idx", "error", "reason", "confidence"
        )

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        if self.cache_path is None:
            return None
        try:
            rows = spark.read.parquet(self.cache_path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        rows = rows.where((F.col("judge_id") == self.judge_id) & F.col("error").isNull())
        if self.cache_seconds is not None:
            rows = rows.where(F.col("at") >= F.current_timestamp() - F.make_interval(secs=F.lit(self.cache_seconds)))
        last = F.max_by(F.struct("verdict", "option_idx", "error", "reason", "confidence"), "at").alias("r")
        return rows.groupBy("prompt_sha256").agg(last).select("prompt_sha256", "r.*")

    def _called(self, prompts: DataFrame) -> DataFrame:
        transport, attempts, pause, parse = self.transport, self.attempts, self.pause, self.parse
        threads = max(1, min(self.threads, self.concurrency))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def answer(prompt: str) -> dict:
                for k in range(attempts):
                    try:
                        return parse(transport(prompt))
                    except Exception as e:
                        kind = error_category(e)
                        if kind == "configuration":
                            raise
                        failure = {"error": f"{kind}: {e}"}
                        if k + 1 < attempts:
                            time.sleep(pause * 2**k)
                return failure

            with ThreadPoolExecutor(threads) as pool:  # a call mostly waits
                for pdf in batches:
                    out = [(key, a.get("verdict"), a.get("option_idx"), a.get("error"), a.get("reason"), a.get("confidence"))
                           for key, a in zip(pdf["prompt_sha256"], pool.map(answer, pdf["prompt"]))]
                    yield pd.DataFrame(out, columns=["prompt_sha256", "verdict", "option_idx", "error", "reason", "confidence"]).astype({"option_idx": "Int32"})

        schema = "prompt_sha256 string, verdict string, option_idx int, error string, reason string, confidence double"
        return prompts.repartition(max(1, self.concurrency // threads), "prompt_sha256").mapInPandas(ask, schema)


def _as_reply(text) -> dict:
    return {"reason": text}


@dataclass(frozen=True)
class ItemJudge:
    """A judge that is asked once for an item, about its whole rubric.

    ``prompt`` is over items with what their cells have in common and ``criteria``, the array of their
    criteria; ``transport`` answers with text, and ``read(replies, cells)`` turns replies (item_idx, reply) into
    votes, such as ``read_judgments`` or ``read_answers``. A call that fails, fails all of the item's votes.
    Calls are made and stored as by RemoteJudge, which ``how`` is passed to.
    """

    judge_id: str
    transport: Callable[[str], str]
    prompt: Column
    read: Callable[[DataFrame, DataFrame], DataFrame]
    how: tuple[tuple[str, object], ...] = ()

    def vote(self, cells: DataFrame) -> DataFrame:
        of_criterion = ("criterion_idx", "name", "requirement", "weight", "scale", "aggregation", "options")
        own = F.struct(*[c for c in of_criterion if c in cells.columns])
        shared = [c for c in cells.columns if c not in of_criterion and c != "item_idx"]
        items = cells.groupBy("item_idx").agg(F.sort_array(F.collect_list(own)).alias("criteria"), *[F.first(c).alias(c) for c in shared])
        remote = RemoteJudge(self.judge_id, self.transport, self.prompt, parse=_as_reply, **dict(self.how))
        replies = remote.vote(items.withColumn("criterion_idx", F.lit(0))).select("item_idx", F.col("reason").alias("reply"), F.col("error").alias("_failed"))
        votes = self.read(replies.select("item_idx", "reply"), cells)
        given = lambda c, kind: F.col(c) if c in votes.columns else F.lit(None).cast(kind)
        return votes.join(replies.select("item_idx", "_failed"), "item_idx").select(
            "item_idx", "criterion_idx", F.lit(self.judge_id).alias("judge_id"), "verdict", "option_idx", F.coalesce("_failed", "error").alias("error"),
            given("reason", "string").alias("reason"), given("confidence", "double").alias("confidence"),
        )


def read_judgments(replies: DataFrame, cells: DataFrame) -> DataFrame:
    """Votes from a reply with a judgment for each criterion."""
    return reply_votes(replies, cells.select("item_idx", "criterion_idx", "options"))


def read_answers(replies: DataFrame, cells: DataFrame) -> DataFrame:
    """Votes from a decision model's answers, a JSON list."""
    answers = replies.select("item_idx", F.coalesce(F.from_json("reply", f"array<struct<{ANSWER}>>"), F.array().cast(f"array<struct<{ANSWER}>>")).alias("answers"))
    return answer_votes(answers, cells.select("item_idx", "criterion_idx", "weight", "scale", "options"))


def panel_votes(cells: DataFrame, judges: list[tuple[Judge, float]], role: str = "primary") -> DataFrame:
    """Votes of all judges on all cells, with order, weight and role."""
    out = None
    for k, (judge, weight) in enumerate(judges):
        if not 0 < weight < float("inf"):
            raise ValueError(f"the weight of judge {k} must be positive and finite")
        own = judge.vote(cells)
        if "rubric_id" in cells.columns and "rubric_id" not in own.columns:
            own = own.join(cells.select("item_idx", "criterion_idx", "rubric_id"), ["item_idx", "criterion_idx"])
        own = own.withColumn("judge_ord", F.lit(k)).withColumn("judge_weight", F.lit(float(weight))).withColumn("role", F.lit(role)).withColumn("superseded", F.lit(False))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("a panel needs a judge")
    return out
