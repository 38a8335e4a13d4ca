"""Translation with any model: units of a document in order, each with its history, retries and checkpoints.

A unit's request holds the translations of the units before it, so a document is one sequence; documents are
independent. Rows are clustered by document and sorted, and every task streams through its documents in one pass, with
the history of one document in memory. Only the model call is Python; units, hints and budgets are columns.

translate(prompt, max_tokens) returns (text, finish_reason). It must be safe to repeat: a task that is lost runs again.
Lines that a checkpoint holds are replayed, not asked for again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import context as X
from .units import translatable

# Statuses of a server that are worth another try.
TRANSIENT = frozenset({408, 409, 425, 429, 500, 502, 503, 504})


class ServiceError(RuntimeError):
    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"model service: {status}")
        self.status, self.retry_after = status, retry_after


class LengthError(RuntimeError):
    """A reply stayed too long for the largest budget."""


@dataclass(frozen=True)
class Settings:
    context_size: int = 65536
    context_units: int = 2
    future_units: int = 2
    context_mode: str = "neighbor"
    retries: int = 5
    target: str = "中文"

    @property
    def mode(self) -> str:
        m = (self.context_mode or "").strip().lower()
        return m if m in ("full", "neighbor", "unit") else "neighbor"


def budget(text: str) -> int:
    return min(80000, max(384, int(X.tokens_of(text) * 2.25) + 384))


def complete(translate: Callable[[str, int], tuple[str, str | None]], prompt: str, first: int, limit: int, retries: int, wait: Callable[[float], None] = time.sleep) -> str:
    """One reply: failures wait and try again, replies cut for length get a larger budget at once.

    Whatever the transport raises is worth another try, except what the service says is final.
    """
    size, tries = min(first, limit), 0
    while True:
        try:
            out, reason = translate(prompt, size)
        except LengthError:
            raise
        except Exception as e:
            tries += 1
            if isinstance(e, ServiceError) and e.status not in TRANSIENT or tries >= retries:
                raise
            after = getattr(e, "retry_after", None)
            wait(min(20.0, 1.5 * 2 ** (tries - 1)) if after is None else min(60.0, max(0.0, after)))
            continue
        if reason != "length":
            return out
        larger = min(limit, max(size + 256, int(size * 1.75)))
        tries += 1
        if larger <= size or tries >= retries:
            raise LengthError(f"the reply is cut at {size} tokens")
        size = larger


def within(texts: Iterable[str], cap: int) -> list[str]:
    """The texts up to the first that no longer fits under the cap: what `context.capped` does to a column."""
    texts = list(texts)
    sums = accumulate(map(X.tokens_of, texts))
    return texts[: sum(1 for _ in takewhile(cap.__ge__, sums))]


def recent(history: list[tuple[str, str]], s: Settings) -> str:
    """The last pairs, newest first while the token cap allows, in reading order."""
    if s.mode == "unit" or not s.context_units:
        return ""
    newest = (f"[原文]\n{source}\n[译文]\n{done}" for source, done in history[: -s.context_units - 1 : -1])
    return "\n\n".join(within(newest, T.context_caps(s.context_size)[0])[::-1])


def coming(pieces: Iterable[str], s: Settings) -> str:
    """The next pieces of the source, whole ones, while the token cap allows."""
    if s.mode == "unit":
        return ""
    worded = islice(filter(None, map(str.strip, pieces)), max(0, s.future_units))
    return "\n\n".join(within(worded, T.context_caps(s.context_size)[1]))


_OUT = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("out", pa.string()), ("resumed", pa.bool_()), ("error", pa.string())])


def translate_units(units: DataFrame, translate: Callable[[str, int], tuple[str, str | None]], settings: Settings | None = None, resume: DataFrame | None = None) -> DataFrame:
    """(file_id, line_no, out, resumed, error) of every translatable unit. An error ends its document, not the task.

    A line that a checkpoint holds twice with different texts is asked for again: nothing tells which was written last.
    """
    s = settings or Settings()
    whole = Window.partitionBy("file_id")
    rows = translatable(units).select("file_id", "line_no", "unit.prefix", "unit.text", "unit.suffix")
    kept = resume.where("text is not null").groupBy("file_id", "line_no").agg(F.when(F.min("text") == F.max("text"), F.max("text")).alias("kept")) if resume is not None else None
    rows = rows.join(kept, ["file_id", "line_no"], "left") if kept is not None else rows.withColumn("kept", F.lit(None).cast("string"))
    worded = T.strip(F.col("text")) != ""
    rows = rows.withColumn("source", T.detected_language(F.col("text"), whole)).withColumn("n", F.count_if(worded).over(whole.orderBy("line_no")))
    # The next texts that have words; blank ones share the number of the one before them.
    future = F.collect_list(F.when(worded, F.col("text"))).over(whole.orderBy("n").rangeBetween(1, s.future_units)) if s.future_units > 0 and s.mode != "unit" else F.array().cast("array<string>")
    rows = rows.withColumn("future", future)
    if s.mode == "full":
        rows = rows.join(X.reference_plan(units, s.context_size, s.context_units, s.future_units), ["file_id", "line_no"], "left")
    else:
        rows = rows.withColumn("reference", F.lit(None).cast("string")).withColumn("kind", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, history, failed, fixed = None, [], None, ("", "")
        split = lru_cache(8)(lambda text: X.sub_units(text, T.unit_limit(s.context_size), X.tokens_of))
        size = T.context_size(s.context_size)
        joiner = "" if s.target in ("中文", "繁体中文", "粤语", "日文", "韩文") else " "
        for batch in batches:
            out = []
            for file_id, line_no, prefix, text, suffix, old, source, future, reference, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if file_id != document:
                    document, history, failed, fixed = file_id, [], None, ("", "")
                if reference is not None:
                    fixed = (reference, kind)
                if failed:
                    out.append((file_id, line_no, None, False, failed))
                    continue
                if old is not None and old.strip():
                    body = old.removeprefix(prefix).removesuffix(suffix).strip() if suffix else old.removeprefix(prefix).strip()
                    if body:
                        history.append((text, body))
                        out.append((file_id, line_no, old, True, None))
                        continue
                parts = []
                local = list(history)
                try:
                    own = split(text)
                    for k, unit in enumerate(own):
                        mode = X.may_continue(local[-1][0], unit) if local else ""
                        before = recent(local, s)
                        if mode and not before:
                            before = "[原文]\n{}\n[译文]\n{}".format(*local[-1])
                        after = "" if fixed[0] else coming(chain(islice(own, k + 1, None), (p for x in future for p in split(x))), s)
                        prompt = X.request(unit, before, after, mode, source, s.target, *fixed)
                        used = sum(map(X.tokens_of, (unit, before, after, "", fixed[0]))) + X.fixed_tokens() + 384
                        room = size - used - 96
                        if room < 256:
                            raise LengthError("the request is too long")
                        first = min(budget(unit), room)
                        most = max(first, size - X.fixed_tokens() - X.tokens_of(prompt) - 128 - 96)
                        done = " ".join(complete(translate, prompt, first, most, s.retries).split("\n")).strip()
                        if not done:
                            raise LengthError("an empty translation")
                        parts.append(done)
                        local.append((unit, done))
                except Exception as e:  # whatever a model raises ends its document, not the task
                    failed = str(e) or type(e).__name__
                    out.append((file_id, line_no, None, False, failed))
                    continue
                body = joiner.join(parts)
                history.append((text, body))
                out.append((file_id, line_no, prefix + body + suffix, False, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    ordered = rows.repartition("file_id").sortWithinPartitions("file_id", "line_no")
    return ordered.select("file_id", "line_no", "prefix", "text", "suffix", "kept", "source", "future", "reference", "kind").mapInArrow(run, "file_id long, line_no int, out string, resumed boolean, error string")


def stub_model(prompt: str, max_tokens: int) -> tuple[str, str | None]:
    """The stand-in of the tests: a mark and the text itself."""
    return "译：" + prompt.rpartition("】\n")[2], "stop"


def flaky(translate: Callable, share: float, seed: int) -> Callable:
    """A model that fails at times, for tests of the retries."""
    rng = random.Random(seed)

    def call(prompt: str, size: int):
        if rng.random() < share:
            raise ServiceError(503, 0.0)
        return translate(prompt, size)

    return call
