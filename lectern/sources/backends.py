"""Model calls as tables: a prompt table goes in, a reply table comes out and is kept, everything after it is deterministic.

Backends are small picklable objects with `reply(role, prompt, schema) -> str`, or `send` for one attempt (see `calls`). The heuristic backend is for
demonstrations and tests only: what it says is NOT equivalent to a language model's answer.

Defined cases: a null prompt is asked as an empty one; a null reply is kept as null; rows that share a call_id are separate calls; an empty
prompt table makes no call and gives no replies.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .calls import Backend, Caller, Policy, Unreachable, caller, pooled

REPLIES = "call_id string, role string, reply string, error string, attempts int, seconds double"


@dataclass
class ReplayBackend:
    """Recorded replies by the SHA-1 of their prompt; what was never recorded is an error row."""

    recorded: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def key(prompt: str) -> str:
        return hashlib.sha1(prompt.encode()).hexdigest()

    def reply(self, role: str, prompt: str, schema: str | None = None) -> str:
        return self.recorded[self.key(prompt)]


@dataclass
class HttpBackend:
    """A JSON-over-HTTP text model. Time-outs, attempts and decoding settings come from the role's policy."""

    url: str
    model: str
    options: dict = field(default_factory=dict)  # added to, or in place of, the policy's decoding settings

    def send(self, role: str, prompt: str, schema: str | None, policy: Policy) -> str:
        """One attempt; OSError where the server cannot be reached or takes too long."""
        options = {"temperature": policy.temperature, "num_ctx": policy.context} | self.options
        body = {"model": self.model, "prompt": prompt, "stream": False, "think": policy.think, "options": options, "format": json.loads(schema) if schema else "json"}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=policy.timeout) as got:
            return json.loads(got.read())["response"]

    def reply(self, role: str, prompt: str, schema: str | None = None) -> str:
        return Caller(self).call(role, prompt, schema).reply


@dataclass
class HeuristicBackend:
    """Rules instead of a model, so flows can run offline. Not equivalent to any model's output."""

    def reply(self, role: str, prompt: str, schema: str | None = None) -> str:
        words = [w for w in re.findall(r"[^\W\d_]{4,}", prompt.split("---", 1)[-1])]
        common = list(dict.fromkeys(words))[:4] or ["text"]
        ids = list(dict.fromkeys(re.findall(r"\[id:([^\]]+)\]", prompt)))
        if role == "metadata":
            return json.dumps({"title": " ".join(words[:6]), "first_author_lastname": common[0].title(), "year": "0000", "keywords": common})
        if role == "extract":
            return json.dumps({"concepts": [{"name": w, "confidence": "medium", "evidence_sentence": w} for w in common], "relations": [], "properties": [], "findings": []})
        if role in ("generate", "gap"):
            return json.dumps({"questions": [{"question": f"What is the role of {w} in this text?", "expected_answer": f"The text mentions {w}.", "archetype": "ENTITY_LOOKUP", "source_section": "Body"} for w in common[: 2 if role == "gap" else 4]]})
        if role == "judge":
            return json.dumps({"verdicts": [{"question_id": i, "score": 0.8 if n % 3 else 0.5, "reasons": []} for n, i in enumerate(ids)]})
        if role == "refine":
            return json.dumps({"questions": [{"id": i, "refiner_action": "keep"} for i in ids]})
        if role == "dedup":
            return json.dumps({"duplicate_groups": [], "singletons": ids})
        if role == "generalise":
            return json.dumps({"groups": [], "singletons": [{"gen_question": i, "member_ids": [i]} for i in ids]})
        if role == "fidelity":
            return json.dumps({"generated_answer": " ".join(words[:8]), "fidelity_score": 0.6, "verdict": "PARTIAL"})
        if role in ("consolidate_a", "consolidate_b"):
            return json.dumps({"consolidated_cqs": [{"cq_id": f"CQ_{n + 1:03d}", "competency_question": i, "merged_from": [i], "triple_pattern": []} for n, i in enumerate(ids)]})
        return json.dumps({"caption": " ".join(words[:8])})


def ask(prompts: DataFrame, backend: Backend | Caller, tasks: int | None = None) -> DataFrame:
    """Replies to prompts(call_id, role, prompt[, schema]). A failed call is a row with `error`, not the end of the job.

    A task calls with the caller's policies, as many at a time as its pool is wide. The reply table is written before anything reads
    it; with a log, replies are durable one by one before that, so a retried task makes no call twice.
    """
    by = caller(backend)

    def one(row: tuple) -> tuple:
        began = time.time()
        try:
            said = by.call(row.role, row.prompt, getattr(row, "schema", None))
            return (row.call_id, row.role, said.reply, None, said.attempts, said.seconds)
        except Unreachable:
            raise
        except Exception as problem:
            return (row.call_id, row.role, None, f"{type(problem).__name__}: {problem}", 1, time.time() - began)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [done for _, done in pooled(frame.astype(object).where(frame.notna(), None).itertuples(index=False), one, by.width)]
            yield pd.DataFrame(rows, columns=["call_id", "role", "reply", "error", "attempts", "seconds"])

    return keep((prompts if tasks is None else prompts.repartition(tasks)).mapInPandas(run, REPLIES))


def call_statistics(replies: DataFrame) -> DataFrame:
    return replies.groupBy("role").agg(F.count("*").alias("calls"), F.count("error").alias("failed"), F.round(F.sum("seconds"), 3).alias("seconds"))


def required_models(needed: DataFrame, served: DataFrame) -> DataFrame:
    """Models a run needs that the server does not list: (model)."""
    return needed.select("model").distinct().join(served.select("model"), "model", "left_anti")
