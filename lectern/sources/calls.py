"""Calls of a text model from tasks: a policy for each role, a bounded pool, and a log that makes every reply durable.

A `Caller` wraps a backend. Each call follows its role's policy: a time-out, a number of attempts, and pauses that double from one to the
next. With a log, a reply is written to shared storage before anything goes on; a call that is in the log is not made again, whether a
task is retried, an executor is lost, or the run starts anew. So a killed extraction repeats the call it was killed in, and no other.

The log is addressed by content: a file for each (scope, role, prompt, schema), written under another name and moved into place, so a
reader sees a whole reply or none, and two writers of one reply leave one. Any store that pyarrow opens by its address will do (file,
hdfs, s3, gs); it must be shared by driver and executors.

Defined cases: null prompts are asked as empty texts; an empty table makes no call; a reply that is logged counts zero attempts; two equal prompts of one scope share their reply;
a failed call is never logged.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Protocol, TypeVar


class Backend(Protocol):
    """`send(role, prompt, schema, policy)` makes one attempt. A backend with `reply(role, prompt, schema)` only is called with that."""

    def reply(self, role: str, prompt: str, schema: str | None = None) -> str: ...


class Unreachable(RuntimeError):
    """The server cannot be reached: the batch stops; other errors only cost their row."""


@dataclass(frozen=True)
class Policy:
    timeout: float = 240.0  # seconds an attempt may take
    attempts: int = 5
    pause: float = 2.0  # seconds before the second attempt; doubled before each further one
    longest_pause: float = 60.0
    think: bool = False  # whether the model is asked for its chain of thought
    temperature: float = 0.1
    context: int = 32_768  # tokens


# fixed values: time-outs, attempts and decoding by role
DEFAULT = Policy()
POLICIES: dict[str, Policy] = {
    "dedup": Policy(timeout=360.0, attempts=5, think=True),
    "generalise": Policy(timeout=360.0, attempts=5, think=True),
    "consolidate_a": Policy(timeout=1800.0, attempts=1, temperature=0.2, context=65_536),
    "consolidate_b": Policy(timeout=1800.0, attempts=1, temperature=0.2, context=65_536),
}


@dataclass(frozen=True)
class Said:
    reply: str
    attempts: int
    seconds: float


class ReplyLog:
    """Replies by their key, one file each, in a shared folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self):
        from pyarrow import fs

        # Hadoop writes file:/x and s3a://, other readers file:///x and s3://
        where = self.folder.replace("s3a://", "s3://", 1)
        if where.startswith("file:/") and not where.startswith("file://"):
            where = "file://" + where[5:]
        return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)

    @staticmethod
    def key(scope: str, role: str, prompt: str, schema: str | None) -> str:
        return hashlib.sha256(json.dumps([scope, role, prompt, schema]).encode()).hexdigest()

    def get(self, key: str) -> str | None:
        store, root = self._open()
        try:
            with store.open_input_stream(f"{root}/{key[:3]}/{key}.json") as f:
                return json.loads(f.read())["reply"]
        except FileNotFoundError:
            return None

    def put(self, key: str, reply: str) -> None:
        store, root = self._open()
        store.create_dir(f"{root}/{key[:3]}", recursive=True)
        draft = f"{root}/{key[:3]}/.{key}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"reply": reply}).encode())
        store.move(draft, f"{root}/{key[:3]}/{key}.json")

    def clear(self) -> None:
        """Forget all replies, once what was made of them is kept."""
        from pyarrow import fs

        store, root = self._open()
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


@dataclass
class Caller:
    """A backend with policies, a log and the width of the pool a task may call it with."""

    backend: Backend
    policies: dict[str, Policy] = field(default_factory=lambda: dict(POLICIES))
    default: Policy = DEFAULT
    log: ReplyLog | None = None
    width: int = 4

    def call(self, role: str, prompt: str | None, schema: str | None = None, scope: str = "") -> Said:
        """The reply, by the role's policy. Unreachable after the last attempt; other errors of the backend are raised at once."""
        began, prompt = time.monotonic(), prompt or ""
        key = ReplyLog.key(scope, role, prompt, schema) if self.log else ""
        if self.log and (known := self.log.get(key)) is not None:
            return Said(known, 0, time.monotonic() - began)
        policy, send = self.policies.get(role, self.default), getattr(self.backend, "send", None)
        pause = policy.pause
        for attempt in range(1, policy.attempts + 1):
            try:
                reply = send(role, prompt, schema, policy) if send else self.backend.reply(role, prompt, schema)
                break
            except (OSError, Unreachable) as problem:
                if attempt == policy.attempts or not send:
                    raise Unreachable(f"{role}: {problem} (attempt {attempt})") from problem
                time.sleep(pause)
                pause = min(policy.longest_pause, 2 * pause)
        if self.log:
            self.log.put(key, reply)
        return Said(reply, attempt, time.monotonic() - began)


def caller(backend: Backend | Caller) -> Caller:
    return backend if isinstance(backend, Caller) else Caller(backend)


Job = TypeVar("Job")
Done = TypeVar("Done")


def pooled(jobs: Iterable[Job], work: Callable[[Job], Done], width: int) -> Iterator[tuple[Job, Done]]:
    """(job, result) as they finish, with at most `width` jobs taken from the source and not yet finished. An error ends the pool:
    what runs is waited for (its replies reach the log), what waits is not begun, and the error is raised."""
    stop = threading.Event()

    def guarded(job: Job) -> Done:
        if stop.is_set():
            raise RuntimeError("another call of the pool failed")
        return work(job)

    source = iter(jobs)
    with ThreadPoolExecutor(max(1, width)) as pool:
        running: dict[Future, Job] = {}
        try:
            while True:
                while len(running) < width and (job := next(source, stop)) is not stop:
                    running[pool.submit(guarded, job)] = job
                if not running:
                    return
                for one in wait(running, return_when=FIRST_COMPLETED).done:
                    yield running.pop(one), one.result()
        except BaseException:
            stop.set()
            raise
