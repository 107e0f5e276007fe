"""Policies, pools and durable replies, against a server that counts; extraction that is killed and goes on."""

import json
import os
import threading
import time
import uuid
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import PythonException

from lectern.plans import flows
from lectern.sources.backends import HeuristicBackend, HttpBackend, ask, call_statistics
from lectern.sources.calls import POLICIES, Caller, Policy, ReplyLog, Unreachable, pooled


@dataclass
class Server:
    """Answers after `delay` seconds; the first `refuse` requests of a prompt get an error."""

    delay: float = 0.0
    refuse: int = 0

    def __enter__(self):
        self.seen, self.busy, self.peak, self.lock = [], 0, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.seen.append((body["prompt"], time.monotonic(), body))
                    outer.busy += 1
                    outer.peak = max(outer.peak, outer.busy)
                    nth = sum(p == body["prompt"] for p, _, _ in outer.seen)
                time.sleep(outer.delay)
                with outer.lock:
                    outer.busy -= 1
                try:
                    self.send_response(503 if nth <= outer.refuse else 200)
                    self.end_headers()
                    self.wfile.write(json.dumps({"response": "said " + body["prompt"]}).encode())
                except OSError:
                    pass  # the caller did not wait

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/"
        return self

    def __exit__(self, *_):
        self.http.shutdown()


def prompts(spark, n, role="judge", tasks=2):
    return spark.range(n).selectExpr("cast(id as string) as call_id", f"'{role}' as role", "concat('p', cast(id as string)) as prompt").repartition(tasks)


def test_policies_of_roles():
    """Time-outs and attempts of each kind of role."""
    assert (Policy().timeout, Policy().attempts) == (240, 5)
    assert {(POLICIES[r].timeout, POLICIES[r].attempts, POLICIES[r].think) for r in ("dedup", "generalise")} == {(360, 5, True)}
    assert {(POLICIES[r].timeout, POLICIES[r].attempts, POLICIES[r].context) for r in ("consolidate_a", "consolidate_b")} == {(1800, 1, 65_536)}


def test_pool_is_bounded_and_used(spark):
    with Server(delay=0.15) as server:
        by = Caller(HttpBackend(server.url, "m"), width=3)
        rows = ask(prompts(spark, 24), by).collect()
    assert {r.reply for r in rows} == {f"said p{i}" for i in range(24)} and all(r.attempts == 1 for r in rows)
    assert 3 < server.peak <= 6  # two tasks, three calls each


def test_back_off_and_attempts(spark):
    with Server(refuse=2) as server:
        by = Caller(HttpBackend(server.url, "m"), {"judge": Policy(attempts=4, pause=0.2)})
        row = ask(prompts(spark, 1), by).first()
        times = [t for _, t, _ in server.seen]
        assert (row.reply, row.attempts, row.error) == ("said p0", 3, None)
        assert times[1] - times[0] >= 0.2 and times[2] - times[1] >= 0.4  # pauses double
        assert call_statistics(ask(prompts(spark, 0), by)).count() == 0


def test_time_outs_end_the_batch(spark):
    with Server(delay=1.0) as server:
        by = Caller(HttpBackend(server.url, "m"), {"judge": Policy(timeout=0.1, attempts=2, pause=0.05)})
        with pytest.raises(PythonException, match="Unreachable"):
            ask(prompts(spark, 1), by).collect()
        assert len(server.seen) == 2


def test_decoding_by_role(spark):
    with Server() as server:
        ask(prompts(spark, 1, "generalise", 1), HttpBackend(server.url, "m")).collect()
        ask(prompts(spark, 1, "consolidate_b", 1), HttpBackend(server.url, "m", {"seed": 4})).collect()
        first, second = (body for _, _, body in server.seen)
    assert first["think"] is True and first["options"] == {"temperature": 0.1, "num_ctx": 32_768}
    assert second["think"] is False and second["options"] == {"temperature": 0.2, "num_ctx": 65_536, "seed": 4}


def test_logged_replies_are_not_asked_again(spark, tmp_path):
    with Server() as server:
        by = Caller(HttpBackend(server.url, "m"), log=ReplyLog(f"file:{tmp_path}/log"))
        assert {r.attempts for r in ask(prompts(spark, 5), by).collect()} == {1}
        again = ask(prompts(spark, 6), by).collect()
    assert sorted(r.attempts for r in again) == [0, 0, 0, 0, 0, 1] and len(server.seen) == 6
    by.log.clear()
    by.log.clear()
    assert by.log.get(ReplyLog.key("", "judge", "p0", None)) is None


def test_pool_stops_on_errors():
    begun = []

    def work(n):
        begun.append(n)
        time.sleep(0.02)
        if n == 3:
            raise Unreachable("gone")
        return n

    with pytest.raises(Unreachable):
        list(pooled(range(1000), work, 4))
    assert max(begun) < 20
    assert sorted(pooled(range(9), lambda n: n * n, 3)) == [(n, n * n) for n in range(9)] and list(pooled([], work, 2)) == []


@dataclass
class Counting(HeuristicBackend):
    """Leaves a file for each call; with `kill`, the call about that chunk ends the Python worker, once."""

    folder: str = ""
    kill: str = ""

    def reply(self, role, prompt, schema=None):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt.split("\n---\n")[-1])
        if self.kill and prompt.endswith(self.kill) and not os.path.exists(f"{self.folder}.killed"):
            open(f"{self.folder}.killed", "w").close()
            os._exit(1)
        return super().reply(role, prompt, schema)


def test_extraction_goes_on_after_a_killed_task(spark, tmp_path):
    """A worker is killed in the middle of a paper; the next run makes the calls that are left, and ends in the same state."""
    import tests.test_calls as own  # by reference, so that workers import the class

    chunks = spark.createDataFrame([(f"p{p}", c, f"words about copper graphene number {p} chunk{c} of paper{p}") for p in range(3) for c in range(8)], "paper string, chunk_id int, text string")
    (tmp_path / "calls").mkdir()
    state_of = lambda df: sorted(map(str, df.collect()))
    want = state_of(flows.extract(chunks, HeuristicBackend()))
    by = Caller(own.Counting(str(tmp_path / "calls"), "chunk5 of paper1"), log=ReplyLog(str(tmp_path / "log")), width=2)
    with pytest.raises(Exception):
        flows.extract(chunks, by).collect()
    before = len(os.listdir(tmp_path / "calls"))
    assert 6 <= before < 24
    assert state_of(flows.extract(chunks, by)) == want
    asked = [(tmp_path / "calls" / f).read_text() for f in os.listdir(tmp_path / "calls")]
    repeated = [t for t in set(asked) if asked.count(t) > 1]
    # only calls that were under way when the worker died are made twice
    assert "chunk5 of paper1" in " ".join(repeated) and len(asked) - 24 <= 2 * 3
    assert state_of(flows.extract(chunks, by)) == want and len(os.listdir(tmp_path / "calls")) == len(asked)


def test_unusable_replies_end_a_paper(spark):
    import tests.test_calls as own

    chunks = spark.createDataFrame([("p", c, f"t{c}") for c in range(6)] + [("q", 0, None)], "paper string, chunk_id int, text string")
    rows = flows.extract(chunks, own.Broken()).collect()
    assert {(r.paper, r.mentions) for r in rows} == {("p", 1)}  # t0 counts, t1 to t3 end the paper, t4 is never asked
    assert flows.extract(chunks.limit(0), own.Broken()).count() == 0


class Broken:
    def reply(self, role, prompt, schema=None):
        return json.dumps({"concepts": [{"name": "x"}]}) if prompt.endswith(("t0", "t4", "t5")) else "[]" if prompt.endswith("t1") else "no json"
