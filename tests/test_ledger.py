"""Generators behind a server of the test's own: slow, failing and lost replies."""

import json
import threading
import time
from collections import Counter
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarryline.operators import ledger, providers


class Stub:
    """A completion server that fails the first time a prompt is put (503, 429), and always with 400 for 'bad'."""

    def __init__(self) -> None:
        self.asked, self.told, self.now, self.most, self.lock = Counter(), Counter(), 0, 0, threading.Lock()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                prompt = body["prompt"] if "prompt" in body else body["input"] if "input" in body else body["messages"][0]["content"]
                with stub.lock:
                    stub.asked[prompt] += 1
                    first = stub.asked[prompt] == 1
                    stub.now += 1
                    stub.most = max(stub.most, stub.now)
                time.sleep(0.2 if prompt.endswith("7") else 0.02)
                code = 400 if prompt == "bad" else (503 if prompt.endswith("3") else 429) if first and prompt[-1:] in "35" else 200
                with stub.lock:
                    stub.told[prompt] += code == 200
                    stub.now -= 1
                said = f"said {prompt}"
                shapes = {"/completion": {"content": f" {said} "}, "/messages": {"content": [{"text": said}]}, "/responses": {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": said}]}]}}
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(shapes[self.path]).encode() if code == 200 else b"no")

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def stub():
    made = Stub()
    yield made
    made.server.shutdown()
    made.server.server_close()


def test_each_prompt_is_answered_once(spark, stub, tmp_path):
    make = partial(providers.LocalProvider, stub.url)
    rows = [(k, f"p{k % 30}", "known" if k % 10 == 9 else None) for k in range(90)]
    frame = spark.createDataFrame(rows, "qid long, prompt string, explanation string")
    found = providers.answer(frame, make, place=f"file://{tmp_path}/ledger", at_once=3, tasks=2, pause=0.01)
    want = {(q, e or f"said {p}") for q, p, e in rows}
    assert {(r.qid, r.answer) for r in found.collect()} == want
    assert {(r.qid, r.answer) for r in found.collect()} == want  # a second action asks nothing
    assert set(stub.told.values()) == {1} and len(stub.told) == 27 and stub.most <= 6
    more = spark.createDataFrame([(1, "p1", None), (2, "new", ""), (3, None, None), (None, "p2", None)], "qid long, prompt string, explanation string")
    got = providers.answer(more, make, place=f"file://{tmp_path}/ledger", pause=0.01).collect()
    assert {(r.qid, r.answer) for r in got} == {(1, "said p1"), (2, "said new"), (3, "said"), (None, "said p2")}
    assert set(stub.told.values()) == {1} and len(stub.told) == 29
    assert not [p for p in (tmp_path / "ledger" / "fresh").rglob("*") if p.is_file()]


def test_a_job_that_fails_keeps_what_it_has_paid_for(spark, stub, tmp_path):
    make = partial(providers.LocalProvider, stub.url)
    frame = spark.createDataFrame([(k, f"p{k}", None) for k in range(12)] + [(99, "bad", None)], "qid long, prompt string, explanation string").coalesce(1)
    with pytest.raises(Exception, match="HTTP 400"):
        providers.answer(frame, make, place=f"file://{tmp_path}/ledger", at_once=1, tasks=1, pause=0.01)
    assert stub.asked["bad"] == 1  # an error that will not pass is not asked again within a task
    before = sum(stub.told.values())
    got = providers.answer(frame.where("qid < 99"), make, place=f"file://{tmp_path}/ledger", pause=0.01).collect()
    assert len(got) == 12 and set(stub.told.values()) == {1, 0} and sum(stub.told.values()) == 12 >= before


def test_retries_stop_and_nothing_asks_nothing(spark, stub):
    class Down:
        n = 0

        def generate(self, prompt):
            Down.n += 1
            raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        ledger.ask(Down(), "x", 3, 0.0)
    assert Down.n == 3
    none = spark.createDataFrame([], "qid long, prompt string, explanation string")
    assert providers.answer(none, partial(providers.LocalProvider, stub.url)).count() == 0 and not stub.asked


def test_hosted_services_against_a_server(stub, monkeypatch):
    monkeypatch.setenv("SOME_KEY", " k ")
    for call, path in ((providers._messages, "messages"), (providers._responses, "responses")):
        made = providers.HostedProvider("SOME_KEY", "m", partial(call, url=f"{stub.url}/{path}"))
        assert made.key == "k" and made.generate(f"hello {path}") == f"said hello {path}"
        with pytest.raises(RuntimeError, match="HTTP 400"):
            made.generate("bad")
