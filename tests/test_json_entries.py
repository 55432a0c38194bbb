"""Entries of JSON files, whatever the ranges that tasks look at."""

import io
import json
import random

import pytest

from quarryline.sources import files
from quarryline.sources.json_entries import _is_key, object_entries

ODD = ['{"a": 1}', "[1, {\"b\": [2]}]", "17", "null", '"documents"', '{"t": "q\\" ,]} [\\\\"}', '{"t": "\\\\\\\\", "u": {"documents": [{"x": 1}]}}', "{}", '{ "é": "\\ud83d\\ude00 ü, {" }', '"\\\\"', '{"t": "' + "x," * 90 + '"}']

NAMES = ["n", "documents", "x\\\\", 'q\\"documents']


def _texts() -> dict[str, str]:
    rng = random.Random(7)
    some = lambda n: [rng.choice(ODD) for _ in range(n)]
    gap = lambda: rng.choice([",", " , ", ",\n\t"])
    out = {"empty.json": "", "blank.json": " \n ", "word.json": '"documents"', "none.json": "[]", "nobody.json": "{}", "open.json": '[{"a": 1}, {"b": 2'}
    for k in range(8):
        out[f"array{k}.json"] = "\n [" + gap().join(some(12)) + "] "
        named = gap().join(f'"{rng.choice(NAMES)}{k}{i}" : {x}' for i, x in enumerate(some(12)))
        out[f"named{k}.json"] = "{" + named + "}"
        out[f"under{k}.json"] = "{" + named + gap() + '"documents"' + " " * rng.choice([0, 300]) + ": [" + gap().join(some(9)) + "]" + gap() + '"q\\"documents": [{"no": 1}], "z": {"y": {"documents": [{"no": 2}]}}}'
    out["never.json"] = '{"documents": {"a": 1}, "b": {"c": []}}'
    out["escaped.json"] = '{"document\\u0073": [{"a": 1}]}'
    return out


def _expected(texts: dict[str, str]) -> set:
    want = set()
    for file, text in texts.items():
        try:
            whole = json.loads(text)
        except ValueError:
            continue
        if isinstance(whole, dict):
            listed = whole.get("documents")
            pairs = [(None, x) for x in listed] if isinstance(listed, list) else list(whole.items())
        else:
            pairs = [(None, x) for x in whole] if isinstance(whole, list) else []
        want |= {(file, n, key, json.dumps(x)) for n, (key, x) in enumerate(p for p in pairs if isinstance(p[1], dict))}
    return want | {("open.json", 0, None, '{"a": 1}')}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_entries_are_those_of_a_whole_read_whatever_the_range(spark, size):
    texts = {name: text for name, text in _texts().items() if size > 1 or len(text) < 400}
    frame = spark.createDataFrame([(name, len(text.encode())) for name, text in texts.items()], "file string, size long")
    rows = object_entries(frame, lambda name: io.BytesIO(texts[name].encode()), range_bytes=size).collect()
    places = {}
    for r in rows:
        places.setdefault(r.file, []).append(r)
    got = {(r.file, n, r.key, json.dumps(json.loads(r.entry))) for found in places.values() for n, r in enumerate(sorted(found, key=lambda r: r.pos))}
    assert got == _expected(texts)
    assert object_entries(frame.limit(0), lambda name: None).count() == 0


def test_keys_before_long_blanks():
    text = b'{"documents"' + b" " * 5000 + b":" + b"\n" * 700 + b"["
    assert _is_key(io.BytesIO(text), len(text) - 1, "documents")
    assert not _is_key(io.BytesIO(b'{"documents", ['), 14, "documents")
    assert not _is_key(io.BytesIO(b'{"x\\"documents":['), 16, "documents")


def test_a_file_is_loaded_by_more_than_one_task(spark, tmp_path):
    entries = [{"id": k, "qualified_name": f"n{k % 90}", "text": f"t{k} \\ \" ü" * 9} for k in range(100)]
    (tmp_path / "all.json").write_text(json.dumps({"documents": entries}))
    rows = files.load_documents(spark, str(tmp_path / "all.json"), range_bytes=500)
    want = {e["qualified_name"]: (e["id"], e["text"]) for e in entries}
    assert {r.qualified_name: (r.id, r.text) for r in rows.collect()} == want
    (tmp_path / "_hidden.json").write_text('[{"qualified_name": "h"}]')
    (tmp_path / "other.json").write_text('[{"qualified_name": "n3", "code": "later"}]')
    both = {r.qualified_name: r.text for r in files.load_documents(spark, str(tmp_path), range_bytes=500).collect()}
    assert both == {n: t for n, (_, t) in want.items()} | {"n3": "later"}
