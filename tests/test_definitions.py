"""Blocks of front matter: what they hold, and what can't be read."""

import time

import pytest

from sedimenta.operators.definitions import parse_block

READ = [
    ("a: 1\nb: [x, y]\n", {"a": 1, "b": ["x", "y"]}), ("", {}), ("# c\n\n", {}), ("a: ~\nb:\nc: true", {"a": None, "b": None, "c": True}), ("tags:\n- a\n- b\nx: y", {"tags": ["a", "b"], "x": "y"}),
    ("a:\n  b:\n    c: 1\n    d:\n      - x\n      - y: 2\n        z: [1,\n          2]\n  e: f # no\n", {"a": {"b": {"c": 1, "d": ["x", {"y": 2, "z": [1, 2]}]}, "e": "f"}}),
    ("t: |\n  one\n   two\n\n  three\nu: >-\n  a\n  b\n\n  c\nv: |+\n  x\n\nw: 1\n", {"t": "one\n two\n\nthree\n", "u": "a b\nc", "v": "x\n\n", "w": 1}), ("k: >\n  a\n    b\n  c\n", {"k": "a\n  b\nc\n"}),
    ("a: &n {k: 1}\nb: *n\nc: &l\n  - 1\nd: *l", {"a": {"k": 1}, "b": {"k": 1}, "c": [1], "d": [1]}), ("m:\n  - - 1\n    - 2\n  -\n    k: v\n  - plain\n", {"m": [[1, 2], {"k": "v"}, "plain"]}),
    ("'q k': \"v: w\"\nurl: http://x.y/z#q\nlong: some words\n  go on\ntime: 12:30\n", {"q k": "v: w", "url": "http://x.y/z#q", "long": "some words go on", "time": "12:30"}),
]


@pytest.mark.parametrize("body, held", READ)
def test_read(body, held):
    assert parse_block(body) == held


@pytest.mark.parametrize("body, line", [("- a", 3), ("a: 1\na: 2", 3), ("a: 1\n b: 2", 3), ("a: *no", 2), ("a: [1", 2), ("\ta: 1", 2), ("a: @x", 2), ("a: 1\n- b", 3), ("a:\n" + "".join(" " * k + "- \n" for k in range(1, 99)), None)])
def test_errors(body, line):
    with pytest.raises(ValueError, match=f"line {line}:" if line else "deep"):
        parse_block(body)


def test_time_follows_length():
    began = time.perf_counter()
    for body in ("a" + " " * 200_000 + "b", "a" * 300_000, "a:b" * 100_000, "a#" * 100_000, '"' + '\\"' * 100_000, "a: |\n" + " x\n" * 50_000, "'" + "''" * 100_000):
        try:
            parse_block(body)
        except ValueError:
            pass
    assert time.perf_counter() - began < 20
