"""Nested configuration against a YAML reader where one is installed, and layers of it."""

import sys

import pytest

from strandline.sources import config

TEXTS = [
    "a: 1\nb: text\n",
    "# top\nmodel:\n  width: 128 # comment\n  layers: [1, 2, [3, four]]\n  rate: 1.5e-3\n  on: {x: 1, y: null, z: 'a, b'}\ndata:\n  - one\n  - 'two # no comment'\n  - \"tab\\there\"\n",
    "steps:\n- name: first\n  args:\n    k: -3\n- name: second\n  args: {}\n- - 1\n  - 2\n-\n  deep: true\n-\nlast: ~\n",
    "url: http://host:80/x?y=1#z\nempty:\ntimes: 'it''s'\nplus: +7\nfloat: .5\nquoted: \"true\"\n'odd: key': 3\n",
    "",
    "---\na:\n  b:\n    c:\n      - d: [x]\n        e: 2\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_parsing_equals_yaml(text):
    yaml = pytest.importorskip("yaml")
    want = yaml.safe_load(text) or {}
    if "model" in want:
        want["model"]["rate"] = float(want["model"]["rate"])  # YAML 1.1 takes a number without a sign in its exponent as text
        want["model"] = {("on" if k is True else k): v for k, v in want["model"].items()}
        want["model"]["on"] = {("y" if k is True else k): v for k, v in want["model"]["on"].items()}
    assert config.parse_nested(text) == want


def test_values_without_a_yaml_reader():
    got = config.parse_nested(TEXTS[1])
    assert got == {"model": {"width": 128, "layers": [1, 2, [3, "four"]], "rate": 0.0015, "on": {"x": 1, "y": None, "z": "a, b"}}, "data": ["one", "two # no comment", "tab\there"]}
    assert config.parse_nested(TEXTS[2])["steps"] == [{"name": "first", "args": {"k": -3}}, {"name": "second", "args": {}}, [1, 2], {"deep": True}, None]


@pytest.mark.parametrize("text", ["a: 1\na: 2\n", "a:\n\tb: 1\n", "a: |\n  x\n", "a: &x 1\n", "just words\n", "- 1\n", "a:\n    b: 1\n  c: 2\n", "a: 1\n  b: 2\n", "a: [1,\n  2]\n"])
def test_what_is_not_understood_is_an_error(text):
    with pytest.raises(ValueError):
        config.parse_nested(text)


@pytest.mark.parametrize("installed", [True, False])
def test_layers_merge_at_every_depth(tmp_path, monkeypatch, installed):
    if not installed:
        monkeypatch.setitem(sys.modules, "yaml", None)
    (tmp_path / "base.yaml").write_text("model:\n  width: 128\n  heads: 4\n  slots: [1, 2]\nseed: 1\n")
    (tmp_path / "more.yaml").write_text("model:\n  heads: 8\n  slots: [3]\n")
    got = config.layered(str(tmp_path / "base.yaml"), str(tmp_path / "more.yaml"), None, {"model.width": 64, "new.deep.name": True})
    assert got == {"model": {"width": 64, "heads": 8, "slots": [3]}, "seed": 1, "new": {"deep": {"name": True}}}
    assert config.layered({"a": {"b": 1}}, {"a": 2}) == {"a": 2}
    first = {"a": {"b": 1}}
    config.layered(first, {"a": {"c": 2}})
    assert first == {"a": {"b": 1}}  # layers stay as they were
