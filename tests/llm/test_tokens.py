"""Web tokens in runs of mixed case and behind invalid starts, against a plain scan of every start."""

from __future__ import annotations

import base64
import json
import re
import time

import numpy as np

from scriptorium.llm import secrets

WHOLE = re.compile(r"(eyJ[A-Za-z0-9_-]{5,})\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}")


def token(header=None):
    return base64.urlsafe_b64encode(json.dumps(header or {"alg": "HS256", "typ": "JWT"}, separators=(",", ":")).encode()).decode().rstrip("=") + ".eyJzdWIiOiIxIn0.abcdefghijkl"


def plain(text):
    out, at = [], 0
    while (at := text.find("eyJ", at)) >= 0:
        found = WHOLE.match(text, at)
        if found and secrets._jwt_header(found[1]):
            out.append((at, found.end()))
            at = found.end()
        else:
            at += 1
    return out


def spans(text):
    return [(s, e) for s, _, kind, e in secrets.find_secrets(text) if kind == "jwt"]


def test_case_and_failed_starts():
    for before in ("", "keyj_", "Eyj", "eyj", "EYJ", "eyJunk-", "eyJ", "eyJeyJ", "eyJ.eyJ."):
        text = before + token() + " end"
        assert spans(text) == plain(text) == [(len(before), len(text) - 4)], before
    assert spans("eyJunk-nothing." + token()) == [(15, 15 + len(token()))]
    assert spans(token({"typ": "JWT"})) == [] and spans(token({"alg": "none", "pad": " " * 5})) != []


def test_random_mixtures():
    rng = np.random.default_rng(3)
    parts = ["eyJ", "eyj", ".", "-", "abcdefghij", " ", "fQ", token(), token({"alg": "a"}), token()[:20], "EYJ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 12))))
        assert spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("eyJ" * 400_000, "eyJ" * 400_000 + ".aaaaaa.bbbbbbbbbbbb", "Eyj" * 400_000 + token()):
        assert spans(text) == ([(1_200_000, len(text))] if text[0] == "E" else [])
    assert time.time() - began < 20
