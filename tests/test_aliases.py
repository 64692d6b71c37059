"""Names of several words in texts, and rates by minute."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np

from scriptorium.operators.aliases import longest_alias
from scriptorium.streaming import metrics


def brute(texts, aliases):
    tidy = lambda x: re.sub(r"[\x09-\x0D\x20]+", " ", x.lower()).strip(" ")
    out = set()
    for t, text in texts:
        hits = [(-len(tidy(a)), k, tidy(a)) for k, a in aliases if a and tidy(a) and text and f" {tidy(a)} " in f" {tidy(text)} "]
        if hits:
            out.add((t, min(hits)[1], min(hits)[2]))
    return out


def found(spark, texts, aliases):
    rows = longest_alias(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(aliases, "alias_id long, alias string"))
    return [tuple(r) for r in rows.collect()]


def test_longest_alias_wins(spark):
    texts = [(1, "Ask the Payments  API\tTeam now"), (2, "payments apis"), (3, ""), (4, None), (5, " billing "), (6, "x " * 50_000 + "payments api")]
    aliases = [(1, "payments"), (2, "Payments API"), (3, "payments api team"), (4, "  "), (5, None), (6, "BILLING"), (7, "billing"), (7, "billing"), (8, "api payments")]
    got = found(spark, texts, aliases)
    assert len(got) == len(set(got)) and set(got) == brute(texts, aliases)
    assert {(1, 3, "payments api team"), (2, 1, "payments"), (5, 6, "billing"), (6, 2, "payments api")} == set(got)


def test_random_texts_against_brute_force(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(list("abcd"), n))
    texts = [(k, say(rng.integers(1, 12))) for k in range(200)]
    aliases = [(k, say(rng.integers(2, 6))) for k in range(40)]
    assert set(found(spark, texts, aliases)) == brute(texts, aliases)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []


def test_rates_by_minute(spark):
    at = dt.datetime(2024, 1, 1, 10, 0)
    rows = [("a", at + dt.timedelta(seconds=s)) for s in (0, 10, 59, 60)] + [("b", at), ("a", None), (None, at)]
    got = metrics.event_rates(spark.createDataFrame(rows, "who string, ts timestamp"), "who", limit=2)
    assert sorted(((r.who or "", r.period.minute, r.events, r.limited, r.over) for r in got.collect())) == [("", 0, 1, False, 0), ("a", 0, 3, True, 1), ("a", 1, 1, False, 0), ("b", 0, 1, False, 0)]
