"""Replays a folder of scripts with recorded answers, if REPLAY_FIXTURES names one: x.sql beside x.ans, whose lines are (status, detail) of each statement and
the rows of each query. The recorded answers are fixed values; the files are read, never run by anything but this engine."""

import ast
import datetime
import math
import os
import re
from pathlib import Path

import pytest

from quern.session import Session

FOLDER = os.environ.get("REPLAY_FIXTURES")
CASES = sorted(Path(FOLDER).rglob("*.sql")) if FOLDER else []


def plain(x):
    return x.strftime("%Y-%m-%d") if isinstance(x, datetime.datetime) else x


def recorded(path):
    """The rows that stand between the statuses."""
    return [ast.literal_eval(line) for line in path.read_text().splitlines() if line.strip() and not re.fullmatch(r"\([A-Z ]+, (None|\d+)\)", line)]


@pytest.mark.skipif(not CASES, reason="REPLAY_FIXTURES isn't set")
@pytest.mark.parametrize("path", CASES, ids=lambda p: p.stem)
def test_replay(spark, path):
    if not path.with_suffix(".ans").exists():
        pytest.skip("no answers")
    got = []
    for r in Session(spark).run(path.read_text()):
        assert r.error is None
        if r.df is not None and not r.lines:
            got += [tuple(map(plain, row)) for row in r.df.collect()]
    want = recorded(path.with_suffix(".ans"))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: str(r[:1])), sorted(want, key=lambda r: str(r[:1])), strict=True) if len({str(r[:1]) for r in want}) == len(want) else zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-6) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
