import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.path.join(ROOT, "tests", "data")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mixclust.session import local_session

    yield local_session("*", 8, app="mixclust-tests")


SPAM_WEIGHTS = {"space": 0.2, "time": 0.1, "size": 0.1, "IP": 0.2, "uri": 0.2, "botname": 0.2}


@pytest.fixture(scope="session")
def spam(spark):
    """The 10 sample spam records, featurized, limits and scaled rows (file order)."""
    from mixclust.operators.featurize import featurize_spam
    from mixclust.operators.scaling import fetch_limits, minmax_scale
    from mixclust.plans.geometry import Geometry
    from mixclust.plans.params import SPAM_FEATURES
    from mixclust.sources.json_lines import read_json_lines

    good, _ = read_json_lines(spark, os.path.join(DATA, "spam10.jsonl"))
    el = featurize_spam(good)
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, 1)
    lim = fetch_limits(el, geom.numeric_columns)
    pts = minmax_scale(el, lim).cache()
    rows = sorted((r.asDict() for r in pts.collect()), key=lambda r: r["id"])
    return pts, lim, rows
