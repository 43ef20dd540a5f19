import random
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Extra columns with names that the operators use inside.
CLASHES = ("marks", "bucket", "kept", "score", "h", "n", "component", "shard", "slot", "ids", "predicted", "label", "sketch", "key", "pos")


def sentence(rng, n):
    return " ".join("".join(rng.choice(("ba", "do", "ki", "lu", "me", "sa", "to")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rough(spark):
    """Documents with nulls in every column, empty and very long texts, copies, repeated rows and ids, and
    extra columns with clashing names."""
    rng = random.Random(5)
    shared, long_text = sentence(rng, 70), sentence(rng, 20_000)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "One"), (8, "one"), (9, f"{sentence(rng, 40)}\n{shared}"),
        (10, f"{shared}  {sentence(rng, 30)}"), (11, long_text), (12, long_text), (None, base), (None, None), (13, sentence(rng, 60)),
        (13, sentence(rng, 60)), (14, base), (14, base), (15, "é 漢字  x \u0085 y"), (16, "x" * 50_000), (17, " ".join(["same"] * 300)), (18, " ".join(["same"] * 200)),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", None if k % 3 == 0 else len(t or ""), *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def none(rough):
    """The same columns without a row."""
    return rough.where("false")
