import random

import pytest
from llm_helpers import prose


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, one very long text, other scripts."""
    rng = random.Random(7)
    base = prose(rng, 120)
    copy = base.replace("the", "thee", 1)
    return [(1, base), (2, None), (3, ""), (4, " \t\n\x0b "), (None, base), (None, None), (5, base), (5, base),
            (6, copy), (7, "ÄÖÜ ñandú 中文 字 😀 word"), (8, prose(rng, 30_000)), (9, "one two"), (10, "x" * 5000),
            (11, "ab " * 400), (12, "\n".join([base, prose(rng, 60), copy])), (13, prose(rng, 200))]
