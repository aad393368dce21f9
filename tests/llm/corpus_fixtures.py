"""Fixtures shared by the tests of the corpus operators."""

import random

import pytest


@pytest.fixture
def words():
    """A seeded source of invented texts."""
    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def make(n: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(n)]

    make.rng = rng
    return make
