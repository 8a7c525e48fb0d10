import random

import pytest

WORDS = "the of and er tion ing an re he at en nd ti es or te ed is it al ar st nt to".split()


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words that look alike."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(n))

    return make
