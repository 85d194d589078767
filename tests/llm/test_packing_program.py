import random
from collections import Counter

import pytest

from chartloom.llm.packing import _best_fit, least_sequences, sequences, solve_histogram

RND = random.Random(1)
HISTOGRAMS = {
    "even lengths": (dict.fromkeys(range(520, 997, 7), 40), 1_077),
    "few lengths": (Counter(RND.choice([700, 690, 1030, 340]) for _ in range(4_000)), None),
    "middle lengths": (Counter(RND.randint(300, 900) for _ in range(4_000)), None),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_program_is_near_its_bound_and_not_worse_than_best_fit(name):
    histogram, most = HISTOGRAMS[name]
    solution = solve_histogram(dict(histogram))
    used = Counter()
    for configuration, many in solution:
        assert sum(length * n for length, n in configuration) <= 2_048
        for length, n in configuration:
            used[length] += n * many
    assert used == Counter(histogram)
    assert least_sequences(histogram) <= sequences(solution) <= sequences(_best_fit(dict(histogram), 2_048))
    if most:
        assert sequences(solution) <= most


def test_bound_counts_pieces_over_half():
    assert least_sequences({1_500: 10, 600: 5}) == 12 and least_sequences({1_500: 10}) == 10 and least_sequences({}) == 0
