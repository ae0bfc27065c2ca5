"""Plans on histograms whose lengths fill sequences exactly."""

from collections import Counter

import pytest

from mnemo.llm.packing import make_plan


@pytest.mark.parametrize("histogram, sequences", [({1366: 3000, 1365: 6000}, 3000), ({1400: 9000, 1300: 9000, 1396: 9000}, 9000), ({4096: 3, 2048: 101, 100: 7}, 54)])
def test_exact_lengths_are_packed_without_waste(histogram, sequences):
    plan, used = make_plan(dict(histogram)), Counter()
    for lengths, copies in zip(plan.lengths, plan.copies):
        assert sum(lengths) <= 4096
        for x in lengths:
            used[x] += copies
    assert sum(plan.copies) == sequences and +used == Counter(histogram)
