"""A worker gives back what a step has needed."""

import numpy as np
import psutil

from gaugework.llm.shared import frugal


def test_memory_goes_back_to_the_system():
    held = []

    def run(batches):
        for batch in batches:
            many = [np.ones(512) for _ in range(1 << 16)]  # 256 MB in pieces that lie below the last one, which stays
            held.append(np.ones(512))
            del many
            yield batch

    before = psutil.Process().memory_info().rss
    assert list(frugal(run)([1, 2])) == [1, 2]
    assert psutil.Process().memory_info().rss - before < 100 << 20
