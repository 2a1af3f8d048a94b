"""What the driver keeps."""

import re
import sys
from pathlib import Path

import pytest

from nickline.llm.common import released


def anonymous_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_goes_back_to_the_system():
    held = [bytes([i % 255 + 1]) * 50_000 for i in range(2_000)]
    last = held[-1:]  # lies on top, so the rest doesn't go by itself
    full = anonymous_mb()
    del held
    released()
    assert last and anonymous_mb() < full - 60
