"""Memory of a Python worker between arrays."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

from cleaveset.session import WORKER_ENV

TRIM, MMAP = -1, -3  # glibc's M_TRIM_THRESHOLD and M_MMAP_THRESHOLD
#: Arrays up to this size are taken from memory that was freed before, within ``keeping``.
KEPT = 1 << 25


@contextmanager
def keeping():
    """Within it, freed arrays of some MB are used again and not returned at once, which saves the page faults of each.

    At the end everything free goes back and the session's thresholds hold again. Without glibc nothing changes.
    """
    try:
        libc = ctypes.CDLL(None)
        change, trim = libc.mallopt, libc.malloc_trim
    except (OSError, AttributeError):
        change = None
    if change:
        change(MMAP, KEPT)
        change(TRIM, KEPT)
    try:
        yield
    finally:
        if change:
            change(MMAP, int(WORKER_ENV["MALLOC_MMAP_THRESHOLD_"]))
            change(TRIM, int(WORKER_ENV["MALLOC_TRIM_THRESHOLD_"]))
            trim(0)
