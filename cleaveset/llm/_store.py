"""The shared-folder tables of the engine, under the name that this subpackage uses."""

from __future__ import annotations

from cleaveset.store import Store, shared_dir

__all__ = ["Store", "shared_dir"]
