"""Intermediate tables in the shared folder of the cluster."""

from fathomline.sources.store import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
