"""Shared scratch tables, as the rest of the library keeps them."""

from loomtext.scratch import clear, discard, materialise, materialise_by, passing, scratch_dir

__all__ = ["clear", "discard", "materialise", "materialise_by", "passing", "scratch_dir"]
