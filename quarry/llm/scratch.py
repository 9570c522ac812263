"""The scratch folder, see quarry.operators.scratch."""

from quarry.operators.scratch import _made, clear, land, new_path, shared_dir

__all__ = ["_made", "clear", "land", "new_path", "shared_dir"]
