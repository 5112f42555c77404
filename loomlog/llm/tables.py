"""Tables written half way, in the folder that driver and executors share, and names that no table has yet."""

from ..tables import cut, shared_folder, unused

__all__ = ["cut", "shared_folder", "unused"]
