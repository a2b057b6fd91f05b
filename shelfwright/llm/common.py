"""What the operators of this subpackage share with the core."""

from shelfwright.session import ship
from shelfwright.tables import cut, forget, pick, shared_dir

__all__ = ["cut", "forget", "pick", "shared_dir", "ship"]
