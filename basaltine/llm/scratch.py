"""Tables written between the steps of an operator: those of the core."""

from basaltine.sources.scratch import saved, shared_folder

__all__ = ["saved", "shared_folder"]
