from . import scalars
from .fixed_values import *  # noqa: F401,F403

__all__ = ["scalars"]
