"""Best cut-off search over scored, labelled rows, as plain Spark DataFrame plans."""

from .api import Cutpoint, FrameCutpoint
from .report import propagate_to_logging, set_verbosity, verbosity

__version__ = "0.1.0"
__all__ = ["Cutpoint", "FrameCutpoint", "__version__", "propagate_to_logging", "set_verbosity", "verbosity"]
