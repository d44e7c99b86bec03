"""lakeprofile: profile, compare and guard tabular data with Spark."""

from lakeprofile.plans.profile import Profile

__all__ = ["Profile"]
__version__ = "0.1.0"
