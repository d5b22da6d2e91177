"""kinsift: record linkage, deduplication and cohort analytics on PySpark DataFrames."""
from kinsift.plans.linker import Linker, LinkConfig  # noqa: F401
