"""shipfold: a Spark-native engine for freight shipment records.

Shipment records are read from files or scraped grids, normalised, kept as an
append-only change log and folded into one current row per key. Every operator
is a pure ``DataFrame -> DataFrame`` function built from Spark expressions.
"""

from shipfold.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
