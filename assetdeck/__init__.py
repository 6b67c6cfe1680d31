"""assetdeck: a Spark-native data-asset store.

Asset snapshots are ordinary DataFrames; listing, registration checks,
annotation merges, metadata extraction and display formatting are expressed
as DataFrame / Spark SQL operators so that Catalyst plans them.
"""

__version__ = "0.1.0"
