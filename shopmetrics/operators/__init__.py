"""DataFrame steps: rollups through a dimension, and batch ledger jobs that return new table states."""
