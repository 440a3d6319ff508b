"""webobs: DataFrame operators for web observability data."""
