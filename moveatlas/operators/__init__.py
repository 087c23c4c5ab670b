"""DataFrame-to-DataFrame operators, composable with ``df.transform``."""
