"""Expression factories: every function returns a native Column."""
