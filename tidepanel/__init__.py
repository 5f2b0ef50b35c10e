"""tidepanel: cross-sectional panel analytics on PySpark."""
