"""Named queries: operators applied to the fixture views of the driver's tables."""
