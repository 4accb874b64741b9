"""Attribution analytics on Spark."""
