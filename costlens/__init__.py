"""Cloud-cost analytics on Spark: operators over bill lines as DataFrame functions."""
