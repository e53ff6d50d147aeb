"""yesterlog: as-of analytics on Spark, where every value comes from strictly earlier information."""
