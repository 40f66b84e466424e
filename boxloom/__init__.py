"""Box joins over vector tables in Spark, with ranking, quantizers and hashing."""
