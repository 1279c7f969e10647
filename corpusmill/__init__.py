"""corpusmill: training-data analytics on Spark, as lazy DataFrame operators."""
