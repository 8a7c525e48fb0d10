"""helixframe: DataFrame operators for back-splice junction calling and genomic interval analytics on Spark."""
