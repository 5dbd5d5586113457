"""Learning-corpus analytics on Spark: DataFrame -> DataFrame operators, sources, plans and streams."""
