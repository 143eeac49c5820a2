"""Analytics operators for typed columnar data, stated as Spark DataFrame plans."""
