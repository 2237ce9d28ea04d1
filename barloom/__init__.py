"""barloom: daily-equity analytics expressed as Spark DataFrame operators."""
