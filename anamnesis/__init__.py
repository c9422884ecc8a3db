"""Analytics over stored conversations, as Spark DataFrame operators."""
