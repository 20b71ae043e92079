"""Analytics over recordings of moving platforms, as Spark DataFrame operators."""
