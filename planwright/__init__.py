"""planwright: drawing analytics as lazy Spark DataFrame builders."""

__version__ = "0.1.0"
