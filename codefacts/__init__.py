"""Code-fact analytics over many repositories, as PySpark DataFrame operators."""
