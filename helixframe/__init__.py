"""helixframe: comparative genomics and corpus analytics as PySpark DataFrame operators."""
