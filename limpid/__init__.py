"""limpid: data-quality operators written as Spark DataFrame plans."""
