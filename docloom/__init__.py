"""docloom: document analytics expressed as Spark DataFrame operators."""
