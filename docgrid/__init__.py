"""Travel-document data engine made of Spark DataFrame operators."""
