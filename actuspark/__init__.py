"""Cost-model features, data-quality tests and model validation as Spark DataFrame operators."""
