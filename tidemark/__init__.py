"""Event analytics as plain ``DataFrame -> DataFrame`` operators on Spark."""
